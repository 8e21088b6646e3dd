"""Near-duplicates: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

1. ``signatures``: every text becomes its set of distinct five-word shingles (64-bit hashes), a digest of the set, and a
   SuperMinHash signature cut into bands. In round j every shingle offers the value ``j + r`` to the slot that its own
   random permutation holds at rank j; once all slots of a document are filled, later rounds cannot lower them: stop.
2. Documents with equal sets share a class (a partial aggregate on the digest); only classes go on.
3. Every band bucket pairs its members with its smallest member, as many pairs as members. Pairs are verified on the full
   sets; verified links are grouped.
4. Buckets whose members still lie in several groups are shuffled into parts of about four members, whose members of
   different groups are compared: again a number of pairs in proportion to the members. That joins most members of a large
   group of copies that are far from its smallest one.
5. In buckets that are still mixed, every member outside the bucket's largest group is a query against the whole bucket:
   small buckets by a join, larger ones in blocks that are compared and verified in place (``agree=0``: without a look at signatures). A block returns a spanning set of
   its links, fewer than its members. No bucket is cut, capped or left unexamined, whatever its size.

With six rows a band and 48 bands a pair of similarity 0.75 shares no bucket with probability 8e-5, one of 0.8 with 5e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table

SHINGLE = 5
SLOTS = 288
BANDS = 48
#: Texts are hashed in groups of about so many bytes.
GROUP_BYTES = 1 << 18
#: Within blocks, the share of equal signature slots that a pair needs to be verified, over the similarity wanted; at 0.75 a
#: pair falls short with probability 1e-6.
AGREE = 0.83
#: Rounds of comparisons within small random parts of mixed buckets, and members of a part.
ROUNDS, PART = 1, 4
#: Mixed buckets with more members are compared in blocks of so many.
SMALL, BLOCK = 16, 512
#: A key is frequent if it has more than one in so many of all rows, and more than LEAST: so there are no more of them than this.
FREQUENT, LEAST = 16_384, 1024

_M = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
with np.errstate(over="ignore"):
    _BASE = _M(0x9E3779B97F4A7C15)
    _BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * _M(2) + _M(1)
    _PLACE = np.random.default_rng(13).integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * _M(2) + _M(1)
_INVERSE = _M(pow(int(_BASE), -1, 1 << 64))
_NONE = _M(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word (A-Z lower-cased) of texts that lie end to end in ``data``, and each text's first word."""
    space = _SPACE[data]
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    starts_here = offsets[:-1][offsets[:-1] < len(data)]
    first[starts_here] = inside[starts_here]
    last = inside.copy()
    last[:-1] &= space[1:]
    ends_here = offsets[1:][offsets[1:] > 0] - 1
    last[ends_here] = inside[ends_here]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data]] * powers(_BASE, len(data)), out=total[1:], dtype=np.uint64)
        h = (total[b] - total[a]) * powers(_INVERSE, len(data) + 1)[a] + (b - a).astype(np.uint64)
    return mixed(h), np.searchsorted(a, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; one for the whole sequence if it is shorter."""
    h, at = word_hashes(data, offsets)
    with np.errstate(over="ignore"):
        n = max(0, len(h) - SHINGLE + 1)
        windows = mixed(sum((h[k : k + n] * _PLACE[k] for k in range(SHINGLE)), np.zeros(n, np.uint64)))
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(windows[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(mixed((h[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _M(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures (documents x slots) of non-empty sets; values order by rank, then by the random part."""
    n = np.array([len(s) for s in sets])
    out = np.full(len(sets) * slots, _NONE, np.uint64)
    elements, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    perm, rows = None, np.arange(len(elements))
    for j in range(slots):
        with np.errstate(over="ignore"):
            z = mixed(elements + _M(j + 1) * _BASE)
        k = j + ((z & _M(0xFFFFFFFF)) * _M(slots - j) >> _M(32)).astype(np.int64)
        value = (z >> _M(11)) & _M((1 << 53) - 1) | _M(j << 53)
        if j == 0:
            slot = k
        else:
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
                swap = first[keep]
                perm[rows, swap], perm[:, 0] = 0, swap
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
            perm[rows, j] = slot
        np.minimum.at(out, doc * slots + slot, value)
        # a document whose slots are all filled is done: later ranks only offer larger values
        open_docs = (out.reshape(-1, slots) == _NONE).any(1)
        if not open_docs.any():
            break
        stay = open_docs[doc]
        if j == 0:
            first, keep = k, np.flatnonzero(stay)
            elements, doc = elements[stay], doc[stay]
            rows = np.arange(len(elements))
        elif stay.mean() < 0.7:
            elements, doc, perm = elements[stay], doc[stay], perm[stay]
            rows = np.arange(len(elements))
    return out.reshape(-1, slots)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signature.reshape(len(signature), bands, signature.shape[1] // bands)
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _BASE, (len(signature), 1))
        for k in range(parts.shape[2]):
            key = mixed(key * _M(3) + parts[:, :, k])
    return key.view(np.int64)


def _groups(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of runs of texts of about GROUP_BYTES; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + GROUP_BYTES, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in _groups(batch.column("text")):
            sets = shingle_sets(data, offsets)
            full = [i for i, s in enumerate(sets) if len(s)]
            signature = super_minhash([sets[i] for i in full]) if full else np.zeros((0, SLOTS), np.uint64)
            keys, sketch = band_keys(signature), iter(signature.astype(np.uint8))
            flat, widths = pa.array(keys.reshape(-1)), np.zeros(len(sets) + 1, np.int32)
            widths[1:][full] = BANDS
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(np.cumsum(widths, dtype=np.int32)), flat), pa.array([next(sketch).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "digest", "bands", "sketch"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in _groups(batch.column("text")):
            sets = shingle_sets(data, offsets)
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int64)
            flat = pa.array(np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.LargeListArray.from_arrays(pa.array(ends), flat).cast(pa.list_(pa.int64()))], ["node", "shingles"])


def _local_union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one batch of links: each node with the smallest node that the batch connects it to."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int, parent: dict[int, int] = parent) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        out = [(x, r) for x in parent if (r := find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Union-find within each batch of links first; what is left is merged across partitions by large-star and small-star
    steps (every node to its smallest neighbour) until nothing changes. Steps only aggregate minima per node.
    """
    edges = links.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_local_union, "a long, b long")
    edges, before = stored(edges.distinct(), "links"), None
    while True:
        old = edges
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        discard(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    x, y = (sets.select(F.col("node").alias(c), F.col("shingles").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    got = pairs.select("a", "b").join(x, "a").join(y, "b").withColumn("_i", F.size(F.array_intersect("x", "y")))
    return got.filter(100 * F.col("_i") >= percent * (F.size("x") + F.size("y") - F.col("_i"))).select("a", "b").distinct()


def _ratio(percent: int):
    """Sets whose sizes differ more cannot reach the similarity."""
    return F.expr(f"100 * least(n, other_n) >= {percent} * greatest(n, other_n)")


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", agree: float = AGREE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    With ``agree=0`` signatures rule out no pair within large mixed buckets: each pair of similar size whose groups are not yet
    joined is held against its full sets, as in small buckets.

    Nulls: a null or blank text has no shingles and is linked with nothing; a row without an id is its own group, kept,
    with a null component_id. Rows with equal sets are linked whatever their number. Of equal candidates the smallest id
    stays. Ids should be unique: rows that share one are each judged by their own text, and kept alike. An empty table
    gives no rows. Other columns are not read, so their names cannot clash.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(own.mapInArrow(_sign, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary"), "signed")
    linkable = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    classes = stored(signed.filter(linkable).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    groups = _grouped(own, classes, percent, agree)
    named = classes.join(groups, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    # rows that nothing links need no join: null digests would all meet in one task
    alone = signed.filter(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = signed.filter(linkable).join(named, "digest").select("doc_id", "n_shingles", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _grouped(own: DataFrame, classes: DataFrame, percent: int, agree: float) -> DataFrame:
    """(node, component) of the classes that are linked to others; ``own`` holds their texts."""
    keyed = classes.select(F.explode("bands").alias("key"), "rep", "n")
    total = BANDS * classes.count()
    # buckets of two or more, the only ones that can link anything
    shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("rep", "n")).alias("low")).filter("members > 1"), "shared")
    members = stored(_by_key(keyed, shared, total).select("key", "rep", "n", F.col("low.rep").alias("other"), F.col("low.n").alias("other_n"), "members"), "buckets")
    pairs = stored(members.filter("rep <> other").filter(_ratio(percent)).select(F.col("rep").alias("a"), F.col("other").alias("b")).distinct(), "pairs")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = stored(own.join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "node long, shingles array<long>"), "sets")
    links = stored(_verified(pairs, sets, percent), "verified")
    groups = stored(components(links), "groups")
    buckets, used = members.select("key", "rep", "n"), [shared, members, pairs, sets, links]

    def add(found: DataFrame) -> None:
        """Groups with more links: a group's own star stands for the links that made it."""
        nonlocal groups
        found = stored(found, "verified")
        used.append(found)
        if not found.isEmpty():
            old = groups
            groups = stored(components(old.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found)), "groups")
            used.append(old)

    for turn in range(ROUNDS + 1):
        mixed_buckets = _mixed(buckets, groups, total, used)
        if mixed_buckets.isEmpty():
            break
        if turn < ROUNDS:
            part = F.pmod(F.xxhash64("rep", "key", F.lit(turn)), F.greatest(F.lit(1), F.floor(F.col("members") / PART)))
            add(_verified(_across(mixed_buckets.withColumn("_part", part), percent, ["key", "_part"]).distinct(), sets, percent))
            buckets = mixed_buckets.select("key", "rep", "n")
        else:
            pairs = _across(mixed_buckets.filter(F.col("members") <= SMALL), percent).distinct()
            large = mixed_buckets.filter(F.col("members") > SMALL)
            add(_verified(pairs, sets, percent).union(_in_blocks(large, classes, sets, percent, agree, total, used)))
    discard(*used)
    return groups


def _by_key(rows: DataFrame, facts: DataFrame, total: int) -> DataFrame:
    """``rows`` with what ``facts`` (a stored row for each key, with its ``members``) tell of their key; others are dropped.

    Rows of frequent keys stay where they are: such keys are at most FREQUENT of the ``total`` rows, so their facts are
    broadcast. The others are shuffled by key, LEAST or a FREQUENT-th of the rows to a key at most.
    """
    many = F.col("members") > max(LEAST, total // FREQUENT)
    frequent = facts.filter(many)
    if frequent.isEmpty():
        return rows.join(facts, "key")
    frequent = F.broadcast(frequent)
    return rows.join(frequent, "key").unionByName(rows.join(frequent.select("key"), "key", "left_anti").join(facts.filter(~many), "key"))


def _mixed(buckets: DataFrame, groups: DataFrame, total: int, used: list[DataFrame]) -> DataFrame:
    """Members of the buckets that hold more than one group: (key, rep, n, grp, members), stored."""
    told = buckets.join(groups.select(F.col("node").alias("rep"), F.col("component").alias("grp")), "rep", "left").withColumn("grp", F.coalesce("grp", "rep"))
    told = stored(told, "told")
    kinds = told.groupBy("key").agg(F.min("grp").alias("_lo"), F.max("grp").alias("_hi"), F.count(F.lit(1)).alias("members")).filter("_lo < _hi").select("key", "members")
    kinds = stored(kinds, "kinds")
    out = stored(_by_key(told, kinds, total).select("key", "rep", "n", "grp", "members"), "mixed")
    discard(told, kinds)
    used.append(out)
    return out


def _across(few: DataFrame, percent: int, keys: list[str] = ["key"]) -> DataFrame:  # noqa: B006
    """Pairs of a bucket's members that lie in different groups and are of similar size."""
    other = few.select(*keys, F.col("rep").alias("b"), F.col("n").alias("other_n"), F.col("grp").alias("_grp"))
    return few.join(other, keys).filter("rep > b AND grp <> _grp").filter(_ratio(percent)).select(F.col("rep").alias("a"), "b")


def _in_blocks(buckets: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, agree: float, total: int, used: list[DataFrame]) -> DataFrame:
    """Links (a, b) within large mixed buckets between queries, the members outside the largest group, and all members.

    Members and queries of a bucket are dealt into blocks; a task compares one block of each, whatever the bucket's size,
    and returns links that join what the groups and its other links have not yet joined.
    """
    size = buckets.groupBy("key", "grp").agg(F.count(F.lit(1)).alias("_c"))
    main = stored(size.groupBy("key").agg(F.max(F.struct("_c", "grp")).alias("_main"), F.sum("_c").alias("members")), "main")
    used.append(main)
    told = _by_key(buckets.drop("members"), main, total).withColumnRenamed("members", "_all")
    told = told.join(classes.select("rep", "sketch"), "rep").join(sets.select(F.col("node").alias("rep"), "shingles"), "rep").withColumn("_query", F.col("grp") != F.col("_main.grp"))
    parts = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    told = told.withColumns({"_m": parts(F.col("_all")), "_q": parts(F.col("_all") - F.col("_main._c"))})
    mine = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cols = ["key", "rep", "n", "grp", "sketch", "shingles"]
    members = told.select(*cols, F.lit(False).alias("query"), mine("_m", 1).alias("mb"), F.explode(all_of("_q")).alias("qb"))
    queries = told.filter("_query").select(*cols, F.lit(True).alias("query"), F.explode(all_of("_m")).alias("mb"), mine("_q", 2).alias("qb"))

    def compare(key, rows):
        query = np.array(rows.column("query").to_pylist(), bool)
        rep, n, grp = (rows.column(c).to_numpy() for c in ("rep", "n", "grp"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(query), -1)
        flat = rows.column("shingles").combine_chunks()
        ends, flat = flat.offsets.to_numpy(), flat.values.to_numpy().view(np.uint64)
        m = np.flatnonzero(~query)
        a, b = [], []
        names, local = np.unique(grp, return_inverse=True)
        root = np.arange(len(names))  # groups of the block that its links have joined so far, as their first
        for i in np.flatnonzero(query).tolist():
            ok = m[(root[local[m]] != root[local[i]]) & (100 * np.minimum(n[m], n[i]) >= percent * np.maximum(n[m], n[i]))]
            ok = ok[(sketch[ok] == sketch[i]).mean(1) >= agree * percent / 100]
            if len(ok):
                # both sets are sorted: count the members' shingles that the query has
                own = flat[ends[i] : ends[i + 1]]
                theirs = np.concatenate([flat[ends[k] : ends[k + 1]] for k in ok.tolist()])
                same = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                shared = np.add.reduceat(same, np.cumsum(np.append(0, n[ok]))[:-1], dtype=np.int64)
                ok = ok[100 * shared >= percent * (n[ok] + n[i] - shared)]
            for k in ok.tolist():
                x, y = root[local[k]], root[local[i]]
                if x != y:
                    root[root == max(x, y)] = min(x, y)
                    a.append(max(rep[k], rep[i]))
                    b.append(min(rep[k], rep[i]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.union(queries).groupBy("key", "mb", "qb").applyInArrow(compare, "a long, b long").distinct()


def drop_near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, all columns as they were; rows without an id stay."""
    gone = near_duplicates(docs, percent, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    out = docs.select(F.struct(*docs.columns).alias("_row"))
    return out.join(gone, F.col(f"_row.{id_col}").cast("long") == F.col("_gone"), "left_anti").select("_row.*")


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_SQL = """
WITH RECURSIVE lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) END AS s FROM lowered),
long AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM long a JOIN long b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * i >= 75 * (na + nb - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.root AS component_id, s.doc_id = r.root AS kept
FROM sets s JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = s.doc_id"""

QUERIES = {"op10_superminhash": op10_superminhash}
ORACLE = {"op10_superminhash": _SQL}
