"""A Merkle manifest of a dataset by superblock reduction.

Each row is a leaf; per source the leaves, in order of their ids, are hashed together in runs of ``FANOUT``, level by level,
down to one node, the source's subroot, and the subroots in the same way to the root. Upwards, indices are dealt to buckets
of ``FANOUT**LEVELS``; ``applyInPandas`` collapses ``LEVELS`` levels of a bucket at once, and bucket roots are the next
step's nodes, until one is left a source: three steps hold 6.8e10 leaves of one source. Downwards, each step's buckets hand
their nodes the path above them, so a leaf's proof is what its own bucket holds followed by its bucket's path. No task holds
more than one bucket, however many rows a source has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bloomdedup import _LOWER, _UPPER, normalised
from .common import remainder, stored, table
from .sharding import _crc32_sql

FANOUT, LEVELS = 16, 3
#: Leaves of every how manieth checksum are tampered with in ``verified``.
TAMPERED = 5

_PATH = "array<struct<l:string,r:string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_above(count: int) -> int:
    """Levels between ``count`` nodes and the one that they become."""
    n = 0
    while count > 1:
        count, n = -(-count // FANOUT), n + 1
    return n


def collapsed(nodes: list[str], levels: int) -> list[list[str]]:
    """A bucket's nodes and its next ``levels`` levels; a run of one node is hashed too."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(*below[a : a + FANOUT]) for a in range(0, len(below), FANOUT)])
    return out


def siblings(tree: list[list[str]], i: int) -> list[tuple[str, str]]:
    """What stands left and right of node ``i`` in its run, as text, level by level up to the bucket's root."""
    out = []
    for level in tree[:-1]:
        start = i // FANOUT * FANOUT
        out.append(("".join(level[start:i]), "".join(level[i + 1 : start + FANOUT])))
        i //= FANOUT
    return out


def folded(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left, node, right)
    return node


# --- leaves ---


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(docs: DataFrame, text: Column) -> Column:
    """The hash of a row with ``text`` as its text."""
    fields = [_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.sha2(F.concat(*fields, _field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, g, h, tampered): ``g`` orders sources bytewise, null first; ``tampered`` is null for rows left alone."""
    low = F.when(F.col("text").isNotNull(), normalised(F.col("text")))
    touched = remainder(F.col("doc_id"), TAMPERED) == 0
    group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return docs.select("doc_id", group.alias("g"), leaf_of(docs, F.col("text")).alias("h"), F.when(touched, leaf_of(docs, low)).alias("tampered"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their index ``i`` within their group ``g``, in the given order, and the group's size ``n``.

    A range sort by group and order deals the rows out, so a hot group is many ranges; the counts of each range's groups say
    where its rows begin. Rows that agree in all of ``order`` are interchangeable.
    """
    by = [F.col(c).asc_nulls_first() for c in ["g", *order]]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    kept = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "placed").withColumn("_part", F.shiftright("_at", 33))
    # a row for each range and each group
    runs = kept.groupBy("_part", "g").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("n", F.sum("_n").over(W.partitionBy("g")))
    out = kept.join(runs, ["_part", "g"])
    return out.withColumn("i", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_n", "_before")


# --- up ---


def _bucketed(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("b", F.floor(F.col("i") / FANOUT**levels))


def reduced(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Steps of nodes (g, i, n, h), each made from the buckets of the one before, down to one node a group."""

    def root_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, n = pdf.sort_values("i"), int(pdf["n"].iloc[0])
        tree = collapsed(pdf["h"].tolist(), min(levels, levels_above(n)))
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "i": [int(pdf["b"].iloc[0])], "n": [-(-n // FANOUT**levels)], "h": [tree[-1][0]]})

    steps = [nodes]
    while (steps[-1].agg(F.max("n")).first()[0] or 0) > 1:
        up = _bucketed(steps[-1].select("g", "i", "n", "h"), levels).groupBy("g", "b").applyInPandas(root_of, "g string, i long, n long, h string")
        steps.append(stored(up, "nodes"))
    return steps


# --- down ---


def _handed_down(nodes: pd.DataFrame, above: pd.DataFrame, levels: int) -> Iterator[tuple[dict, list[tuple[str, str]]]]:
    """Each node of a bucket with its path to the root."""
    if not len(nodes):
        return
    nodes = nodes.sort_values("i")
    n = int(nodes["n"].iloc[0])
    tree = collapsed(nodes["h"].tolist(), min(levels, levels_above(n)))
    upper = [(p["l"], p["r"]) for p in above["path"].iloc[0]]
    # the levels above the first are the same for a whole run
    shared: list[tuple[str, str]] = []
    for k, row in enumerate(nodes.to_dict("records")):
        if len(tree) > 1:
            if k % FANOUT == 0:
                shared = siblings(tree[1:], k // FANOUT) + upper
            yield row, siblings(tree[:2], k) + shared
        else:
            yield row, upper


def _beside(step: DataFrame, above: DataFrame, levels: int):
    """A step's buckets beside the paths (g, i, path, ...) of the nodes that they became."""
    return _bucketed(step, levels).groupBy("g", "b").cogroup(above.withColumnRenamed("i", "b").groupBy("g", "b"))


def paths_of(step: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """(g, i, path) of a step's nodes."""

    def run(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = [(r["g"], int(r["i"]), [{"l": a, "r": b} for a, b in path]) for r, path in _handed_down(nodes, above, levels)]
        return pd.DataFrame(rows, columns=["g", "i", "path"])

    return _beside(step, above, levels).applyInPandas(run, f"g string, i long, path {_PATH}")


def handed_down(steps: list[DataFrame], tops: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(g, i, path) of the second step's nodes, the first step's buckets, from those of the last step's, ``tops``."""
    for step in reversed(steps[1:-1]):
        tops = stored(paths_of(step, tops, levels), "paths")
    return tops


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof_digests) for every row of documents (doc_id,
    source, lang, n_chars, text).

    ``folded_root`` is what the leaf and its siblings give, of a text with A-Z lower-cased where ``TAMPERED`` divides the id's
    checksum. Nulls: a null field is written ``-``; a null source is a source of its own, before all others; a null id comes
    first in its source and its checksum is that of the empty text. Repeated rows are leaves of their own, side by side; rows
    of one id that differ are ordered by their leaves. An empty table gives no rows; texts of any length are read whole. Other
    columns are not read, so their names cannot clash.
    """
    rows = placed(stored(leaves(docs), "leaves"), ["doc_id", "h"])
    # ids pass Python as text: pandas has no whole numbers beside nulls
    rows = stored(rows.withColumn("doc_id", F.col("doc_id").cast("string")), "leaf-nodes")
    steps = reduced(rows, levels)
    subroots = steps[-1].select("g", F.col("h").alias("subroot"))
    # one node a source is the upper tree's leaf; a group of one has an empty path
    upper = stored(placed(steps[-1].select(F.lit("").alias("g"), F.col("g").alias("source"), "h"), ["source"]), "upper-nodes")
    upper_steps = reduced(upper, levels)
    root = upper_steps[-1].first()
    kind = docs.schema["doc_id"].dataType
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof_digests long"
    if root is None:
        return docs.sparkSession.createDataFrame([], schema).withColumn("doc_id", F.col("doc_id").cast(kind))
    root = root["h"]
    empty = F.array().cast(_PATH)
    tops = handed_down(upper_steps, upper_steps[-1].select("g", "i", empty.alias("path")), levels)
    sources = paths_of(upper, tops, levels) if len(upper_steps) > 1 else tops
    sources = upper.select("i", F.col("source").alias("g")).join(sources.select("i", "path"), "i").select("g", F.lit(0).cast("long").alias("i"), "path")
    paths = handed_down(steps, stored(sources, "source-paths"), levels)
    above = stored(paths.join(subroots, "g"), "bucket-paths")

    def proofs(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        out = []
        subroot = above["subroot"].iloc[0] if len(above) else None
        for r, path in _handed_down(nodes, above, levels):
            last = folded(r["tampered"] if isinstance(r["tampered"], str) else r["h"], path)
            text = "".join(x for p in path for x in p)
            out.append((r["doc_id"], r["h"], subroot, root, digest(text), last, last == root, len(text) // 64))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    buckets = _beside(rows, above, levels)
    return buckets.applyInPandas(proofs, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def op13_merkle_superblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _levels_sql(name: str, depth: int) -> str:
    """CTEs that reduce ``name``0 (g, i, n, h) level by level; ``name``k_runs holds the runs of level k."""
    out = []
    for k in range(depth):
        out.append(f"{name}{k}_runs AS (SELECT g, i // {FANOUT} AS r, n, list(h ORDER BY i) AS run FROM {name}{k} GROUP BY 1, 2, 3)")
        up = f"CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END"
        out.append(f"{name}{k + 1} AS (SELECT g, r AS i, (n + {FANOUT - 1}) // {FANOUT} AS n, {up} AS h FROM {name}{k}_runs)")
    return ", ".join(out)


def _fold_sql(name: str, nodes: str, depth: int, g: str, i: str) -> tuple[str, str]:
    """CTEs that take rows (g, proof, now, ...) of ``nodes`` up the levels of ``name``, and the last one's name."""
    out, before = [], nodes
    for k in range(depth):
        at = f"({i} // {FANOUT**k})"
        left = f"CASE WHEN n > 1 THEN array_to_string(run[1:{at} % {FANOUT}], '') ELSE '' END"
        right = f"CASE WHEN n > 1 THEN array_to_string(run[{at} % {FANOUT} + 2:], '') ELSE '' END"
        out.append(f"{nodes}{k}p AS (SELECT x.*, n AS cnt, {left} AS l, {right} AS r_ FROM {before} x JOIN {name}{k}_runs y ON y.g = x.{g} AND y.r = {at} // {FANOUT})")
        out.append(f"{nodes}{k}f AS (SELECT * EXCLUDE (cnt, l, r_, proof, now), proof || l || r_ AS proof, CASE WHEN cnt > 1 THEN sha256(l || now || r_) ELSE now END AS now FROM {nodes}{k}p)")
        before = f"{nodes}{k}f"
    return ", ".join(out), before


def _oracle(lower: int = 5, upper: int = 2) -> str:
    """For up to 16**lower rows a source and 16**upper sources."""
    field = lambda x: f"coalesce(octet_length(encode(({x})::VARCHAR))::VARCHAR || ':' || ({x})::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ['doc_id', 'source', 'lang', 'n_chars', text]))})"
    low = f"translate(text, '{_UPPER}', '{_LOWER}')"
    step = "CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END"
    first, at_source = _fold_sql("a", "leafs", lower, "g", "i")
    second, at_root = _fold_sql("b", "tops", upper, "top", "j")
    return f"""
WITH polynomial AS (SELECT list(list_reduce(range(8), lambda s, k: {step}, i::BIGINT) ORDER BY i) AS tab FROM range(256) AS g(i)),
rows AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf('text')} AS h, CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % {TAMPERED} = 0 THEN {leaf(low)} END AS tampered FROM documents, polynomial),
leafs AS (SELECT doc_id, g, h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS m, coalesce(tampered, h) AS now, '' AS proof FROM rows),
a0 AS (SELECT g, i, m AS n, h FROM leafs), {_levels_sql('a', lower)},
b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM a{lower}), {_levels_sql('b', upper)},
{first},
places AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS j, h AS subroot FROM a{lower}),
tops AS (SELECT x.*, '' AS top, j, subroot FROM {at_source} x JOIN places p ON p.g = x.g), {second}
SELECT doc_id, x.h AS leaf, subroot, z.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = z.h AS verified, (length(proof) // 64)::BIGINT AS proof_digests
FROM {at_root} x, b{upper} z"""


QUERIES = {"op13_merkle_superblocks": op13_merkle_superblocks}
ORACLE = {"op13_merkle_superblocks": _oracle()}
