"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

Full pieces are sequences of their own. The other pieces, one a document at most, are dealt into blocks of bounded size.
Each block is packed by several islands, each a task of its own with a population of packings: a child takes whole
well-filled bins from one parent, drops the other parent's bins that hold the same documents, its emptiest and a few random
ones, and packs the displaced documents again, by best fit or by filling bins one after the other exactly. Between epochs the
islands' elites are written to the shared folder and each island also receives the elite of its neighbour. Bins that stay badly filled are dissolved and packed again together with those of other blocks, level by
level, until one block is left.
"""

from __future__ import annotations

import base64
import json
import os
import random
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

CAPACITY = 1024
END = 2
#: Pieces in a block, at most about so many.
BLOCK = 8192
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 45, 4
#: The share of bins that a child takes from the second parent, and of those of the first that it dissolves (each at most; as
#: many again at random).
SHARE = 0.1
#: Bins with less than this share filled are packed again with those of other blocks.
GOOD = 0.97

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_OUT = f"{_PIECES}, sequence_id long, offset long"


def added_tokens(path: str) -> dict[str, int]:
    """The strings that a tokenizer's .json matches in any text before all else, and their ids."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if odd := [t["content"] for t in found if t["single_word"] or t["lstrip"] or t["rstrip"]]:
        raise ValueError(f"added tokens that take or need what stands beside them: {odd}")
    return {t["content"]: t["id"] for t in found}


def encoder(vocabulary: str | None = None):
    """text -> ids as little-endian uint32 bytes, as byte_bpe_50k.json gives them.

    The .tiktoken file holds the same ranks at about four times the speed, but no added tokens: those come from the .json
    beside it (a vocabulary without one has none). Their strings in a text become their ids, as with the library (tests
    compare them).
    """
    import public_tokenizers
    import tiktoken

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    beside = os.path.splitext(path)[0] + ".json" if vocabulary else public_tokenizers.path("byte_bpe_50k.json")
    added = added_tokens(beside) if os.path.exists(beside) else {}
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    core = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)._core_bpe
    names = set(added)
    return lambda text: bytes(memoryview(core.encode_to_tiktoken_buffer(text, names)))


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first is the shorter one."""
    n = len(ids) // 4
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def tokenised(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), END.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py() or "") + end
                rows += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(pieces_of(ids, capacity))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return own.mapInArrow(run, _PIECES)


def best_fit(bins: list[list[int]], load: list[int], items: list[int], size: list[int], capacity: int) -> None:
    """Puts each item into the fullest bin that has room, or a new one. Bins are found by the bits of their free room."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for b, used in enumerate(load):
        if used < capacity:
            free[capacity - used].append(b)
            rooms |= 1 << (capacity - used)
    for i in items:
        s = size[i]
        fit = rooms >> s
        if fit:
            room = (fit & -fit).bit_length() - 1 + s
            b = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            b, room = len(bins), capacity
            bins.append([i])
            load.append(0)
        load[b] += s
        room -= s
        if room:
            free[room].append(b)
            rooms |= 1 << room


def fill_exactly(bins: list[list[int]], load: list[int], items: list[int], size: list[int], capacity: int) -> None:
    """Opens bins for the largest items in turn and fills the rest of each: by one item or two that fit exactly, else by the largest that fits."""
    of: dict[int, list[int]] = {}
    sizes, left = 0, len(items)  # the bits of the sizes that are left
    for i in items:
        of.setdefault(size[i], []).append(i)
        sizes |= 1 << size[i]
    while left:
        inside, room, s = [], capacity, sizes.bit_length() - 1
        while s > 0:
            inside.append(of[s].pop())
            room -= s
            left -= 1
            if not of[s]:
                sizes ^= 1 << s
            fit = sizes & ((2 << room) - 1)
            s = fit.bit_length() - 1
            half = 0 if s == room else fit >> (room + 1) // 2 << (room + 1) // 2
            while half:
                a = half.bit_length() - 1
                if sizes >> (room - a) & 1 and (2 * a != room or len(of[a]) > 1):
                    s = a
                    break
                half ^= 1 << a
        bins.append(inside)
        load.append(capacity - room)


def least_bins(size: list[int], capacity: int) -> int:
    """A lower bound of the bins: items that leave no room for those of ``small`` or more share a bin with none of them."""
    count, total = [0] * (capacity + 1), [0] * (capacity + 2)
    for s in size:
        count[s] += 1
    for s in range(capacity, -1, -1):
        total[s] = total[s + 1] + s * count[s]
    best, lonely, pairs = 0, 0, sum(count[capacity // 2 + 1 :])
    for small in range(capacity // 2 + 1):
        if small:
            lonely += count[capacity - small + 1]
        room = (pairs - lonely) * capacity - (total[capacity // 2 + 1] - total[capacity - small + 1])
        rest = total[small] - total[capacity // 2 + 1]
        best = max(best, pairs + max(0, -(-(rest - room) // capacity)))
    return best


def _packed(bins: list[list[int]], size: list[int]) -> tuple[tuple[int, int], list[list[int]], list[int]]:
    load = [sum(size[i] for i in b) for b in bins]
    return (len(bins), -sum(x * x for x in load)), bins, load


def child(a, b, size: list[int], capacity: int, rng: random.Random):
    """Injects whole well-filled bins of ``b`` into ``a``, removes the bins of ``a`` that hold their items, packs the rest again."""
    n = len(a[1])
    some = lambda: int(n * SHARE * rng.random())
    good = [k for k, x in enumerate(b[2]) if x == capacity] or sorted(range(len(b[1])), key=lambda k: -b[2][k])[: n // 3 + 1]
    taken = rng.sample(good, min(len(good), 1 + some()))
    inside = {i for k in taken for i in b[1][k]}
    bins, load, loose = [b[1][k][:] for k in taken], [b[2][k] for k in taken], []
    dissolved = {*sorted(range(n), key=lambda k: a[2][k])[: 2 + some()], *rng.sample(range(n), int(n * SHARE))}
    for k, items in enumerate(a[1]):
        if k in dissolved or not inside.isdisjoint(items):
            loose += [i for i in items if i not in inside]
        else:
            bins.append(items[:])
            load.append(a[2][k])
    loose.sort(key=lambda i: (-size[i], i))
    (fill_exactly if rng.random() < 0.5 else best_fit)(bins, load, loose, size, capacity)
    return (len(bins), -sum(x * x for x in load)), bins, load


def evolve(size: list[int], elites: list[list[int]], seed: int, capacity: int = CAPACITY, generations: int = GENERATIONS, population: int = POPULATION) -> tuple[tuple[int, int], list[int]]:
    """The best packing of an island after some generations: (fitness, bin of each item)."""
    rng = random.Random(seed)
    least = least_bins(size, capacity)
    folk = []
    for elite in elites:
        bins: list[list[int]] = [[] for _ in range(max(elite, default=-1) + 1)]
        for i, b in enumerate(elite):
            bins[b].append(i)
        folk.append(_packed(bins, size))
    for k in range(population - len(folk)):
        noise = 0 if k < 2 else 0.1
        order = sorted(range(len(size)), key=lambda i: (-size[i] * (1 + rng.uniform(-noise, noise)), i))
        bins, load = [], []
        (fill_exactly if k == 1 else best_fit)(bins, load, order, size, capacity)
        folk.append(_packed(bins, size))
    for _ in range(generations):
        folk.sort(key=lambda p: p[0])
        if folk[0][0][0] <= least or len(size) < 2:
            break
        one, two = rng.sample(folk[: max(2, population // 2 + 1)], 2)
        new = child(one, two, size, capacity, rng)
        if new[0] <= folk[-1][0]:
            folk[-1] = new
    best = min(folk, key=lambda p: p[0])
    where = [0] * len(size)
    for k, items in enumerate(best[1]):
        for i in items:
            where[i] = k
    return best[0], where


def _ordered(items: pa.Table) -> pa.Table:
    """A block's pieces in an order that all islands share."""
    return items.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("_row", "ascending")])


def _pack_level(items: DataFrame, level: int, capacity: int) -> DataFrame:
    """Packs every block of ``items`` (pieces, _row, _block): adds ``_bin`` and ``_load`` of the best island."""
    wide = items.select("_block", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("_island"), "_row", "doc_id", "piece", "length")
    kind = "_block long, _island int, n_bins int, fitness long, packing array<int>"

    def result(key, size, elites, epoch):
        block, island = (k.as_py() for k in key)
        fit, where = evolve(size, elites, seed=(block * 31 + island) * 31 + epoch, capacity=capacity)
        return pa.table({"_block": [block], "_island": pa.array([island], pa.int32()), "n_bins": pa.array([fit[0]], pa.int32()), "fitness": [fit[1]], "packing": pa.array([where], pa.list_(pa.int32()))})

    def begin(key, rows):
        return result(key, _ordered(rows).column("length").to_pylist(), [], 0)

    def go_on(epoch: int):
        def run(key, rows, elites):
            packings = elites.sort_by([("n_bins", "ascending"), ("fitness", "ascending")]).column("packing").to_pylist()
            return result(key, _ordered(rows).column("length").to_pylist(), packings, epoch)

        return run

    elites = stored(wide.groupBy("_block", "_island").applyInArrow(begin, kind), "elites")
    for epoch in range(1, EPOCHS):
        # each island goes on with its own elite and that of its neighbour
        guests = elites.withColumn("_island", ((F.col("_island") + 1) % ISLANDS).cast("int"))
        pool = elites.union(guests).groupBy("_block", "_island")
        elites = stored(wide.groupBy("_block", "_island").cogroup(pool).applyInArrow(go_on(epoch), kind), "elites")

    def settle(key, rows, best):
        rows = _ordered(rows)
        top = best.sort_by([("n_bins", "ascending"), ("fitness", "ascending"), ("_island", "ascending")])
        where, size = top.column("packing")[0].as_py(), rows.column("length").to_pylist()
        load, offset = [0] * (max(where) + 1), []
        for b, n in zip(where, size, strict=True):
            offset.append(load[b])
            load[b] += n
        rows = rows.append_column("_bin", pa.array(where, pa.int32())).append_column("_load", pa.array([load[b] for b in where], pa.int64()))
        return rows.append_column("offset", pa.array(offset, pa.int64()))

    out = f"{_PIECES}, _row long, _block long, _bin int, _load long, offset long"
    return stored(items.groupBy("_block").cogroup(elites.groupBy("_block")).applyInArrow(settle, out), "packed")


def _blocks(items: DataFrame, block: int) -> tuple[DataFrame, int]:
    n = items.count()
    blocks = max(1, -(-n // block))
    return items.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks))), (blocks if n else 0)


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. ``pieces``: doc_id, piece, start, length (1 to capacity), ids_crc32."""
    told = stored(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    names = [c.split()[0] for c in _PIECES.split(", ")]
    done = [told.filter(F.col("length") >= capacity).select(*names, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    items, level = told.filter(F.col("length") < capacity), 0
    while True:
        dealt, blocks = _blocks(items, block)
        if not blocks:
            break
        packed = _pack_level(dealt, level, capacity)
        number = F.lit(level << 56) + F.shiftleft(F.col("_block"), 20) + F.col("_bin")
        settled = packed if blocks == 1 else packed.filter(F.col("_load") >= int(GOOD * capacity))
        done.append(settled.select(*names, number.alias("sequence_id"), "offset"))
        if blocks == 1:
            break
        left = packed.filter(F.col("_load") < int(GOOD * capacity)).select(*names, "_row")
        # packing again only helps while it brings fewer blocks together
        if -(-left.count() // block) >= blocks:
            done.append(packed.filter(F.col("_load") < int(GOOD * capacity)).select(*names, number.alias("sequence_id"), "offset"))
            break
        items, level = left, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Nulls: a null text is the empty text, a single end token; a null id is kept. Repeated rows are packed each. Equal
    lengths are ordered by id. An empty table gives no rows. Documents of any length are cut, never dropped. Only the id
    and the text are read, so other names cannot clash.
    """
    return pack(tokenised(docs, capacity, vocabulary, id_col, text_col), capacity)


def op6_grouping_genetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op6_grouping_genetic": op6_grouping_genetic}
ORACLE: dict[str, str] = {}
