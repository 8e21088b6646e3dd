"""Exact deduplication by two-pass Bloom filtering (DataFrame functions only).

The texts are read once: each row's digest, 32 bytes, and its id are stored, and everything below works on those. The first
pass counts how many rows hit each slot of a Bloom filter, two slots a row, and keeps the slots hit by two rows or more as
bitmaps of 4 KiB, the filter's blocks. The second pass asks every row whether both its slots are kept. A text that occurs
twice has hit its slots twice, so none is missed; of the others about one in ``0.25 * PER_ROW**2`` is taken along. Only rows
that pass shuffle, by their whole digest; all others are alone and go straight to the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table

#: Slots of the filter for each row: of texts that occur once, (1 - exp(-2 / 16))**2 = 1.4 % pass.
PER_ROW = 16
#: Slots of a block, and its bytes: what ``bitmap_construct_agg`` makes.
BLOCK, BLOCK_BYTES = 32_768, 4_096
#: The filter is broadcast up to this size, which is counted; beyond it, ids and digests are dealt to its blocks.
BROADCAST_BYTES = 32 << 20
#: A digest or a slot is hot if it holds more than one of so many rows: there are at most twice that many such slots.
HOT_SHARE = 1_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null is the empty text. ASCII texts take the faster function."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha): the digest of each row's normalised text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha"))


def blocks_for(rows: int) -> int:
    """Blocks of a filter with ``PER_ROW`` slots a row, a power of two."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows * PER_ROW / BLOCK))))


def places(sha: Column, blocks: int) -> Column:
    """(block, first, second) of a digest: two different slots of one block."""
    h = F.xxhash64(sha)
    first = F.shiftrightunsigned(h, 49).cast("int")
    step = (F.shiftrightunsigned(h, 34).bitwiseAND(F.lit(BLOCK - 1)) % (BLOCK - 1) + 1).cast("int")
    return F.struct(h.bitwiseAND(F.lit(blocks - 1)).alias("block"), first.alias("first"), first.bitwiseXOR(step).alias("second"))


def _is_set(bits: Column, slot: Column) -> Column:
    """Whether a bitmap has the slot's bit; null bitmaps have none."""
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(slot, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, slot.bitwiseAND(F.lit(7))) == 1, F.lit(False))


def slot_counts(rows: DataFrame, blocks: int) -> DataFrame:
    """First pass: (block, slot, hits) of the slots that several rows hit. Counts combine before the shuffle, so a text that
    a third of all rows share is one count a task."""
    at = rows.select(places(F.col("sha"), blocks).alias("p"))
    at = at.select("p.block", F.explode(F.array("p.first", "p.second")).alias("slot"))
    return at.groupBy("block", "slot").agg(F.count(F.lit(1)).alias("hits")).filter("hits > 1")


def bloom(slots: DataFrame) -> DataFrame:
    """(block, bits): the slots as bitmaps."""
    return slots.groupBy("block").agg(F.bitmap_construct_agg(F.col("slot").cast("long")).alias("bits"))


def possibly_repeated(rows: DataFrame, slots: DataFrame, bits: DataFrame, n: int, blocks: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Second pass: ``rows`` with ``maybe``: whether both slots of the row are hit by several, which ``bits`` (block, bits) tell.

    A filter of at most ``broadcast_bytes``, counted, is sent to the rows. For a larger one the rows' ids and digests are dealt
    to its blocks; rows at a hot slot, of which there are few, are taken along unasked, so no block draws a hot text.
    """
    asked = rows.withColumn("_p", places(F.col("sha"), blocks))
    hit = _is_set(F.col("bits"), F.col("_p.first")) & _is_set(F.col("bits"), F.col("_p.second"))
    if bits.count() * BLOCK_BYTES <= broadcast_bytes:
        joined = asked.join(F.broadcast(bits), F.col("_p.block") == F.col("block"), "left")
        return joined.select("doc_id", "sha", hit.alias("maybe"))
    hot = slots.filter(F.col("hits") > n // HOT_SHARE + 1).select(F.col("block").alias("_b"), F.col("slot").alias("_s"), F.lit(True).alias("_hot"))
    marked = asked.join(F.broadcast(hot), (F.col("_p.block") == F.col("_b")) & (F.col("_p.first") == F.col("_s")), "left")
    marked = marked.select("doc_id", "sha", "_p", F.coalesce("_hot", F.lit(False)).alias("_hot"))
    dealt = marked.filter("NOT _hot").join(bits, F.col("_p.block") == F.col("block"), "left").select("doc_id", "sha", hit.alias("maybe"))
    return dealt.union(marked.filter("_hot").select("doc_id", "sha", F.lit(True)))


def groups_of(rows: DataFrame, n: int) -> DataFrame:
    """(doc_id, sha, keep_id, group_size) of rows that may be repeated. Groups are counted before the shuffle; the few that hold
    more than one in ``HOT_SHARE`` of all rows, fewer than that many, are broadcast back and the others are joined by digest."""
    groups = stored(rows.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    large = F.col("group_size") > n // HOT_SHARE + 1
    hot, rest = groups.filter(large), groups.filter(~large)
    there = rows.join(F.broadcast(hot), "sha")
    others = rows.join(F.broadcast(hot.select("sha")), "sha", "left_anti").join(rest, "sha")
    cols = ["doc_id", "sha", "keep_id", "group_size"]
    return there.select(*cols).union(others.select(*cols))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row: texts are equal if they are after lower-casing A-Z.

    Nulls: a null text is the empty text. A null id is smaller than any other; if a group has no other, its rows' ``keep_id`` is
    null and they are kept. Repeated rows count each in ``group_size`` and, having one id, are all kept or all dropped (see
    ``drop_copies``). An empty table gives no rows; texts of any length are read whole. Only id and text are read, so other
    names cannot clash.
    """
    rows = stored(digests(docs, id_col, text_col), "digests")
    n = rows.count()
    blocks = blocks_for(n)
    slots = stored(slot_counts(rows, blocks), "slots")
    bits = stored(bloom(slots), "bloom")
    asked = stored(possibly_repeated(rows, slots, bits, n, blocks, broadcast_bytes), "asked")
    discard(rows, slots, bits)
    alone = asked.filter("NOT maybe").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    all_ = alone.union(groups_of(asked.filter("maybe").select("doc_id", "sha"), n))
    return all_.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text a row of a larger id has too; rows of one id and text leave one. All columns stay."""
    gone = exact_groups(docs, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias("_gone"), F.unhex("text_sha256").alias("_sha"))
    own = docs.withColumn("_sha", F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    kept = own.join(gone, own[id_col].eqNullSafe(gone["_gone"]) & (own["_sha"] == gone["_sha"]), "left_anti")
    return kept.dropDuplicates([id_col, "_sha"]).select(*docs.columns)


def op12_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


_TEXT = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
QUERIES = {"op12_bloom_dedup": op12_bloom_dedup}
ORACLE = {
    "op12_bloom_dedup": f"""
WITH t AS (SELECT doc_id, sha256({_TEXT}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)"""
}
