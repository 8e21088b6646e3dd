"""Sharding by a keyed permutation of global row numbers (DataFrame functions only).

Rows are numbered 0..N-1 in the order of (doc_id, text checksum, size). A generalised Feistel network over
Z_a x Z_b with a*b >= N permutes those numbers; values that leave 0..N-1 walk the cycle until they are back. The
permuted number p gives shard ``p % shards`` and slot ``p div shards``, so shard counts differ by one at most and
anyone who knows (N, key) can compute where row r went, or which row lies in a slot, without the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored, table

PRIME = 2_147_483_647
ROUNDS = 6
SHARDS = 24
KEY = 20_240_607
#: Cycle steps that one expression unrolls; the loop adds more while any row is still outside.
UNROLL = 3


def sides(n: int) -> tuple[int, int]:
    """The two radices: a*b >= n and a*b - n < a, so few values ever leave the range."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def round_keys(key: int, rounds: int = ROUNDS) -> list[int]:
    out = []
    for i in range(rounds):
        key = (key * 48_271 + 11 * i + 7) % PRIME
        out.append(key)
    return out


def mix(x: int, k: int) -> int:
    """The round function: two squarings modulo a prime below 2**31, so products fit a signed 64-bit integer."""
    t = (x + k) % PRIME
    t = (t * t + k) % PRIME
    return (t * t + x) % PRIME


def permute_once(x: int, n: int, key: int = KEY) -> int:
    """One pass of the network over Z_a x Z_b (plain integers, for tests and for looking up single rows)."""
    a, b = sides(n)
    left, right = x // b, x % b
    for i, k in enumerate(round_keys(key)):
        if i % 2 == 0:
            left = (left + mix(right, k)) % a
        else:
            right = (right + mix(left, k)) % b
    return left * b + right


def permute(x: int, n: int, key: int = KEY) -> int:
    y = permute_once(x, n, key)
    while y >= n:
        y = permute_once(y, n, key)
    return y


def _div(x: Column, n: int) -> Column:
    """Whole quotient; the division is of a multiple, so it is exact up to 2**53."""
    return ((x - x % F.lit(n)) / F.lit(n)).cast("long")


def _turn(i: int, k: int, a: int, b: int):
    """Round ``i`` on a struct of the two halves."""

    def apply(s: Column) -> Column:
        src = s["r"] if i % 2 == 0 else s["l"]
        t = (src + F.lit(k)) % PRIME
        t = (t * t + F.lit(k)) % PRIME
        t = (t * t + src) % PRIME
        if i % 2 == 0:
            return F.struct(((s["l"] + t) % F.lit(a)).alias("l"), s["r"].alias("r"))
        return F.struct(s["l"].alias("l"), ((s["r"] + t) % F.lit(b)).alias("r"))

    return apply


def _step(x: Column, n: int, key: int) -> Column:
    """One pass of the network over the halves of x. One-element transforms bind each round's halves by name."""
    a, b = sides(n)
    state = F.array(F.struct(_div(x, b).alias("l"), (x % F.lit(b)).alias("r")))
    for i, k in enumerate(round_keys(key)):
        state = F.transform(state, _turn(i, k, a, b))
    return F.transform(state, lambda s: s["l"] * F.lit(b) + s["r"])[0]


def numbered(rows: DataFrame, order: list[str], name: str = "row") -> tuple[DataFrame, int]:
    """``rows`` with gapless numbers from 0 in the given order, and their count.

    A range sort deals the rows out; each partition numbers its own and adds the counts before it, so no task sees
    more than its range. Rows that agree in all ``order`` columns are interchangeable.
    """
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    ranged = ranged.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    at = F.monotonically_increasing_id()
    kept = stored(ranged.withColumn("_at", at), "numbered")
    kept = kept.select("*", F.shiftright("_at", 33).alias("_part"))
    # a row for each partition, however many rows there are
    parts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n"))
    total = int(parts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    out = kept.join(parts.select("_part", "_before"), "_part").withColumn(name, local + F.col("_before"))
    return out.drop("_at", "_part", "_before"), total


def feistel_shards(docs: DataFrame, shards: int = SHARDS, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, row, permuted, shard, slot) for every row.

    Nulls: a null text counts as no bytes (size 8, checksum 0); a null id sorts first. Repeated rows each get a slot of
    their own. An empty table gives no rows. Other columns of ``docs`` are not read, so their names cannot clash.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows, n = numbered(slim, ["doc_id", "text_crc32", "size"])
    if not n:
        return rows.select("doc_id", "size", "text_crc32", "row", F.col("row").alias("permuted"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    at = rows.withColumn("permuted", _step(F.col("row"), n, key))
    while True:
        for _ in range(UNROLL):
            at = at.withColumn("permuted", F.when(F.col("permuted") >= n, _step(F.col("permuted"), n, key)).otherwise(F.col("permuted")))
        if at.agg(F.max("permuted")).first()[0] < n:
            break
    return at.withColumn("shard", (F.col("permuted") % shards).cast("int")).withColumn("slot", _div(F.col("permuted"), shards))


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feistel_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc32_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes; ``tab`` is the 256-entry table that the query derives from the polynomial."""
    utf8 = (
        "CASE WHEN unicode(c) < 128 THEN [unicode(c)] WHEN unicode(c) < 2048 THEN [192 + unicode(c) // 64, 128 + unicode(c) % 64] "
        "WHEN unicode(c) < 65536 THEN [224 + unicode(c) // 4096, 128 + unicode(c) // 64 % 64, 128 + unicode(c) % 64] "
        "ELSE [240 + unicode(c) // 262144, 128 + unicode(c) // 4096 % 64, 128 + unicode(c) // 64 % 64, 128 + unicode(c) % 64] END"
    )
    chars = f"CASE WHEN coalesce({text}, '') = '' THEN []::VARCHAR[] ELSE string_split({text}, '') END"
    data = f"flatten(list_transform({chars}, lambda c: {utf8}))"
    return f"xor(list_reduce(list_transform({data}, lambda v: v::BIGINT), lambda s, v: xor(s >> 8, tab[(xor(s, v) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def _oracle() -> str:
    def rounds(src: str, name: str) -> str:
        """CTEs that take (l, r) of ``src`` through the rounds."""
        out, before = [], src
        for i, k in enumerate(round_keys(KEY)):
            x = "r" if i % 2 == 0 else "l"
            t = f"((({x} + {k}) % {PRIME}) * (({x} + {k}) % {PRIME}) + {k}) % {PRIME}"
            out.append(f"{name}{i}t AS (SELECT *, {t} AS t FROM {before})")
            new = f"((t * t + {x}) % {PRIME})"
            cols = f"(l + {new}) % a AS l, r" if i % 2 == 0 else f"l, (r + {new}) % b AS r"
            out.append(f"{name}{i} AS (SELECT doc_id, size, text_crc32, n, a, b, done, x, {cols} FROM {name}{i}t)")
            before = f"{name}{i}"
        return ", ".join(out)

    parts, before = [], "start"
    for w in range(12):
        parts.append(f"w{w}s AS (SELECT doc_id, size, text_crc32, n, a, b, done, x, x // b AS l, x % b AS r FROM {before})")
        parts.append(rounds(f"w{w}s", f"w{w}_"))
        parts.append(f"w{w} AS (SELECT doc_id, size, text_crc32, n, a, b, done OR l * b + r < n AS done, CASE WHEN done THEN x ELSE l * b + r END AS x FROM w{w}_{ROUNDS - 1})")
        before = f"w{w}"
    step = "CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END"
    return f"""
WITH polynomial AS (SELECT list(list_reduce(range(8), lambda s, k: {step}, i::BIGINT) ORDER BY i) AS tab FROM range(256) AS g(i)),
slim AS (SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size, {_crc32_sql('text')} AS text_crc32 FROM documents, polynomial),
sides AS (SELECT count(*) AS n, greatest(1, floor(sqrt(greatest(count(*), 1) - 1))::BIGINT + 1) AS a FROM slim),
start AS (SELECT doc_id, size, text_crc32, n, a, greatest(1, (n + a - 1) // a) AS b, false AS done,
  row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS x FROM slim, sides),
{', '.join(parts)}
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {SHARDS})::INTEGER AS shard, x // {SHARDS} AS slot, NULL::INTEGER AS grown_shard FROM {before}"""


QUERIES = {"op7_feistel_shards": op7_feistel_shards}
ORACLE = {"op7_feistel_shards": _oracle()}
