"""Mentions of known names in texts: names of any length, whole texts, every place.

Texts and names are runs of letters, digits and underscores; what stands between them does not count, nor does case. A name is
mentioned where its tokens follow each other in a text. Names of up to ``BROADCAST_BYTES``, counted, become a token trie that
is compiled once on the driver and walked in the tasks. Of more names than that, those with a token that no text holds are left
out first, as nothing can mention them; what is still too much meets the texts in a join on each name's rarest token. All ways
give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .questions import STOP_LOCATIONS

BROADCAST_BYTES = 16 << 20
_END = ""


def tokens(text: Column) -> Column:
    """The tokens of a text in order, case folded; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def known_names(names: DataFrame, stop: list[str] = STOP_LOCATIONS) -> DataFrame:
    """(location, key): distinct names (name) with their tokens; without those that have none or are stop locations."""
    rows = names.select(F.col("name").alias("location")).distinct().withColumn("key", tokens(F.col("location")))
    return rows.filter((F.size("key") > 0) & ~F.array_join("key", " ").isin(stop))


def compiled(names: list[tuple[str, list[str]]]) -> dict:
    """A trie: token -> node; a node's names, if any, are under the empty token."""
    root: dict = {}
    for name, key in names:
        node = root
        for t in key:
            node = node.setdefault(t, {})
        node.setdefault(_END, []).append(name)
    return root


def walked(words: list[str], trie: dict) -> dict[str, int]:
    """How often each name begins at some token."""
    found: dict[str, int] = {}
    for i, w in enumerate(words):
        node, j = trie.get(w), i
        while node is not None:
            for name in node.get(_END, ()):
                found[name] = found.get(name, 0) + 1
            j += 1
            node = node.get(words[j]) if j < len(words) else None
    return found


def _bytes(names: DataFrame) -> int:
    """About what the trie of some names takes."""
    return names.agg(F.coalesce(F.sum(F.octet_length("location") + 2 * F.octet_length(F.array_join("key", " ")) + 64), F.lit(0))).first()[0]


def mentions(texts: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """(id, location, n): each name of ``names`` (name) that a text mentions and at how many places, overlapping ones too.

    Null and empty texts mention nothing. Rows of one id are counted each.
    """
    known = known_names(names)
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    if _bytes(known) > limit:
        known = settled(possible(rows, known))
        if _bytes(known) > limit:
            return joined(rows, known, limit)
    shared = texts.sparkSession.sparkContext.broadcast(compiled([(r["location"], r["key"]) for r in known.select("location", "key").collect()]))

    # no Arrow: its batches of 10,000 texts take gigabytes as lists of tokens
    @F.udf("array<struct<location:string,n:long>>", useArrow=False)
    def found(words: list[str]) -> list[tuple[str, int]]:
        return list(walked(words, shared.value).items())

    # rows of an id are counted together, whatever rows it had
    hits = rows.select("id", F.explode(found(tokens(F.col("text")))).alias("f")).select("id", "f.location", "f.n")
    return hits.groupBy("id", "location").agg(F.sum("n").alias("n"))


def possible(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(location, key, place, anchor): the names all of whose tokens some text of ``rows`` (text) holds, with the rarest of them."""
    seen = rows.select(F.explode(tokens(F.col("text"))).alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("seen"))
    parts = known.select("location", "key", F.posexplode("key").alias("place", "anchor")).join(seen, "anchor")
    own = parts.groupBy("location").agg(F.any_value("key").alias("key"), F.count(F.lit(1)).alias("_n"), F.min(F.struct("seen", "place", "anchor")).alias("r"))
    return own.filter(F.col("_n") == F.size("key")).select("location", "key", "r.place", "r.anchor")


def joined(rows: DataFrame, known: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``mentions`` for names without a bound (``possible``): a name meets the texts (id, text) at its anchor.

    Only tokens that are anchors leave their text, each with the token before and after it; where that does not settle a name, its
    place is looked up in the text. An anchor that is frequent nevertheless is split by adaptive execution like any skewed join key.
    """
    at = rows.select("id", tokens(F.col("text")).alias("words")).select("id", F.posexplode("words").alias("at", "anchor"), "words")
    at = at.select("id", "at", "anchor", F.get("words", F.col("at") - 1).alias("before"), F.get("words", F.col("at") + 1).alias("after"))
    wanted = known.select("anchor").distinct()
    if (wanted.agg(F.sum(F.octet_length("anchor") + 16)).first()[0] or 0) <= limit:
        wanted = F.broadcast(wanted)
    near = at.join(wanted, "anchor", "left_semi").join(known, "anchor")
    last, key = F.col("place") == F.size("key") - 1, F.col("key")
    near = near.filter(((F.col("place") == 0) | (F.col("before") == F.get(key, F.col("place") - 1))) & (last | (F.col("after") == F.get(key, F.col("place") + 1))))
    near = near.select("id", (F.col("at") - F.col("place")).alias("begin"), "location", "key", ((F.col("place") <= 1) & (F.size("key") - F.col("place") <= 2)).alias("settled"))
    # two rows of an id may have a candidate at one place: it is looked up once in each of them
    open_ = near.filter("NOT settled AND begin >= 0").dropDuplicates(["id", "begin", "location"]).groupBy("id").agg(F.collect_list(F.struct("begin", "location", "key")).alias("c"))
    open_ = rows.join(open_, "id").select("id", tokens(F.col("text")).alias("words"), "c").select("id", "words", F.explode("c").alias("c"))
    open_ = open_.filter(F.slice("words", F.col("c.begin") + 1, F.size("c.key")) == F.col("c.key"))
    return near.filter("settled").select("id", "location").union(open_.select("id", "c.location")).groupBy("id", "location").agg(F.count(F.lit(1)).alias("n"))
