"""A stored full-text index with fuzzy search: words within two edits are found by equi joins.

Two tables: postings (token, node_id, n, positions), and the neighbourhood (key, token) of the distinct tokens. A token of up to
``LONG`` characters is under every text that up to two deletions leave of its first ``PREFIX`` characters, at most 29 of them; two words
within two edits have one of those in common: what pairs their letters leaves out two of either word at most, and of either beginning too,
as a pair that only one beginning holds stands for a letter left out before it. A longer token is under its three parts, with its length and the part's number: two edits leave one part as it is, at most
two places away. What shares a key is then compared exactly. All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch

EDITS, LONG, PREFIX = 2, 20, 7


@dataclass
class FulltextIndex:
    postings: DataFrame
    neighbours: DataFrame


def token_list(text: Column) -> Column:
    """The lower-cased runs of letters and digits of a text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _without(word: Column, i: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))


def deletions(word: Column) -> Column:
    """A word and what one or two deletions leave of it, each once. A one-element transform binds each intermediate by name."""
    none = F.array().cast("array<string>")
    one = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: _without(w, i))).otherwise(none)
    two = lambda d: F.array_distinct(F.concat(d, F.flatten(F.transform(d, one))))
    return F.array_union(F.array(word), F.transform(F.array(F.array_distinct(one(word))), two)[0])


def near_keys(word: Column) -> Column:
    """The keys of a word of up to ``LONG`` characters, and those under which it is looked up."""
    return deletions(F.substring(word, 1, PREFIX))


def _part(k: int, length: Column) -> tuple[Column, Column]:
    """Where the k-th of three parts of a word of some length begins, and its length."""
    third = F.floor(length / 3).cast("int")
    return third * k + 1, F.lit(third) if k < 2 else length - 2 * third


def _part_key(k: int, length: Column, text: Column) -> Column:
    return F.concat_ws(":", F.lit(" "), length.cast("string"), F.lit(str(k)), text)


def parts(word: Column) -> Column:
    """The keys of a long word."""
    n = F.length(word)
    return F.array(*[_part_key(k, n, F.substring(word, *_part(k, n))) for k in range(EDITS + 1)])


def parts_near(word: Column) -> Column:
    """The keys under which a long word within two edits of ``word`` would lie."""
    shift = F.sequence(F.lit(-EDITS), F.lit(EDITS))

    def of(k: int, by: Column) -> Column:
        length = F.length(word) + by
        begin, size = _part(k, length)
        return F.transform(shift, lambda s: _part_key(k, length, F.substring(word, F.greatest(begin + s, F.lit(1)), size)))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(-EDITS), F.lit(EDITS)), lambda by: F.flatten(F.array(*[of(k, by) for k in range(EDITS + 1)])))))


def _posted(at: Column) -> Column:
    """The tokens of an array of (token, position), each once: (token, n, positions). Sorted, a token's places are a run.

    A one-element transform binds the sorted array and the beginnings of its runs, as in ``deletions``.
    """
    same = lambda s, i: F.get(s, i - 1)["token"] == F.get(s, i)["token"]
    begins = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | ~same(s, i))

    def run(s: Column, begin: Column, end: Column) -> Column:
        return F.struct(F.get(s, begin)["token"].alias("token"), (end - begin).cast("long").alias("n"), F.transform(F.slice(s, begin + 1, end - begin), lambda x: x["position"]).alias("positions"))

    runs = lambda s: F.transform(F.array(begins(s)), lambda b: F.transform(b, lambda at_, k: run(s, at_, F.coalesce(F.get(b, k + 1), F.size(s)))))[0]
    return F.flatten(F.transform(F.filter(F.array(F.array_sort(at)), lambda s: F.size(s) > 0), runs))


def build(nodes: DataFrame, id_col: str, columns: list[str], path: str | None = None) -> FulltextIndex:
    """The index of the words of some columns, below ``path``. Rows of one id are one text; null columns have no words."""
    spark = nodes.sparkSession
    path = path or scratch(spark, "fulltext")
    # a node's rows come together as texts, which is less than its postings; these are then made within its row
    own = nodes.groupBy(F.col(id_col).alias("node_id")).agg(F.collect_list(F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)])).alias("texts"))
    words = lambda t: F.flatten(F.array(*[token_list(t[f"c{k}"]) for k in range(len(columns))]))
    at = F.flatten(F.transform("texts", lambda t: F.transform(words(t), lambda w, i: F.struct(w.alias("token"), i.alias("position")))))
    rows = own.select("node_id", F.explode(_posted(at)).alias("p")).select("p.token", "node_id", "p.n", "p.positions")
    rows.write.parquet(f"{path}/postings")
    postings = spark.read.schema(rows.schema).parquet(f"{path}/postings")
    tokens = postings.groupBy("token").agg(F.count(F.lit(1)).alias("nodes"))
    keys = F.when(F.length("token") <= LONG, near_keys(F.col("token"))).otherwise(parts(F.col("token")))
    near = tokens.select(F.explode(keys).alias("key"), "token", "nodes")
    near.write.parquet(f"{path}/neighbours")
    return FulltextIndex(postings, spark.read.schema(near.schema).parquet(f"{path}/neighbours"))


def matches(index: FulltextIndex, words: DataFrame, edits: int = EDITS) -> DataFrame:
    """(word, token, distance): the tokens within ``edits``, at most two, of each of ``words`` (word), lower-cased."""
    if not 0 <= edits <= EDITS:
        raise ValueError(f"the index holds up to {EDITS} edits")
    asked = words.select(F.lower("word").alias("word")).filter("word IS NOT NULL").distinct()
    short = F.when(F.length("word") <= LONG + EDITS, near_keys(F.col("word"))).otherwise(F.array().cast("array<string>"))
    long = F.when(F.length("word") > LONG - EDITS, parts_near(F.col("word"))).otherwise(F.array().cast("array<string>"))
    keys = asked.select("word", F.explode(F.array_union(short, long)).alias("key"))
    both = keys.join(index.neighbours, "key").select("word", "token").distinct()
    return both.withColumn("distance", F.levenshtein("token", "word", edits)).filter("distance >= 0")


def search(index: FulltextIndex, words: DataFrame, edits: int = EDITS) -> DataFrame:
    """(node_id, hits, edits): nodes that have a token within ``edits`` of every word; how many places match some word, each
    counted once a word, and the sum of each word's least distance."""
    asked = words.select(F.lower("word").alias("word")).filter("word IS NOT NULL").distinct()
    found = matches(index, asked, edits)
    per = index.postings.join(found, "token").groupBy("node_id", "word").agg(F.sum("n").alias("hits"), F.min("distance").alias("edits"))
    all_ = per.groupBy("node_id").agg(F.count(F.lit(1)).alias("_words"), F.sum("hits").alias("hits"), F.sum("edits").alias("edits"))
    total = asked.agg(F.count(F.lit(1)).alias("_total"))  # one row
    return all_.crossJoin(F.broadcast(total)).filter("_words = _total").select("node_id", "hits", "edits")
