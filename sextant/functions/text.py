"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that end a fulltext term, languages preferred for labels (in this order).
FULLTEXT_SPECIAL = r'[+\-!(){}\[\]^"~*?:\\/]'
PREFERRED_LANGUAGES = ["en", "en-gb", "en-ca", "de", "fr", "es", "it", "pt", "ru", "zh-hans", "zh-hant", "ja", "ko", "ar", "hi"]


def strip(c: Column) -> Column:
    """All leading and trailing white space, not only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def newlines(c: Column) -> Column:
    """Line ends as \\n, then spaces trimmed at both ends."""
    return F.trim(F.regexp_replace(c, r"\r\n?", "\n"))


def clean(c: Column) -> Column:
    """Runs of blanks to one, three or more line ends to two, consent notices out, stripped."""
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"(?id)(cookie|consent|analytics).{0,40}", ""))


def word_count(c: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(c, F.lit("")), r"\s+"), ""))


def normal(c: Column) -> Column:
    """Lower case, hyphens and underscores as spaces, runs of white space as one."""
    return F.lower(F.trim(F.regexp_replace(F.translate(c, "-_", "  "), r"\s+", " ")))


def predicate(c: Column) -> Column:
    """A relation name as an upper-case identifier."""
    c = F.regexp_replace(strip(c), "^[\"'`]+|[\"'`]+$", "")
    c = F.regexp_replace(c, r"[-\s]+", "_")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}_]", "")
    return F.upper(F.regexp_replace(F.regexp_replace(c, "_+", "_"), "^_+|_+$", ""))


def entity_id(c: Column) -> Column:
    """The bare id of ``wd:Q1``, ``http://host/Q1`` or `` Q1 ``; null if nothing is left."""
    c = strip(c)
    c = F.when(c.startswith("wd:"), F.substring(c, 4, 1 << 30)).otherwise(c)
    return blank_to_null(F.when(c.startswith("http"), F.substring_index(c, "/", -1)).otherwise(c))


def fulltext_terms(c: Column) -> Column:
    """``w~2 AND ...`` over the words of a query; '' for none."""
    w = F.array_remove(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), FULLTEXT_SPECIAL, " "), r"\s+"), "")
    return F.array_join(F.transform(w, lambda x: F.concat(x, F.lit("~2"))), " AND ")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def registered_domain(url: Column) -> Column:
    """The last two labels of the host (no public-suffix list is at hand)."""
    return F.substring_index(host(url), ".", -2)


def number_in(name: Column, default: int | None = None) -> Column:
    """The last run of digits of a name (``batch_12.parquet``) as a number."""
    found = F.regexp_extract(name, r"(\d+)\D*$", 1).try_cast("int")
    return found if default is None else F.coalesce(found, F.lit(default))


def without_surrogates(text: str | None) -> str | None:
    """For texts that come from Python: lone surrogates, which no UTF-8 string can hold, are left out."""
    return text.encode("utf-8", "ignore").decode("utf-8") if isinstance(text, str) else text


def chunks(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text", metadata: list[str] | None = None) -> DataFrame:
    """Sliding windows of white-space tokens: (id, chunk_index, chunk, chunk_id); the last window stops at the end. Each chunk
    inherits the columns ``metadata`` of its document, if any, as strings in a struct, nulls as ''.

    A null or blank text gives no chunk. One row per document becomes its chunks without a shuffle.
    """
    inherited = [F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in metadata]).alias("metadata")] if metadata else []
    own = ["metadata"] if metadata else []
    tokens = docs.select(F.col(id_col), *inherited, F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), "").alias("_t"))
    stride = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size("_t") - size) / F.lit(stride))).cast("int")
    at = tokens.filter(F.size("_t") > 0).select(id_col, *own, "_t", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    text = F.array_join(F.slice("_t", F.col("chunk_index") * stride + 1, size), " ")
    out = at.select(id_col, *own, "chunk_index", text.alias("chunk"))
    key = F.md5(F.concat_ws("_", F.col(id_col).cast("string"), F.col("chunk_index").cast("string"), F.substring("chunk", 1, 20)))
    return out.withColumn("chunk_id", key)


def token_chunks(docs: DataFrame, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same windows over the tokens of a tokenizer that the caller passes in: (id, chunk_index, chunk, tokens), in Arrow batches.

    A document's tokens are made once; a null or empty text gives no chunk. A character that a window's edge cuts in two is
    what ``decode`` makes of its part.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("coalesce(text, '') <> ''")
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = encode(text)
                for k, at in enumerate(range(0, max(len(ids) - overlap, 1), size - overlap)):
                    rows.append((i, k, decode(ids[at : at + size]), len(ids[at : at + size])))
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "chunk", "tokens"])

    return own.mapInPandas(run, f"id {kind}, chunk_index int, chunk string, tokens int").withColumnRenamed("id", id_col)
