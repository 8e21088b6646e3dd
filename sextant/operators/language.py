"""The language of a text, by the words that labelled texts of each language use."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Words kept of each language, its most frequent ones, and languages at most: a bound of the model's size.
PER_LANGUAGE, LANGUAGES = 1000, 200


def learned(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> dict[str, tuple[int, dict[str, int]]]:
    """For each language of labelled documents its number of words and how often its most frequent ones occur, ties by word."""
    words = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    top = counts.withColumn("_k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("_k") <= per_language)
    out: dict[str, tuple[int, dict[str, int]]] = {lang: (n, {}) for lang, n in sorted(totals.items())}
    for r in top.filter(F.col("lang").isin(list(totals))).collect():
        out[r["lang"]][1][r["word"]] = r["n"]
    return out


def detected(rows: DataFrame, model: dict[str, tuple[int, dict[str, int]]], text_col: str = "text", name: str = "detected") -> DataFrame:
    """``rows`` with the language whose words make the text likeliest, the first by name of equals; null for a text without a
    letter and for a null text."""
    # a word that a language's list lacks counts as half an occurrence
    weights = {lang: ({w: math.log(n / total) for w, n in words.items()}, math.log(0.5 / total)) for lang, (total, words) in model.items()}
    letters = re.compile(r"[^\W\d_]+")

    def one(text: str | None) -> str | None:
        words = letters.findall(text.lower()) if text else []
        if not words or not weights:
            return None
        score = {lang: math.fsum(w.get(x, none) for x in words) for lang, (w, none) in weights.items()}
        return max(sorted(score), key=score.get)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=object)

    return rows.withColumn(name, run(text_col))
