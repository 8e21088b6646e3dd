"""What is asked of retrieval and of the writer: retrieval strings, selections, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Words that are no locations; what is removed from captions.
STOP_LOCATIONS = ["city", "region", "country"]
CAPTION_DROPS = ["people", "person"]


def cleaned_caption(caption: Column) -> Column:
    """Without the dropped words, wherever they stand, also inside others."""
    for word in CAPTION_DROPS:
        caption = F.replace(caption, F.lit(word), F.lit(""))
    return T.strip(caption)


def keyword_string(keywords: Column) -> Column:
    """Distinct keywords in code-point order."""
    return F.array_join(F.array_sort(F.array_distinct(keywords)), " ")


def retrieval_string(caption: Column, keywords: Column, question: Column, locations: Column | None = None) -> Column:
    """Caption and keywords, commas as spaces; the question where either is missing. Locations follow."""
    both = F.coalesce((caption != "") & (F.size(keywords) > 0), F.lit(False))
    out = F.when(both, F.replace(F.concat(caption, F.lit(" "), keyword_string(keywords)), F.lit(","), F.lit(" "))).otherwise(question)
    return out if locations is None else F.concat(out, F.array_join(F.transform(F.coalesce(locations, F.array().cast("array<string>")), lambda x: F.concat(F.lit(" "), x)), ""))


def selection(ranked: DataFrame) -> DataFrame:
    """One row with ``top3``: "1", "2", "3" -> (name, description, reasoning) of the first three of ``ranked`` (rank, name, description, score)."""
    reason = F.format_string("Score=%.4f", "score")
    rows = ranked.filter("rank <= 3").select(F.struct(F.col("rank").cast("string").alias("key"), F.struct(F.coalesce("name", F.lit("Unknown")).alias("name"), F.coalesce("description", F.lit("")).alias("description"), reason.alias("reasoning")).alias("value")).alias("e"))
    return rows.agg(F.map_from_entries(F.sort_array(F.collect_list("e"))).alias("top3"))


def candidate_lines(ranked: DataFrame) -> DataFrame:
    """(rank, line): the list of candidates that a prompt shows, a line each."""
    return ranked.select("rank", F.format_string("- %s (%s) Score=%.4f", F.coalesce("label", F.lit("None")), "qid", "score").alias("line"))


def prompt(template: str, **parts: Column) -> Column:
    """A template with ``{name}`` places filled in; null parts are empty."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
