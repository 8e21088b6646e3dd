"""Nested records: entity JSON, fan-out to tools, state reducers, parallel lists, keyword lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PREFERRED_LANGUAGES, blank_to_null, entity_id

# Tools that each candidate is sent to and what each searches for, answers of a search without results, and words
# that are no keywords.
TOOLS = {
    "history": "history and historical importance of %s",
    "logistics": "how to travel to %s public transport parking",
    "culture": "local etiquette, safety tips, and current trends %s",
    "accommodation": "best hotels and hostels near %s",
    "food": "best local food and restaurants near %s",
}
NONE_FOUND = "No recent info found for: %s"
BLOCKED = "Search timed out or was blocked for query: %s"
STOP_KEYWORDS = ["people", "person"]

_VALUE = "map<string,struct<value:string>>"
_CLAIM = "array<struct<mainsnak:struct<snaktype:string,datavalue:struct<type:string,value:string>>>>"
ENTITY = f"labels {_VALUE}, descriptions {_VALUE}, sitelinks map<string,struct<title:string>>, claims map<string,{_CLAIM}>"


def _first_value(m: Column, field: str, keys: list[str] | None = None) -> Column:
    """The first non-empty field: of the given keys in order, or of any key."""
    if keys is not None:
        return F.coalesce(*[blank_to_null(F.try_element_at(m, F.lit(k))[field]) for k in keys])
    return F.try_element_at(F.filter(F.transform(F.map_values(m), lambda x: x[field]), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(1))


def _values(claims: Column, key: str, kind: str) -> Column:
    """The values of a claim that have one of the wanted type, in order."""
    all_ = F.coalesce(F.try_element_at(claims, F.lit(key)), F.array().cast(_CLAIM))
    hit = F.filter(all_, lambda c: F.coalesce((c["mainsnak"]["snaktype"] == "value") & (c["mainsnak"]["datavalue"]["type"] == kind), F.lit(False)))
    return F.transform(hit, lambda c: c["mainsnak"]["datavalue"]["value"])


def entity_fields(entities: DataFrame) -> DataFrame:
    """(qid, label, countries, locations, lat, lon, website) of raw entities (qid, json); rows whose JSON is no object are dropped."""
    e = entities.select("qid", F.from_json("json", ENTITY).alias("e")).filter("e IS NOT NULL AND e.labels IS NOT NULL").select("qid", "e.*")
    labels, descs, sites, claims = (F.col(c) for c in ("labels", "descriptions", "sitelinks", "claims"))
    site_title = F.replace(F.coalesce(_first_value(sites, "title", ["enwiki", "enwikivoyage", "enwikiquote"]), _first_value(sites, "title")), F.lit("_"), F.lit(" "))
    label = F.coalesce(_first_value(labels, "value", PREFERRED_LANGUAGES), _first_value(labels, "value"), _first_value(descs, "value", PREFERRED_LANGUAGES), _first_value(descs, "value"), site_title, F.lit(""))
    ids = lambda key: F.filter(F.transform(_values(claims, key, "wikibase-entityid"), lambda v: F.get_json_object(v, "$.id")), lambda v: v.isNotNull())
    place = F.try_element_at(_values(claims, "P625", "globecoordinate"), F.lit(1))
    official = F.try_element_at(F.filter(F.transform(_values(claims, "P856", "string"), lambda x: F.trim(x)), lambda v: v != ""), F.lit(1))
    codes = list(dict.fromkeys(["en", *[x.split("-")[0] for x in PREFERRED_LANGUAGES]]))
    page = lambda lang, title: F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"), F.replace(title, F.lit(" "), F.lit("_")))
    preferred = F.coalesce(*[F.when(F.coalesce(F.try_element_at(sites, F.lit(f"{c}wiki"))["title"], F.lit("")) != "", page(F.lit(c), F.try_element_at(sites, F.lit(f"{c}wiki"))["title"])) for c in codes])
    other = F.try_element_at(F.filter(F.map_entries(sites), lambda s: s["key"].endswith("wiki") & (F.coalesce(s["value"]["title"], F.lit("")) != "")), F.lit(1))
    any_wiki = page(F.regexp_replace(other["key"], "wiki$", ""), other["value"]["title"])
    return e.select(
        "qid",
        label.alias("label"),
        ids("P17").alias("countries"),
        ids("P131").alias("locations"),
        F.get_json_object(place, "$.latitude").try_cast("double").alias("lat"),
        F.get_json_object(place, "$.longitude").try_cast("double").alias("lon"),
        F.coalesce(official, preferred, any_wiki).alias("website"),
    )


def nested_id(doc: Column) -> Column:
    """The id in a graph document's source metadata; null where any part is missing or empty."""
    return blank_to_null(F.try_element_at(doc["source"]["metadata"], F.lit("qid")))


def with_columns(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the columns that are absent, as nulls; those that should be numbers become numbers, or null."""
    numbers = {c: F.col(c).try_cast(t) for c, t in columns.items() if c in rows.columns and t in ("double", "int", "long")}
    return rows.withColumns(numbers | {c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns})


def metadata(rows: DataFrame, columns: list[str], absent: dict[str, str]) -> Column:
    """A struct of string columns: nulls are empty strings; a column that is absent has its default in ``absent``, else null."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit(absent.get(c)).cast("string")
    return F.struct(*[known(c).alias(c) for c in columns])


def identifiers(documents: DataFrame, col: str = "value") -> DataFrame:
    """(ordinal, qid) of a JSON list of lists: the second element of each as a bare id, distinct, in order of first sight."""
    rows = documents.select(F.posexplode(F.from_json(col, "array<array<string>>")).alias("ordinal", "row"))
    ids = rows.select("ordinal", entity_id(F.try_element_at("row", F.lit(2))).alias("qid")).filter("qid IS NOT NULL")
    return ids.groupBy("qid").agg(F.min("ordinal").alias("ordinal"))


def nothing_found(query: Column) -> Column:
    """The offline search: every query is answered by a note that nothing was found."""
    return F.format_string(NONE_FOUND, query)


def found_text(results: Column, query: Column) -> Column:
    """A search's results (array of title, href, body) as text: null results were blocked, none is said so."""
    line = lambda r: F.concat(F.lit("- "), r["title"], F.lit(": "), r["href"], F.lit("\n  "), r["body"])
    return F.when(results.isNull(), F.format_string(BLOCKED, query)).when(F.size(results) == 0, nothing_found(query)).otherwise(F.array_join(F.transform(results, line), "\n"))


def fanned_out(candidates: DataFrame, search: Callable[[Column], Column] = nothing_found) -> DataFrame:
    """(candidate, name, one column per tool): every candidate (candidate, name, description) to every tool, gathered when all
    have answered."""
    target = F.concat("name", F.lit(" "), F.coalesce("description", F.lit("")))
    tools = F.explode(F.array(*[F.struct(F.lit(t).alias("tool"), F.format_string(q, target).alias("query")) for t, q in TOOLS.items()])).alias("t")
    rows = candidates.select("candidate", "name", tools).select("candidate", "name", "t.tool", search(F.col("t.query")).alias("answer"))
    return rows.groupBy("candidate", "name").pivot("tool", list(TOOLS)).agg(F.first("answer"))


def reduced(rows: DataFrame) -> DataFrame:
    """Per conversation: its texts in order, joined into one list, and the first role that is not empty."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "text", "role")))
    out = rows.groupBy("conv_id").agg(ordered.alias("_s"))
    texts = F.transform(F.filter("_s", lambda x: x["text"].isNotNull()), lambda x: x["text"])
    roles = F.filter("_s", lambda x: F.coalesce(x["role"], F.lit("")) != "")
    return out.select("conv_id", texts.alias("texts"), F.try_element_at(roles, F.lit(1))["role"].alias("first_role"))


def zipped(first: Column, second: Column) -> Column:
    """Pairs (a, b) of two lists by position, as many as the shorter has; none where a list is null."""
    n = F.least(F.size(first), F.size(second))
    pairs = F.zip_with(F.slice(first, 1, n), F.slice(second, 1, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(first.isNotNull() & second.isNotNull(), pairs).otherwise(F.filter(F.zip_with(first, second, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: F.lit(False)))


def kept_keywords(docs: DataFrame) -> DataFrame:
    """(doc_id, keyword): parts of a text between delimiters, as they are written, that are, case aside, also words of it (full
    stops left out), without stop words.

    Both lists belong to one document, so nothing is shuffled. Which texts are both is found by one intersection, by hash; parts
    are then compared with those few, not with every word.
    """
    parts = F.transform(F.split("text", r"[\n:;*,]"), lambda x: F.trim(x))
    words = F.array_distinct(F.split(F.lower(F.replace("text", F.lit("."), F.lit(""))), " "))
    rows = docs.select("doc_id", parts.alias("_p"), words.alias("_w"))
    # only parts without a blank can be words
    single = F.filter("_p", lambda x: (x != "") & ~x.contains(" ") & ~F.lower(x).isin(STOP_KEYWORDS))
    rows = rows.select("doc_id", single.alias("_p"), F.array_intersect(F.array_distinct(F.transform(single, lambda x: F.lower(x))), "_w").alias("_both"))
    return rows.select("doc_id", "_both", F.explode("_p").alias("keyword")).filter(F.array_contains("_both", F.lower("keyword"))).select("doc_id", "keyword")
