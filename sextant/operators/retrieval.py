"""Vector search, score fusion, graph filter, re-ranking and evidence; every top-k has a total order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import cosine, dot
from ..plans.graph import Graph
from ..session import settled, together
from . import graph as G


def scored(vectors: DataFrame, query: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, score): dot products with the single row of ``query``; one row may be broadcast whatever the table."""
    q = query.limit(1).select(F.col(vec_col).alias("_q"))
    return vectors.crossJoin(F.broadcast(q)).select(F.col(id_col), F.round(dot(F.col(vec_col), F.col("_q")), 6).alias("score"))


def top_k(rows: DataFrame, k: int, score: str = "score", tie: str = "vec_id") -> DataFrame:
    """The k best with their rank; at most k rows meet in one place."""
    best = rows.orderBy(F.col(score).desc(), F.col(tie).asc()).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col(score).desc(), F.col(tie).asc())))


def fused(first: DataFrame, second: DataFrame, a: float = 0.6, b: float = 0.4) -> DataFrame:
    """Weighted sum of two score lists (vec_id, score); an id in only one of them keeps its score as it is."""
    x, y = first.select("vec_id", F.col("score").alias("s1")), second.select("vec_id", F.col("score").alias("s2"))
    both = x.join(y, "vec_id", "full")
    fuse = F.when(F.col("s1").isNotNull() & F.col("s2").isNotNull(), a * F.col("s1") + b * F.col("s2")).otherwise(F.coalesce("s1", "s2"))
    return both.select("vec_id", F.round(fuse, 6).alias("score"))


def hybrid(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Each list's scores over its own maximum, the larger one per id, the k best."""

    def scaled(rows: DataFrame) -> DataFrame:
        top = rows.agg(F.max("score").alias("_top"))
        return rows.crossJoin(F.broadcast(top)).select("vec_id", (F.col("score") / F.nullif(F.col("_top"), F.lit(0.0))).alias("score"))

    both = scaled(first).union(scaled(second)).groupBy("vec_id").agg(F.round(F.max("score"), 6).alias("score"))
    return top_k(both, k)


def relevant_tags(tags: DataFrame, request: DataFrame, k: int = 15, over: float = 0.35) -> DataFrame:
    """(tag, score, rank): of the ``k`` tags (tag, embedding) nearest to the single row of ``request``, those that score more than ``over``."""
    return top_k(scored(tags, request, "tag"), k, tie="tag").filter(F.col("score") > over)


#: Prototypes that each vector may meet; more are an index's business.
PROTOTYPES = 10_000


def nearest_prototype(vectors: DataFrame, prototypes: DataFrame, least: float, other: str = "OTHER") -> DataFrame:
    """(vec_id, label, score): the prototype (ordinal, name, embedding) of highest cosine, first of equals; ``other`` under ``least``.

    Prototypes are a fixed ontology, tens of rows, so each vector meets all of them; more than ``PROTOTYPES`` are an error.
    """
    prototypes = settled(prototypes)
    if prototypes.limit(PROTOTYPES + 1).count() > PROTOTYPES:
        raise ValueError(f"more than {PROTOTYPES} prototypes")
    p = prototypes.select("ordinal", "name", F.col("embedding").alias("_p"))
    all_ = vectors.crossJoin(F.broadcast(p)).select("vec_id", "ordinal", "name", F.round(cosine(F.col("embedding"), F.col("_p")), 6).alias("score"))
    # a struct orders by score, then by the lower ordinal: a partial aggregate, no sort of all pairs
    best = all_.groupBy("vec_id").agg(F.max(F.struct("score", (-F.col("ordinal")).alias("o"), "name")).alias("b"))
    return best.select("vec_id", F.when(F.col("b.score") >= least, F.col("b.name")).otherwise(other).alias("label"), F.col("b.score").alias("score"))


@dataclass
class Around:
    """What a request's ranked documents and target names meet in the graph; all of it small and stored."""

    docs: DataFrame
    nodes: DataFrame
    allowed: DataFrame | None
    named: DataFrame | None
    degrees: DataFrame | None
    edges: Graph


def around(g: Graph, docs: DataFrame, names: DataFrame, region: bool = True, ranks: bool = True) -> Around:
    """For ``region`` the nodes of the targets' region and the edges within two hops of the documents' nodes; for ``ranks`` the
    targets, the degrees of the documents' nodes and the edges of located paths of three. What needs the graph but not each other
    is looked up at the same time."""
    docs = settled(docs)

    def near() -> tuple:
        nodes = settled(G.qid_nodes(g, docs.filter("coalesce(qid, '') <> ''").select("qid")))
        ids = nodes.select("node_id").distinct()
        edges = lambda: G.ways_from(g, ids, 3 if ranks else 2, 2 if ranks else None)
        return nodes, *together(edges, (lambda: settled(G.degrees_of(g, ids))) if ranks else lambda: None)

    allowed, named, (nodes, edges, degrees) = together(
        (lambda: settled(G.named(g, settled(G.expanded_region(g, names))))) if region else lambda: None, (lambda: settled(G.named(g, names))) if ranks else lambda: None, near)
    return Around(docs, nodes, allowed, named, degrees, edges)


def geo_filtered(g: Graph, docs: DataFrame, names: DataFrame, fallback: int = 50, known: Around | None = None) -> DataFrame:
    """Ranked documents (rank, qid, ...; the top of a search, so few) whose anchor reaches the targets' region; the first ``fallback`` by rank if none does."""
    known = known or around(g, docs, names, ranks=False)
    docs, heads = known.docs, known.nodes.filter("anchor").select("qid", "node_id")
    ok = G.reach_from(known.edges, heads.select("node_id").distinct(), known.allowed, hops=2, every=False)
    valid = heads.join(ok, "node_id", "left_semi").select("qid").distinct()
    kept = settled(docs.join(valid, "qid", "left_semi").select(*docs.columns))
    none = kept.agg((F.count(F.lit(1)) == 0).alias("_none"))
    rest = docs.filter(F.col("rank") <= fallback).crossJoin(F.broadcast(none)).filter("_none").select(*docs.columns)
    return kept.union(rest)


def reranked(g: Graph, docs: DataFrame, names: DataFrame, top: int, known: Around | None = None) -> DataFrame:
    """(qid, label, score, rank) of the ``top`` best candidates among ranked documents (rank, qid, qidLabel, text, score).

    score * 1.2 if the text holds a target's name * 1.1 if the qid lies in a target + ln(2 in + out + 1) / 20, which is 0
    where there are no targets; the best document of a qid counts, the first of equals.
    """
    rows = docs.filter("coalesce(qid, '') <> ''")
    known = known or around(g, docs, names, region=False)
    ids = known.nodes.select("node_id").distinct()
    inside = G.reach_from(known.edges, ids, known.named, hops=3, every=True).withColumn("_in", F.lit(True))
    told = known.nodes.select("qid", "node_id").join(known.degrees, "node_id", "left").join(inside, "node_id", "left").groupBy("qid").agg(
        F.max(F.coalesce("in_degree", F.lit(0))).alias("i"), F.max(F.coalesce("out_degree", F.lit(0))).alias("o"), F.coalesce(F.bool_or("_in"), F.lit(False)).alias("in_target"))
    wanted = names.agg(F.collect_set(F.lower("name")).alias("_names"))  # a request's own target names
    rows = rows.join(told, "qid", "left").crossJoin(F.broadcast(wanted))
    hit = F.exists("_names", lambda t: F.contains(F.lower("text"), t))
    importance = F.when(F.size("_names") > 0, F.coalesce(F.log(2 * F.col("i") + F.col("o") + 1), F.lit(0.0))).otherwise(0.0)
    final = F.col("score") * F.when(hit, 1.2).otherwise(1.0) * F.when(F.col("in_target"), 1.1).otherwise(1.0) + 0.05 * importance
    rows = rows.select("qid", F.col("qidLabel").alias("label"), "rank", F.round(final, 6).alias("score"))
    best = rows.groupBy("qid").agg(F.max(F.struct("score", (-F.col("rank")).alias("_r"), "label")).alias("b"), F.min("rank").alias("_first"))
    best = best.select("qid", F.col("b.label").alias("label"), F.col("b.score").alias("score"), "_first")
    order = [F.col("score").desc(), F.col("_first").asc()]
    return best.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(W.orderBy(*order))).drop("_first")


def landmarks(g: Graph, docs: DataFrame, names: DataFrame, top: int, fallback: int = 50) -> tuple[DataFrame, DataFrame]:
    """The documents that the region leaves and the ``top`` candidates among them: both steps share what they look up."""
    known = around(g, docs, names)
    left = settled(geo_filtered(g, docs, names, fallback, known))
    return left, settled(reranked(g, left, names, top, known))


def evidence(docs: DataFrame, candidates: DataFrame, chars: int = 700) -> DataFrame:
    """(qid, rank, block): each candidate's heading and the beginning of its longest document, the first of equals."""
    own = docs.join(candidates.select("qid"), "qid", "left_semi").select("qid", "text", "rank")
    best = own.groupBy("qid").agg(F.max(F.struct(F.length("text").alias("n"), (-F.col("rank")).alias("r"), "text")).alias("b"))
    rows = candidates.join(best, "qid", "left")
    text = F.replace(F.substring(F.coalesce("b.text", F.lit("No text available.")), 1, chars), F.lit("\n"), F.lit(" "))
    # format_number rounds the double itself, as printf in C does; format_string rounds its shortest decimal, halves up
    score = F.replace(F.format_number("score", 4), F.lit(","), F.lit(""))
    head = F.concat(F.lit("== "), F.coalesce("label", F.lit("None")), F.lit(" (Score="), score, F.lit(") ==\n"))
    return rows.select("qid", "rank", F.concat(head, text, F.lit("...")).alias("block"))
