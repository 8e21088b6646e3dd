"""Property-graph patterns as joins over nodes (node_id, labels, id, qidLabel, qid, text) and edges (edge_id, src, dst, type, rel_type, rel_type_en, rel_group)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.graph import Graph
from ..session import settled

LOCATED = "LOCATED_IN"


def located(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("rel_group") == LOCATED)


def either_way(edges: DataFrame, *cols: str) -> DataFrame:
    """Edges from both ends (a, b); a self-loop once."""
    there = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *cols)
    back = edges.filter("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), *cols)
    return there.union(back)


def degrees(g: Graph) -> DataFrame:
    """(node_id, in_degree, out_degree) of every node; parallel edges count, a self-loop counts at both ends."""
    ends = g.edges.select(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    ends = ends.union(g.edges.select("src", F.lit(0), F.lit(1))).union(g.nodes.select("node_id", F.lit(0), F.lit(0)))
    n = ends.groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return n.join(g.nodes.select("node_id"), "node_id", "left_semi")


def named(g: Graph, names: DataFrame) -> DataFrame:
    """Nodes whose id or label is one of ``names`` (name): two equi joins instead of one with OR."""
    both = g.nodes.select("node_id", F.explode(F.array("id", "qidLabel")).alias("name"))
    return both.join(names, "name", "left_semi").select("node_id").distinct()


def reaches_all(g: Graph, targets: DataFrame, hops: int = 3) -> DataFrame:
    """Nodes with a directed path of 1..hops edges, all of them LOCATED_IN, to a target (node_id); found backwards from the targets."""
    steps = located(g.edges).select("src", "dst")
    front, found = targets.select("node_id"), None
    for _ in range(hops):
        front = steps.join(front, steps.dst == front.node_id, "left_semi").select(F.col("src").alias("node_id")).distinct()
        found = front if found is None else found.union(front)
    return found.distinct()


def reaches_any(g: Graph, targets: DataFrame) -> DataFrame:
    """Nodes with a directed path of one or two edges, at least one of them LOCATED_IN, to a target (node_id)."""
    e = g.edges.select("edge_id", "src", "dst", (F.coalesce("rel_group", F.lit("")) == LOCATED).alias("loc"))
    last = e.join(targets.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    one = last.filter("loc").select(F.col("src").alias("node_id"))
    # of a node's last edges of a kind, two are as good as all: one of them is not the edge before
    tail = last.groupBy(F.col("src").alias("mid"), F.col("loc").alias("loc2")).agg(F.min("edge_id").alias("one"), F.max("edge_id").alias("other"))
    two = e.join(tail, F.col("dst") == F.col("mid")).filter("(loc OR loc2) AND (edge_id <> one OR edge_id <> other)").select(F.col("src").alias("node_id"))
    return one.union(two).distinct()


def degrees_of(g: Graph, ids: DataFrame) -> DataFrame:
    """(node_id, in_degree, out_degree) of a few nodes: edges meet them before anything is counted."""
    ends = g.edges.select(F.explode(F.array(F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    return ends.join(ids, "node_id", "left_semi").groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def reach_from(g: Graph, starts: DataFrame, targets: DataFrame, hops: int, every: bool) -> DataFrame:
    """Nodes of ``starts`` (node_id) with a directed path of 1..hops edges to a target, ``every`` or at least one of them LOCATED_IN.

    Searched forwards, for few starts; ``reaches_all`` and ``reaches_any`` give the same for all nodes.
    """
    steps = (located(g.edges) if every else g.edges).select("edge_id", "src", "dst", (F.coalesce("rel_group", F.lit("")) == LOCATED).alias("loc"))
    front = starts.select("node_id", F.col("node_id").alias("at"), F.lit(False).alias("seen"), F.lit("").alias("via"))
    found = None
    for _ in range(hops):
        front = front.join(steps, (F.col("at") == F.col("src")) & (F.col("via") != F.col("edge_id")))
        front = front.select("node_id", F.col("dst").alias("at"), (F.col("seen") | F.col("loc")).alias("seen"), F.lit("").alias("via") if every else F.col("edge_id").alias("via")).distinct()
        found = front if found is None else found.union(front)
    hit = found.filter("seen").join(targets.select(F.col("node_id").alias("at")), "at", "left_semi")
    return hit.select("node_id").distinct()


def expanded_region(g: Graph, names: DataFrame) -> DataFrame:
    """(name) of everything in the targets' region: targets, their containers, and cities beside them in the same country."""
    near = either_way(located(g.edges).select("src", "dst"))
    place = F.array(F.lit("City"), F.lit("Country"), F.lit("Region"))
    info = lambda p: g.nodes.select(F.col("node_id").alias(p), F.col("id").alias(f"{p}_id"), F.col("qidLabel").alias(f"{p}_lbl"), F.col("labels").alias(f"{p}_labels"))
    n = info("n").filter(F.array_contains("n_labels", "__Entity__")).join(named(g, names).withColumnRenamed("node_id", "n"), "n", "left_semi")
    rows = n.join(near, F.col("n") == F.col("a")).select("n", "n_id", "n_lbl", F.col("b").alias("d")).join(info("d").filter(F.arrays_overlap("d_labels", place)), "d")
    side = near.select(F.col("a").alias("country"), F.col("b").alias("c")).join(info("c").filter(F.array_contains("c_labels", "City")), "c")
    # the sibling's conditions belong to the optional pattern, so they never drop a container
    on = (F.col("d") == F.col("country")) & F.array_contains("d_labels", "Country") & (F.col("c") != F.col("n"))
    rows = rows.join(side.drop("c_labels"), on, "left")
    six = F.explode(F.array("n_id", "n_lbl", "d_id", "d_lbl", "c_id", "c_lbl"))
    return rows.select(six.alias("name")).filter("coalesce(name, '') <> ''").distinct()


def anchors(g: Graph, qids: DataFrame) -> DataFrame:
    """(qid, node_id, label): the entities of each qid that has a document, else its documents."""
    docs = g.nodes.filter(F.array_contains("labels", "Document")).join(qids.select("qid").distinct(), "qid").select("qid", "node_id", F.coalesce("qidLabel", "id").alias("label"))
    ents = g.nodes.filter(F.array_contains("labels", "__Entity__")).select("qid", F.col("node_id").alias("ent"), F.coalesce("qidLabel", "id").alias("ent_label"))
    both = docs.join(ents, "qid", "left")
    return both.select("qid", F.coalesce("ent", "node_id").alias("node_id"), F.when(F.col("ent").isNotNull(), F.col("ent_label")).otherwise(F.col("label")).alias("label")).distinct()


def doc_targets(g: Graph, qids: DataFrame) -> DataFrame:
    """(qid, node_id): documents of each qid, and the entities of qids that have a document."""
    docs = g.nodes.filter(F.array_contains("labels", "Document")).join(qids.select("qid").distinct(), "qid", "left_semi").select("qid", "node_id")
    ents = g.nodes.filter(F.array_contains("labels", "__Entity__")).select("qid", "node_id").join(docs.select("qid").distinct(), "qid", "left_semi")
    return docs.union(ents).distinct()


def qid_nodes(g: Graph, qids: DataFrame) -> DataFrame:
    """(qid, node_id, anchor): the nodes of ``doc_targets`` in one pass over the nodes; ``anchor`` tells those of ``anchors``."""
    own = g.nodes.join(qids.select("qid").distinct(), "qid", "left_semi").select("qid", "node_id", F.array_contains("labels", "Document").alias("doc"), F.array_contains("labels", "__Entity__").alias("entity"))
    own = own.filter("doc OR entity")
    has = own.groupBy("qid").agg(F.bool_or("doc").alias("has_doc"), F.bool_or("entity").alias("has_entity"))
    both = own.join(has, "qid").filter("has_doc")
    return both.groupBy("qid", "node_id").agg(F.bool_or(F.col("entity") | ~F.col("has_entity")).alias("anchor"))


def ways_from(g: Graph, starts: DataFrame, hops: int, located_after: int | None = None) -> Graph:
    """The edges that paths of up to ``hops`` edges from few nodes (node_id) can use, stored hop by hop: each hop's scan meets the
    nodes before it, whose size is known by then. After ``located_after`` hops only LOCATED_IN edges after such edges are followed."""
    steps = g.edges.select("edge_id", "src", "dst", "rel_group")
    front, found = starts.select("node_id").distinct(), None
    for hop in range(hops):
        only = located_after is not None and hop >= located_after
        met = settled((located(steps) if only else steps).join(front, F.col("src") == F.col("node_id"), "left_semi"))
        found = met if found is None else found.union(met)
        following = met if located_after is None or hop + 1 < located_after else located(met)
        front = following.select(F.col("dst").alias("node_id")).distinct()
    return Graph(g.nodes, found.distinct())


def facts(g: Graph, heads: DataFrame, per: int) -> DataFrame:
    """Up to ``per`` facts of each anchor in edge order: (qid, node_id, label, n_facts, facts); anchors without facts stay, with ''."""
    rel = g.edges.filter("type = 'REL' AND coalesce(rel_group, '') <> 'OTHER'").select("edge_id", "src", "dst", F.coalesce("rel_type_en", "rel_group", "rel_type", F.lit("REL")).alias("rel"))
    near = either_way(rel, "edge_id", "rel").join(heads.select(F.col("node_id").alias("a")).distinct(), "a", "left_semi")
    top = near.withColumn("_k", F.row_number().over(W.partitionBy("a").orderBy("edge_id"))).filter(F.col("_k") <= per)
    name = F.coalesce("qidLabel", "id", "qid", F.substring("text", 1, 80), F.lit("?"))
    top = top.join(g.nodes.select(F.col("node_id").alias("b"), name.alias("other")), "b")
    lines = top.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("edge_id", "rel", "other"))).alias("rows"))
    out = heads.join(lines, heads.node_id == lines.a, "left")
    line = lambda r: F.concat(F.coalesce("label", F.lit("?")), F.lit(" --["), r["rel"], F.lit("]-- "), r["other"])
    rows = F.coalesce("rows", F.array().cast("array<struct<edge_id:string,rel:string,other:string>>"))
    return out.select("qid", "node_id", "label", F.size(rows).alias("n_facts"), F.array_join(F.transform(rows, line), "\n").alias("facts"))


# --- writes -----------------------------------------------------------------------------------------------------------


def one_a_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest row of each key, column by column, so that it does not matter which comes first."""
    values = [c for c in rows.columns if c not in keys]
    if not values:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.max(F.struct(*values)).alias("_v")).select(*keys, "_v.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], on_create: tuple[str, ...] = ()) -> DataFrame:
    """MERGE by key: new non-null values replace old ones, unmatched rows of both sides stay. Properties that only ``new`` has are
    added, null in rows that it lacks. Of several new rows of a key the greatest counts. Columns of ``on_create`` are set on rows
    that are made here only. Keys that are null never match, as in an equality."""
    added = [c for c in new.columns if c not in old.columns]
    old = old.withColumns({c: F.lit(None).cast(new.schema[c].dataType) for c in added})
    values = [c for c in old.columns if c not in keys]
    fresh = one_a_key(new, keys).select(*keys, *[F.col(c).alias(f"_new_{c}") if c in new.columns else F.lit(None).alias(f"_new_{c}") for c in values])
    both = old.withColumn("_old", F.lit(True)).join(fresh, keys, "full")
    made = lambda c: F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_new_{c}"))
    return both.select(*keys, *[(made(c) if c in on_create else F.coalesce(f"_new_{c}", c)).alias(c) for c in values])


def update(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Sets properties of matched rows only, also ones that they did not have; unmatched new rows are ignored."""
    values = [c for c in new.columns if c not in keys]
    fresh = one_a_key(new, keys).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])
    out = old.join(fresh, keys, "left")
    own = [F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c) for c in old.columns]
    return out.select(*own, *[F.col(f"_new_{c}").alias(c) for c in values if c not in old.columns])


def detach_delete(g: Graph, doomed: DataFrame) -> Graph:
    """Without the nodes of ``doomed`` (node_id) and every edge at one of them."""
    gone = doomed.select("node_id").distinct()
    nodes = g.nodes.join(gone, "node_id", "left_anti")
    edges = g.edges.join(gone.select(F.col("node_id").alias("src")), "src", "left_anti").join(gone.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    return Graph(nodes, edges.select(*g.edges.columns))


def regrouped(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """REL edges with group, score, English and normal name of the first row of ``mapping`` (ordinal, rel_type, rel_group,
    rel_score, rel_type_en, rel_type_norm) for their type; a matched null overwrites. Names that the mapping lacks are null."""
    mapping = mapping.withColumns({c: F.lit(None).cast("string") for c in ("rel_type_en", "rel_type_norm") if c not in mapping.columns})
    first = mapping.withColumn("_k", F.row_number().over(W.partitionBy("rel_type").orderBy("ordinal"))).filter("_k = 1")
    first = first.select("rel_type", F.lit(True).alias("_hit"), F.col("rel_group").alias("_group"), F.col("rel_score").alias("_score"), F.col("rel_type_en").alias("_en"), F.col("rel_type_norm").alias("_norm"))
    out = edges.join(first, "rel_type", "left")
    hit: Column = F.coalesce(F.col("_hit") & (F.col("type") == "REL"), F.lit(False))
    group = F.when(hit, F.col("_group")).otherwise(F.col("rel_group"))
    english = F.when(hit, F.col("_en")).otherwise(F.col("rel_type_en"))
    return out.select("edge_id", "src", "dst", "type", "rel_type", english.alias("rel_type_en"), F.when(hit, F.col("_norm")).alias("rel_type_norm"), group.alias("rel_group"), F.when(hit, F.col("_score")).alias("rel_score"))


def attached(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(src, type, dst, label) edges from document nodes (node_id, qid, source_tag) to what is known of their qid and tag (qid,
    source_tag, country, location, lat, lon): a country, a location, a point if it has both coordinates. Sets, one edge a chunk."""
    both = docs.join(rows, ["qid", "source_tag"])
    to = lambda kind, label, key: F.struct(F.lit(kind).alias("type"), key.cast("string").alias("dst"), F.lit(label).alias("label"))
    point = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string")))
    ends = F.array(to("LOCATED_IN_COUNTRY", "Country", F.col("country")), to("LOCATED_IN", "Location", F.col("location")), to("HAS_GEOGRAPHIC_LOCATION", "Coordinates", point))
    return both.select(F.col("node_id").alias("src"), F.explode(ends).alias("e")).select("src", "e.*").filter("dst IS NOT NULL").distinct()


def attached_nodes(links: DataFrame) -> DataFrame:
    """(label, id, lat, lon): the nodes that ``attached`` edges lead to, each once; only points have coordinates."""
    at = lambda k: F.when(F.col("label") == "Coordinates", F.element_at(F.split("dst", ","), k).cast("double"))
    return links.select("label", F.col("dst").alias("id"), at(1).alias("lat"), at(2).alias("lon")).distinct()


def graph_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) and edges (src, src_label, dst, dst_label, type) of extracted documents (nodes, relationships, text).

    A node is its label and its id, and so is either end of an edge: City Paris and Person Paris stay two. A relationship names
    its ends by id; the labels are those that the same document gives the id, one edge for each, and ``Node`` where it gives none.
    A source is one Document node, named by ``id`` of ``docs``' metadata map where it has one, else by its text's checksum;
    MENTIONS leads from it to each of its nodes.
    """
    own = F.md5("text")
    if "metadata" in docs.columns:
        own = F.coalesce(F.nullif(F.try_element_at("metadata", F.lit("id")), F.lit("")), own)
    nodes, rels = (F.coalesce(c, F.array().cast(docs.schema[c].dataType)) for c in ("nodes", "relationships"))
    edge = lambda src, src_label, dst, dst_label, type_: F.struct(src.alias("src"), src_label.alias("src_label"), dst.alias("dst"), dst_label.alias("dst_label"), type_.alias("type"))
    # both lists belong to one document, so the labels of an end are looked up within its row: each end in all nodes
    labels = lambda end: F.filter(nodes, lambda n: n["id"] == end)
    known = lambda end: F.when(F.size(labels(end)) > 0, F.array_distinct(F.transform(labels(end), lambda n: n["type"]))).otherwise(F.array(F.lit("Node")))
    each = F.flatten(F.transform(rels, lambda r: F.flatten(F.transform(known(r["source"]), lambda a: F.transform(known(r["target"]), lambda b: edge(r["source"], a, r["target"], b, r["type"]))))))
    # but where all nodes have one label and all ends are nodes, which sets tell, there is nothing to look up
    types = F.array_distinct(F.transform(nodes, lambda n: n["type"]))
    ends = F.concat(F.transform(rels, lambda r: r["source"]), F.transform(rels, lambda r: r["target"]))
    plain = (F.size(types) == 1) & (F.size(F.array_except(ends, F.transform(nodes, lambda n: n["id"]))) == 0) & ~F.exists(ends, lambda e: e.isNull())
    # one-element transforms bind what is the same for all elements, so it is computed once a row
    alike = F.flatten(F.transform(types, lambda t: F.transform(rels, lambda r: edge(r["source"], t, r["target"], t, r["type"]))))
    told = F.flatten(F.transform(F.array(own), lambda s: F.transform(nodes, lambda n: edge(s, F.lit("Document"), n["id"], n["type"], F.lit("MENTIONS")))))
    related = F.when(plain, alike).otherwise(each)
    # one pass over the documents each: what made them may be an extractor
    edges = docs.select(F.explode(F.concat(related, told)).alias("e")).select("e.*")
    end = lambda id_, label: F.struct(id_.alias("id"), label.alias("label"))
    sides = [F.transform(related, lambda e: end(e["src"], e["src_label"])), F.transform(related, lambda e: end(e["dst"], e["dst_label"]))]
    met = docs.select(F.explode(F.concat(F.array(end(own, F.lit("Document"))), F.transform(nodes, lambda n: end(n["id"], n["type"])), *sides)).alias("e")).select("e.*")
    return met.dropDuplicates(["label", "id"]), edges.dropDuplicates(["src", "src_label", "dst", "dst_label", "type"])
