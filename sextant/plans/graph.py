"""The canonical property graph over the input tables: nodes and edges as DataFrames, and the same as SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import table

_GROUP = "CASE o_orderpriority WHEN '1-URGENT' THEN 'CREATED_BY' WHEN '2-HIGH' THEN 'RELATED_TO' WHEN '3-MEDIUM' THEN 'ABOUT' WHEN '4-NOT SPECIFIED' THEN 'OTHER' END"
_DOC_QID = "CASE WHEN doc_id % 25 = 7 THEN NULL WHEN doc_id % 10 = 9 THEN 'X'||{half20} ELSE 'C'||{half2} END"


def _nodes(array, div) -> str:
    qid = _DOC_QID.format(half20=div("doc_id", 20), half2=div("doc_id", 2))
    entity = lambda p, k, label, name, t: f"SELECT '{p}'||{k} AS node_id, {array(label, '__Entity__')} AS labels, {name} AS id, {name} AS qidLabel, '{p}'||{k} AS qid, CAST(NULL AS STRING) AS text FROM {t}"
    return " UNION ALL ".join([
        entity("R", "r_regionkey", "Region", "r_name", "region"),
        entity("N", "n_nationkey", "Country", "n_name", "nation"),
        entity("C", "c_custkey", "City", "c_name", "customer"),
        entity("S", "s_suppkey", "Landmark", "s_name", "supplier"),
        f"SELECT 'O'||o_orderkey, {array('Event', '__Entity__')}, 'O'||o_orderkey, NULL, 'O'||o_orderkey, NULL FROM orders",
        f"SELECT 'D'||doc_id, {array('Document')}, 'D'||doc_id, source||' '||doc_id, {qid}, text FROM documents",
    ])


def _edges(div) -> str:
    located = lambda p, k, s, d, kind, t: f"SELECT '{p}'||{k} AS edge_id, {s} AS src, {d} AS dst, 'REL' AS type, '{kind}' AS rel_type, CAST(NULL AS STRING) AS rel_type_en, 'LOCATED_IN' AS rel_group FROM {t}"
    return " UNION ALL ".join([
        located("nr", "n_nationkey", "'N'||n_nationkey", "'R'||n_regionkey", "located in", "nation"),
        located("cn", "c_custkey", "'C'||c_custkey", "'N'||c_nationkey", "city of", "customer"),
        located("sn", "s_suppkey", "'S'||s_suppkey", "'N'||s_nationkey", "situated in", "supplier"),
        f"SELECT 'oc'||o_orderkey, 'O'||o_orderkey, 'C'||o_custkey, 'REL', lower(o_orderpriority), NULL, {_GROUP} FROM orders",
        f"SELECT 'dc'||doc_id, 'D'||doc_id, 'C'||{div('doc_id', 2)}, 'MENTIONS', NULL, NULL, NULL FROM documents",
        located("dn", "doc_id", "'D'||doc_id", "'N'||(doc_id % 25)", "located in", "documents") + " WHERE doc_id % 3 = 0",
    ])


_spark_array = lambda *x: "array(" + ", ".join(f"'{v}'" for v in x) + ")"
_duck_array = lambda *x: "[" + ", ".join(f"'{v}'" for v in x) + "]"

#: Common table expressions ``nodes`` and ``edges`` for DuckDB.
GRAPH_SQL = f"nodes AS ({_nodes(_duck_array, lambda c, n: f'({c} // {n})')}), edges AS ({_edges(lambda c, n: f'({c} // {n})')})"


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Lazy nodes and edges; unused branches and columns are pruned by the optimiser."""
    views = {t: table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "orders", "documents")}
    div = lambda c, n: f"({c} div {n})"

    def run(sql: str) -> DataFrame:
        # tables are passed as arguments, so nothing is left in the session's catalogue
        for t in views:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
        return spark.sql(sql, **views)

    return Graph(run(_nodes(_spark_array, div)), run(_edges(div)))
