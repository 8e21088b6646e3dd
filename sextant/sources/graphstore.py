"""A stored property graph whose writes touch what they change.

Nodes are keyed by (label, id), edges by both ends and their type, so equal ids of two labels stay apart. A table is partitioned by a
hash of its key and bucketed and sorted by the key within. A write reads the partitions that hold its keys, joins them
bucket by bucket (only the new rows are shuffled), and replaces just those partitions; all others are left as they are. A property
that is new to the table becomes a column.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import one_a_key, upsert
from ..session import scratch

NODE_KEY = ["label", "id"]
EDGE_KEY = ["src_label", "src_id", "type", "dst_label", "dst_id"]


@dataclass
class Keyed:
    """A table of the store: its name in the session's catalogue, its key, its partitions and buckets."""

    spark: SparkSession
    name: str
    keys: list[str]
    path: str
    partitions: int = 32
    buckets: int = 8

    def rows(self) -> DataFrame:
        """The stored rows."""
        return self.spark.table(self.name).drop("_part")

    def _hashed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_part", F.pmod(F.xxhash64(*self.keys), F.lit(self.partitions)).cast("int"))

    def create(self, rows: DataFrame) -> None:
        """Makes the table, below its path; of several rows of a key the greatest counts; rows with a null in the key are an error."""
        bad = rows.filter(" OR ".join(f"`{k}` IS NULL" for k in self.keys)).limit(1).count()
        if bad:
            raise ValueError(f"a null in the key {self.keys}")
        first = self._hashed(one_a_key(rows, self.keys)).repartition(self.buckets, *self.keys)
        w = first.write.mode("error").format("parquet").partitionBy("_part").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        w.option("path", self.path).saveAsTable(self.name)

    def touched(self, new: DataFrame) -> list[int]:
        """The partitions that hold the keys of ``new``: at most all of the table's."""
        return sorted(r[0] for r in self._hashed(new.select(*self.keys)).select("_part").distinct().collect())

    def merged(self, new: DataFrame, parts: list[int], on_create: tuple[str, ...] = ()) -> DataFrame:
        """The new contents of the partitions ``parts``: the plan has no exchange of the old side."""
        old = self.spark.table(self.name).filter(F.col("_part").isin(parts)).drop("_part")
        return self._hashed(upsert(old, new.repartition(self.buckets, *self.keys), self.keys, on_create))

    def upsert(self, new: DataFrame, on_create: tuple[str, ...] = ()) -> list[int]:
        """Merges rows by key, as ``graph.upsert`` does, and returns the partitions that were replaced."""
        new = new.dropna(subset=self.keys)
        have = self.spark.table(self.name).schema
        for f in new.schema:
            if f.name not in have.names:
                self.spark.sql(f"ALTER TABLE {self.name} ADD COLUMNS (`{f.name}` {f.dataType.simpleString()})")
        return self._replace(lambda parts: self.merged(new, parts, on_create), self.touched(new))

    def delete(self, gone: DataFrame) -> list[int]:
        """Deletes the rows of some keys and returns the partitions that were replaced."""
        gone = gone.select(*self.keys).dropna().distinct()
        parts = self.touched(gone)
        old = self.spark.table(self.name).filter(F.col("_part").isin(parts))
        left = old.join(gone, self.keys, "left_anti")
        kept = {r[0] for r in left.select("_part").distinct().collect()}
        self._replace(lambda parts: left, sorted(kept))
        for part in set(parts) - kept:  # an overwrite by partition leaves those that get no rows
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_part={part}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self.spark.catalog.refreshTable(self.name)
        return parts

    def _replace(self, contents: Callable[[list[int]], DataFrame], parts: list[int]) -> list[int]:
        """Overwrites the partitions ``parts``: the new files are staged beside the table, then take the old ones' places."""
        if parts:
            fresh = contents(parts).select(*self.spark.table(self.name).columns)
            mode = "spark.sql.sources.partitionOverwriteMode"
            before = self.spark.conf.get(mode)
            self.spark.conf.set(mode, "dynamic")
            try:
                fresh.repartition(self.buckets, *self.keys).write.insertInto(self.name, overwrite=True)
            finally:
                self.spark.conf.set(mode, before)
        return parts

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def node_table(spark: SparkSession, nodes: DataFrame, **sizes: int) -> Keyed:
    """A new table of nodes (label, id, ...)."""
    out = Keyed(spark, f"nodes_{uuid.uuid4().hex}", NODE_KEY, scratch(spark, "graph"), **sizes)
    out.create(nodes)
    return out


def edge_table(spark: SparkSession, edges: DataFrame, **sizes: int) -> Keyed:
    """A new table of edges (src_label, src_id, type, dst_label, dst_id, ...)."""
    out = Keyed(spark, f"edges_{uuid.uuid4().hex}", EDGE_KEY, scratch(spark, "graph"), **sizes)
    out.create(edges)
    return out


def detach_delete(nodes: Keyed, edges: Keyed, doomed: DataFrame) -> None:
    """Deletes nodes (label, id) and every edge at one of them; edges first, so none is ever left without its ends."""
    gone = doomed.select(*NODE_KEY).dropna().distinct()
    all_ = edges.rows().select(*EDGE_KEY)
    out = all_.join(gone.select(F.col("label").alias("src_label"), F.col("id").alias("src_id")), ["src_label", "src_id"], "left_semi").select(*EDGE_KEY)
    into = all_.join(gone.select(F.col("label").alias("dst_label"), F.col("id").alias("dst_id")), ["dst_label", "dst_id"], "left_semi").select(*EDGE_KEY)
    edges.delete(out.union(into))
    nodes.delete(gone)
