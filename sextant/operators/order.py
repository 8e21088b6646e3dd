"""Positions of rows in an order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import settled


def positions(rows: DataFrame, order: list[str], group: list[str] | None = None, name: str = "position") -> DataFrame:
    """``rows`` with their place, from 0, in the order of some columns, nulls first, within each ``group`` of columns or overall.

    A range sort deals the rows out, so a hot group is many ranges; each range's counts say where its rows begin. Those counts,
    a row for each range and group, are all that a window runs over. Rows that agree in all columns are interchangeable.
    """
    group = group or []
    by = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    kept = settled(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    # nulls of a group column are one group, and a struct is never null
    kept = kept.withColumn("_group", F.struct(F.lit(0).alias("_"), *group))
    runs = kept.groupBy("_part", "_group").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(F.col("_part").alias("_p"), F.col("_group").alias("_g"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = kept.join(runs, (F.col("_part") == F.col("_p")) & F.col("_group").eqNullSafe(F.col("_g")))
    return out.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))
