"""Incremental work over arriving files, each row's result stored once.

Structured Streaming keeps track of the files; ``foreachBatch`` stores each batch's results as the part of that batch's number. A
batch that is run again after a crash, also one whose part was written but not recorded, replaces its own part and no other,
and the keys that count as done are those of earlier parts only, so it does the same work again. A part counts once its writer
has finished it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fetch import first_rows
from ..operators.graph import one_a_key
from ..operators.ingest import pending
from ..sources.io import exists, names_in

PART = "part_{:05d}"


def part_path(out: str, batch: int) -> str:
    return f"{out.rstrip('/')}/{PART.format(batch)}"


def finished_parts(spark: SparkSession, out: str) -> list[int]:
    """The numbers of the parts whose writers have finished, in order."""
    found = [n for n in names_in(spark, out) if n.startswith("part_") and n[5:].isdigit()]
    return sorted(int(n[5:]) for n in found if exists(spark, f"{out.rstrip('/')}/{n}/_SUCCESS"))


def results(spark: SparkSession, out: str, schema: str, before: int | None = None) -> DataFrame:
    """All stored rows, or those of parts before a number; none if there are none."""
    paths = [part_path(out, n) for n in finished_parts(spark, out) if before is None or n < before]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def ingest_batch(batch: DataFrame, number: int, work: Callable[[DataFrame], DataFrame], out: str, schema: str, key: str, limit: int | None = None, per_file: int = 50_000) -> None:
    """Stores ``work`` of a batch's new rows as its part: rows with a key, one a key, the first ``limit`` of them by key, and of
    those the ones that no earlier part has. The limit comes before what is done is taken away, as in a run over one table."""
    spark = batch.sparkSession
    wanted = one_a_key(batch.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != ""), [key]).select(*batch.columns)
    new = pending(first_rows(wanted, limit, key), results(spark, out, schema, number), key)
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    work(new).select(*names).write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(part_path(out, number))


def incremental(spark: SparkSession, arriving: str, columns: str, work: Callable[[DataFrame], DataFrame], out: str, schema: str, checkpoint: str, key: str = "qid",
                limit: int | None = None, kind: str = "parquet", files_at_once: int = 100, **options: str) -> StreamingQuery:
    """A query that works through the files at ``arriving`` (of ``columns``) that no run has seen, ``files_at_once`` a batch, and
    ends when there are no more; started again with the same ``checkpoint``, it goes on where the last one ended.

    ``work`` gives a row of ``schema`` for each row that it is given, failures too: a failure counts as done.
    """
    rows = spark.readStream.schema(columns).options(**options).option("maxFilesPerTrigger", files_at_once).format(kind).load(arriving)
    store = lambda batch, number: ingest_batch(batch, number, work, out, schema, key, limit)
    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
