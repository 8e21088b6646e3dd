"""Typed readers and writers: CSV, Parquet, JSON lines, images, numbered batches and small state tables."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.order import positions

#: Multi-line CSV with quotes doubled by quotes. Blanks at a text's ends stay; nulls (\\N, or nothing between commas) are told
#: from empty strings (two quotes).
CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def detect(path: str) -> str:
    """The format that a path's name tells: a folder is Parquet."""
    name = path.rstrip("/").rpartition("/")[2]
    if "." not in name or name.endswith(".parquet"):
        return "parquet"
    for end, kind in ((".csv", "csv"), (".jsonl", "json"), (".json", "json")):
        if name.endswith(end):
            return kind
    raise ValueError(f"unknown format: {path}")


def read(spark: SparkSession, path: str, kind: str | None = None, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A scan with an explicit schema where one is given; CSV without one has string columns."""
    kind = kind or detect(path)
    r = spark.read.options(**(CSV | options if kind == "csv" else options))
    return (r.schema(schema) if schema is not None else r).format(kind).load(path)


def write(df: DataFrame, path: str, kind: str | None = None, mode: str = "overwrite", per_file: int | None = None) -> None:
    """JSON keeps null fields; ``per_file`` bounds the rows of a file."""
    kind = kind or detect(path)
    options = {"csv": CSV, "json": {"ignoreNullFields": "false"}, "parquet": {"compression": "snappy"}}[kind]
    w = df.write.mode(mode).options(**options)
    (w.option("maxRecordsPerFile", per_file) if per_file else w).format(kind).save(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a state's complete versions, the newest first."""
    found = [int(n[1:]) for n in names_in(spark, path) if n.startswith("v") and n[1:].isdigit()]
    return sorted((n for n in found if exists(spark, f"{path.rstrip('/')}/v{n}/_SUCCESS")), reverse=True)


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A progress table: its newest complete version that can be read; empty if there is none."""
    for n in _versions(spark, path):
        rows = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/v{n}")
        try:
            rows.agg(*[F.max(F.xxhash64(c)) for c in rows.columns]).first()  # all pages of a small table
            return rows
        except (AnalysisException, Py4JJavaError, PySparkException):  # cut short or no Parquet at all
            continue
    return spark.createDataFrame([], schema)


def graph_batches(spark: SparkSession, path: str) -> DataFrame:
    """All graph-document batches below a folder (files or folders named so), each row with the name of the folder that holds its
    batch as ``source_tag`` and the batch's path as ``file``."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    rows = rows.select("*", F.regexp_extract("_metadata.file_path", r"^(.*/graph_docs_batch_[^/]*)", 1).alias("file")).filter("file <> ''")
    return rows.withColumn("source_tag", F.element_at(F.split("file", "/"), -2))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def graph_batches_of(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``graph_batches`` of several folders, ordered by folder and file name; missing folders are skipped, none at all is an error."""
    there = [f for f in folders if exists(spark, f)]
    if not there:
        raise FileNotFoundError(f"no graph document batches in {folders}")
    out = graph_batches(spark, there[0])
    for f in there[1:]:
        out = out.unionByName(graph_batches(spark, f), allowMissingColumns=True)
    name = F.element_at(F.split("file", "/"), -1)
    return out.orderBy(F.expr("substring_index(file, '/', size(split(file, '/')) - 1)"), name)


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content); a path that is not there is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.format("binaryFile").load(path)


def lines(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """(ordinal, value) of the lines of files without a header, of any size: a line's place, from 0, in the files by path is its key.

    Files are split as any text; a split's rows come in order, so (file, first byte of the split, row) is a line's place.
    """
    rows = spark.read.text(path).select(F.col("value").alias(name), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    return positions(rows, ["_file", "_start", "_row"], name="ordinal").select("ordinal", name)


def vectors(spark: SparkSession, path: str, other: str) -> DataFrame:
    """A table of vectors, from ``other`` where ``path`` is not there."""
    return spark.read.parquet(path if exists(spark, path) else other)


def request(spark: SparkSession, image_path: str | None = None, text_input: str = "") -> DataFrame:
    """One request as one row."""
    return spark.createDataFrame([(image_path, text_input)], "image_path string, text_input string")


def next_part(names: DataFrame, col: str = "name") -> int:
    """The number after the largest of the ``part_00012...`` names; 0 if there is none."""
    row = names.filter(F.col(col).rlike(r"^part_\d+")).agg(F.max(F.regexp_extract(col, r"^part_(\d+)", 1).cast("int")).alias("n")).first()
    return 0 if row["n"] is None else row["n"] + 1


def append_part(df: DataFrame, folder: str, per_file: int = 50_000) -> str:
    """``df`` as the next numbered part below ``folder``: a folder of snappy files of up to 50,000 rows; an earlier part is never
    touched, so a run that was cut short goes on after the last whole one."""
    spark = df.sparkSession
    names = names_in(spark, folder)
    path = f"{folder}/part_{next_part(spark.createDataFrame([(n,) for n in names], 'name string')):05d}"
    write(df, path, "parquet", "error", per_file)
    return path


def append_batch(df: DataFrame, folder: str, batch: int) -> None:
    """``df`` as the batch of that number; written again, it replaces itself and no other batch."""
    df.write.mode("overwrite").parquet(f"{folder}/graph_docs_batch_{batch}")


def replace_state(df: DataFrame, path: str, keep: int = 2) -> None:
    """Writes a state table's next version, also from a DataFrame that reads it, and deletes all but the newest ``keep``. A
    version counts when its writer has finished; until then, also after a crash, readers see the one before."""
    spark = df.sparkSession
    newest = max([int(n[1:]) for n in names_in(spark, path) if n.startswith("v") and n[1:].isdigit()], default=-1)
    write(df, f"{path.rstrip('/')}/v{newest + 1}", "parquet", "error")
    for n in _versions(spark, path)[keep:]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/v{n}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
