"""Shared helpers of the training-data operators: shared tables, ids, checksums."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Everything but the six ASCII space characters is part of a word.
SPACE = r"[\x20\x09-\x0D]+"

_OWN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: Paths that a context's operators have written and nobody has deleted.
_KEPT: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a local master, whose executor threads see it; on a cluster each machine
    would write to its own disk and results would be incomplete, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {sc.master} share")
    if sc not in _OWN:
        _OWN[sc] = "file://" + tempfile.mkdtemp(prefix="sextant-shared-")
    return _OWN[sc]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/sextant/{name}-{uuid.uuid4().hex}"
    _KEPT.setdefault(spark.sparkContext, set()).add(path)
    return path


def kept_paths(spark: SparkSession) -> set[str]:
    """What operators have stored and not deleted; results that are read lazily still need some of it."""
    return set(_KEPT.get(spark.sparkContext, ()))


def sweep(spark: SparkSession, paths: set[str]) -> None:
    """Deletes stored tables (of ``kept_paths``) once nothing reads them any more."""
    for path in paths:
        remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts the lineage, outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote for frames that nothing will read again."""
    for df in frames:
        remove(df.sparkSession, df.stored_at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder through the file system that it belongs to."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _KEPT.get(spark.sparkContext, set()).discard(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
