"""Session settings and readers of the input tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


T = TypeVar("T")


def session(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    """A session with UTC time, adaptive plans and Arrow; everything else is the cluster's business."""
    b = SparkSession.builder.appName("sextant")
    if master:
        b = b.master(master)
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in (conf | more).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, for clusters on which it is not installed: a zip of its modules, once a session."""
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="sextant-code-"), "sextant.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    z.write(whole, os.path.join("sextant", os.path.relpath(whole, root)))
    spark.sparkContext.addPyFile(path)


_SETTLED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only for a local master, whose threads share its disk."""
    base, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if base:
        return base.rstrip("/")
    if sc.master.split("[")[0] != "local":
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {sc.master} share")
    return "file://" + _SETTLED.setdefault(sc, [tempfile.mkdtemp(prefix="sextant-")])[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``forget`` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SETTLED.setdefault(spark.sparkContext, [None]).append(path)
    return path


def together(*jobs: Callable[[], T]) -> list[T]:
    """The results of independent jobs, which are run at the same time: small ones leave most cores idle one by one."""
    own = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(own(j)) for j in jobs]]


def settled(df: DataFrame) -> DataFrame:
    """A small result computed once and kept as Parquet in the shared folder: plans over it stay small and know its size."""
    spark = df.sparkSession
    path = scratch(spark, "settled")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Deletes what ``settled`` has written; for when no result that rests on it is read any more."""
    kept = _SETTLED.get(spark.sparkContext, [None])
    for path in kept[1:]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    del kept[1:]
