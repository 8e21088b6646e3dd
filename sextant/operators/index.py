"""Vector search by index, and for many requests at once.

The index is an inverted file: cells are k-means centres, trained in Spark on a sample of documented size; every vector is in the
folder of its cell, and each cell knows how far its farthest vector lies from the centre. A search reads the cells whose centres
score best and scores their vectors exactly. As no vector of a cell can score more than centre score + radius x length of the
request, a search can also tell which further cells could hold a better one, and be exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import dot
from ..session import scratch
from .retrieval import top_k

#: Sampled rows for each cell that training reads at most.
SAMPLE_PER_CELL = 256
#: Requests that meet the vectors in one pass; scores that a task computes at a time and, beside the best, keeps before it sorts
#: them in. Bounds of a task's memory.
REQUESTS, SCORES = 4096, 1 << 18


@dataclass
class VectorIndex:
    """Where an index lies, the centres of its cells, and each cell's radius (minus one for a cell without vectors)."""

    path: str
    centres: np.ndarray
    radius: np.ndarray
    vectors: DataFrame


def cells_for(rows: int) -> int:
    """About the square root of the rows, so that a probe reads as many rows as there are centres."""
    return max(1, min(65_536, math.isqrt(rows)))


def trained_centres(vectors: DataFrame, cells: int, rows: int, per_cell: int = SAMPLE_PER_CELL, seed: int = 7, vec_col: str = "embedding") -> np.ndarray:
    """Centres of ``cells`` cells by k-means over about ``per_cell`` sampled rows a cell."""
    share = min(1.0, per_cell * cells / max(rows, 1))
    sample = vectors.select(F.col(vec_col).cast("array<double>").alias("v"))
    sample = (sample.sample(share, seed) if share < 1 else sample).select(array_to_vector("v").alias("features"))
    return np.array(KMeans(k=cells, maxIter=10, seed=seed).fit(sample).clusterCenters())


def build_index(vectors: DataFrame, cells: int | None = None, path: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7) -> VectorIndex:
    """An index of all rows with a vector, below ``path``: a folder a cell, large cells in several files.

    Rows go to their nearest centre in Arrow batches against the centres, which ``cells`` bounds.
    """
    spark = vectors.sparkSession
    path = path or scratch(spark, "vector-index")
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding")).filter("embedding IS NOT NULL")
    rows = own.count()
    if not rows:
        return VectorIndex(path, np.zeros((0, 0)), np.zeros(0), own.withColumn("cell", F.lit(0)))
    centres = trained_centres(own, min(cells or cells_for(rows), rows), rows, seed=seed)
    squares = np.square(centres).sum(1)

    @F.pandas_udf("struct<cell:int,far:double>")
    def nearest(column: pd.Series) -> pd.DataFrame:
        x = np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, centres.shape[1]))
        cell = (squares - 2 * x @ centres.T).argmin(1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "far": np.sqrt(np.square(x - centres[cell]).sum(1))})

    placed = own.withColumn("n", nearest("embedding")).select("vec_id", "embedding", "n.far", "n.cell")
    # rebalancing splits what one cell holds over several files, however full it is
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path)
    radius = np.full(len(centres), -1.0)
    for r in stored.groupBy("cell").agg(F.max("far").alias("far")).collect():  # a row a cell
        radius[r["cell"]] = r["far"]
    return VectorIndex(path, centres, radius, stored.drop("far"))


def search_index(index: VectorIndex, request: list[float], k: int, probes: int | None = 8, exact: bool = False) -> DataFrame:
    """(vec_id, score, rank) of the ``k`` best of the ``probes`` cells whose centres score best; of all cells if ``probes`` is
    None. With ``exact``, the cells that could hold a better vector than the k-th so found are read too: the same rows as a scan."""
    q = np.asarray(request, float)
    spark = index.vectors.sparkSession
    one = spark.createDataFrame([(q.tolist(),)], "_q array<double>")

    def over(rows: DataFrame) -> DataFrame:
        return rows.crossJoin(F.broadcast(one)).select("vec_id", F.round(dot(F.col("embedding"), F.col("_q")), 6).alias("score"))

    filled = np.flatnonzero(index.radius >= 0)
    if probes is None or len(filled) <= probes:
        return top_k(over(index.vectors), k)
    near = index.centres @ q
    order = filled[np.argsort(-near[filled], kind="stable")]
    chosen = order[:probes].tolist()
    found = top_k(over(index.vectors.filter(F.col("cell").isin(chosen))), k)
    if not exact:
        return found
    worst = found.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
    best = near + index.radius * np.linalg.norm(q)
    # scores are rounded: half a unit of the last digit, and rounding of the bound itself
    more = [int(c) for c in order if worst["n"] < k or best[c] >= worst["least"] - 1e-6]
    return top_k(over(index.vectors.filter(F.col("cell").isin(sorted(set(chosen) | set(more))))), k)


def calibrated_probes(index: VectorIndex, k: int = 10, recall: float = 0.9, requests: int = 64, seed: int = 3) -> int:
    """The fewest probes that find ``recall`` of the ``k`` best rows of about ``requests`` sampled rows, by comparison with a scan."""
    rows = index.vectors.count()
    if not rows:
        return 1
    asked = index.vectors.sample(min(1.0, requests / rows), seed).limit(2 * requests).select(F.col("vec_id").alias("req_id"), "embedding").collect()
    if not asked:
        return len(index.centres)
    spark = index.vectors.sparkSession
    best = batch_top_k(index.vectors, spark.createDataFrame(asked, index.vectors.selectExpr("vec_id AS req_id", "embedding").schema), k)
    cells = {(r["req_id"], r["vec_id"]): r["cell"] for r in best.join(index.vectors.select("vec_id", "cell"), "vec_id").select("req_id", "vec_id", "cell").collect()}
    places = []
    for r in asked:
        near = np.where(index.radius >= 0, index.centres @ np.asarray(r["embedding"], float), -np.inf)
        place = np.argsort(np.argsort(-near, kind="stable"), kind="stable")
        places += [int(place[c]) for (req, _), c in cells.items() if req == r["req_id"]]
    return int(np.sort(places)[max(0, math.ceil(recall * len(places)) - 1)]) + 1


def batch_top_k(vectors: DataFrame, requests: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", at_once: int = REQUESTS) -> DataFrame:
    """(req_id, vec_id, score, rank): for each of ``requests`` (req_id, embedding) the ``k`` best rows, ties by id.

    Requests are sent to the vectors in passes of about ``at_once``; a task keeps the k best of each request while it reads its
    vectors, so what leaves it is k rows a request, and only those are ranked. Rows and requests without a vector are dropped.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    asked = requests.select(F.col("req_id").cast("long").alias("req_id"), F.col("embedding").cast("array<double>").alias("v")).filter("v IS NOT NULL AND req_id IS NOT NULL")
    passes = max(1, math.ceil(asked.count() / at_once))
    out = None
    for p in range(passes):
        block = asked.filter(F.pmod(F.xxhash64("req_id"), F.lit(passes)) == p).collect()
        part = _one_pass(own, np.array([r["req_id"] for r in block], np.int64), np.array([r["v"] for r in block], float), k)
        out = part if out is None else out.union(part)
    order = W.partitionBy("req_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _one_pass(vectors: DataFrame, names: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    strip = max(1, SCORES // max(1, len(names)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        least = np.full(len(names), -np.inf)
        new, waiting = [], 0

        def sorted_in() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The k best of each request among those so far and the waiting ones; lifts what the next must reach."""
            at, score, ids = (np.concatenate(x) for x in zip(best, *new, strict=True))
            order = np.lexsort((ids, -score, at))
            at, score, ids = at[order], score[order], ids[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            last = place == k - 1
            least[at[last]] = score[last]
            return at[place < k], score[place < k], ids[place < k]

        for pdf in batches:
            for a in range(0, len(pdf) if len(names) else 0, strip):
                own = pdf["vec_id"].to_numpy()[a : a + strip]
                s = q @ np.stack(pdf["v"].to_numpy()[a : a + strip]).T
                np.round(s, 6, out=s)
                r, c = np.nonzero(s >= least[:, None])
                new.append((r, s[r, c], own[c]))
                waiting += len(r)
                if waiting >= SCORES:
                    best = sorted_in()
                    new, waiting = [], 0
        at, score, ids = sorted_in()
        yield pd.DataFrame({"req_id": names[at], "vec_id": ids, "score": score})

    return vectors.mapInPandas(run, "req_id long, vec_id long, score double")
