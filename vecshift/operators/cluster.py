"""Clustering: centroids, nearest-centroid assignment, best-of-n k-means."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import input_bytes, materialize

MAX_CENTERS_BYTES = 256 * 1024 * 1024


def group_centroids(df: DataFrame, group_col: str, vec_col: str = "embedding") -> DataFrame:
    """``(group, centroid)`` means per group; vector sums are combined map-side (JVM)."""
    return (df.select(group_col, array_to_vector(vec_col).alias("_v"))
            .groupBy(group_col).agg(Summarizer.mean(F.col("_v")).alias("_m"))
            .select(group_col, vector_to_array("_m").alias("centroid")))


def collect_centers(centroids: DataFrame, id_col: str, max_centers: int = 100_000) -> tuple[list, np.ndarray]:
    """Bring a centre table to the driver after checking its size (k × d doubles)."""
    k, d = centroids.agg(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
    if k > max_centers or k * (d or 0) * 8 > MAX_CENTERS_BYTES:
        raise ValueError(f"{k} centres of {d} numbers exceed the limits of {max_centers} and {MAX_CENTERS_BYTES} bytes")
    rows = centroids.orderBy(id_col).collect()
    ids = [r[id_col] for r in rows]
    centers = np.array([r["centroid"] for r in rows], dtype=np.float64)
    return ids, centers


def assign_nearest(df: DataFrame, centers: np.ndarray, vec_col: str = "embedding",
                   out: str = "cluster", ids: list | None = None) -> DataFrame:
    """Index (or id) of the nearest centre by squared Euclidean distance, lowest on ties.

    Centres are model-sized and travel once per executor as a broadcast; each
    Arrow batch is one matrix product, so no pair of (row, centre) is ever a row.
    """
    spark = df.sparkSession
    centers = np.asarray(centers, dtype=np.float64)
    bc = spark.sparkContext.broadcast((centers, None if ids is None else np.asarray(ids)))

    @F.pandas_udf(T.LongType())
    def _nearest(vectors: pd.Series) -> pd.Series:
        c, lookup = bc.value
        if len(vectors) == 0:
            return pd.Series([], dtype="int64")
        x = np.stack(vectors.to_numpy()).astype(np.float64, copy=False)
        least, idx = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
        # exact differences, one centre at a time (batch × d memory whatever the number of centres): ties resolve exactly
        for j in range(len(c)):
            diff = x - c[j]
            dist = np.einsum("ij,ij->i", diff, diff)
            closer = dist < least
            least[closer], idx[closer] = dist[closer], j
        return pd.Series(idx if lookup is None else lookup[idx]).astype("int64")

    return df.withColumn(out, _nearest.asNondeterministic()(F.col(vec_col)))


#: Most classes that k-means takes as its k: centres (k × d) live on the driver and in every task.
MAX_CLASSES = 10_000


#: Distances that a task holds at a time (rows × centres); a move below this share of a centre's length is rounding.
STEP_CELLS, ROUNDING = 2_000_000, 1e-13
#: Bytes of totals that one task of a step adds up before each set gets its own.
STEP_BYTES = 64 * 1024 * 1024
#: Bytes of input a task takes before a step has more tasks than there are task slots.
TASK_BYTES = 512 * 1024 * 1024


def _few_tasks(df: DataFrame) -> DataFrame:
    """``df`` in a task a slot, or one for each ``TASK_BYTES``: hundreds of steps each send every task's result to the driver."""
    size = input_bytes(df)
    if size is None:
        return df
    return df.coalesce(min(max(df.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES), 2**31 - 1))


def _centre_sums(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Per centre: sum of the rows nearest to it (lowest index on ties), their number, their squared distances."""
    k, d = centers.shape
    out = np.zeros((k, d + 2))
    half, step = (centers * centers).sum(axis=1) / 2, max(1, STEP_CELLS // k)
    for lo in range(0, len(x), step):
        part = x[lo:lo + step]
        dist = half - part @ centers.T
        idx = dist.argmin(axis=1)
        cost = np.maximum((part * part).sum(axis=1) + 2 * dist[np.arange(len(part)), idx], 0.0)
        order = np.argsort(idx, kind="stable")
        found, starts = np.unique(idx[order], return_index=True)
        out[found, :d] += np.add.reduceat(part[order], starts, axis=0)
        out[:, d] += np.bincount(idx, minlength=k)
        out[:, d + 1] += np.bincount(idx, weights=cost, minlength=k)
    return out


def lloyd_steps(vectors: DataFrame, starts: list[np.ndarray], vec_col: str, max_iter: int = 300,
                tol: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """Lloyd's steps from several sets of centres side by side: ``(centres, cost)`` of each.

    The vectors are kept as blocks, one an Arrow batch, in a bounded number of tasks (:func:`_few_tasks`). A step is one
    job for all sets that still move: every task sums its rows by nearest centre, the sums are added up by set, and only
    those totals (sets × k × d) reach the driver. A set stops when no centre with rows moved by more than ``tol``; a centre without rows stays. The cost is that of the
    last step, before its move.
    """
    fits, costs, moving = [np.array(c, dtype=np.float64) for c in starts], [0.0] * len(starts), list(range(len(starts)))
    d = fits[0].shape[1]

    def pack(batches):
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["block"])

    blocks = (_few_tasks(vectors.select(F.col(vec_col).cast("array<double>"))).mapInArrow(pack, "block BINARY").rdd
              .map(lambda r: np.frombuffer(r[0]).reshape(-1, d)).persist(StorageLevel.MEMORY_AND_DISK))
    sc, parts = vectors.sparkSession.sparkContext, blocks.getNumPartitions()
    for _ in range(max_iter):
        if not moving:
            break
        bc = sc.broadcast({i: fits[i] for i in moving})

        def sums(arrays):
            total = {}
            for x in arrays:
                for i, centers in bc.value.items():
                    more = _centre_sums(x, centers)
                    total[i] = total[i] + more if i in total else more
            return total.items()

        # small totals meet in one task, large ones in a task a set
        adders = min(len(moving), 1 + parts * sum(fits[i].nbytes for i in moving) // STEP_BYTES)
        totals = dict(blocks.mapPartitions(sums).reduceByKey(np.add, adders).collect())
        bc.destroy()
        moved = []
        for i in moving:
            used = totals[i][:, d] > 0
            to = totals[i][used, :d] / totals[i][used, d:d + 1]
            move, length = ((to - fits[i][used]) ** 2).sum(axis=1), (to * to).sum(axis=1)
            fits[i][used], costs[i] = to, float(totals[i][:, d + 1].sum())
            if (move > np.maximum(tol * tol, ROUNDING * ROUNDING * length)).any():
                moved.append(i)
        moving = moved
    blocks.unpersist()
    return list(zip(fits, costs))


def kmeans_best(df: DataFrame, k: int, vec_col: str = "embedding", seed: int = 42, n_init: int = 10,
                max_iter: int = 300, tol: float = 1e-4, out: str = "cluster") -> tuple[DataFrame, dict]:
    """Best of ``n_init`` k-means fits (seeds ``seed``, ``seed + 1``, ...); the lowest cost is kept (M5).

    The vectors are written once and cached. Spark ML draws the first centres of every seed (k-means||, as concurrent
    jobs); all fits then take their steps together, one job a step (:func:`lloyd_steps`). Returns the assignments and
    ``{"k", "cost", "seed"}`` of the kept fit. ``k`` is checked against ``MAX_CLASSES`` first.
    """
    if k > MAX_CLASSES:
        raise ValueError(f"k = {k} is over {MAX_CLASSES}: are the labels missing, so that every row is its own class?")
    data = materialize(df.withColumn("_features", array_to_vector(vec_col)), "kmeans-input")
    features = _few_tasks(data.select("_features")).persist()

    def first_centres(i):
        model = KMeans(k=k, seed=seed + i, maxIter=0, featuresCol="_features", predictionCol=out).fit(features)
        return np.array(model.clusterCenters(), dtype=np.float64)

    with ThreadPoolExecutor(max_workers=max(1, n_init)) as pool:
        starts = list(pool.map(first_centres, range(n_init)))
    features.unpersist()
    fits = lloyd_steps(data, starts, vec_col, max_iter, tol)
    best = min(range(n_init), key=lambda i: (fits[i][1], i))
    preds = assign_nearest(data.drop("_features"), fits[best][0], vec_col, out)
    return preds, {"k": k, "cost": float(fits[best][1]), "seed": seed + best}


def kmeans_v_measure(df: DataFrame, label_col: str = "label", vec_col: str = "embedding",
                     seed: int = 42, n_init: int = 10) -> float | None:
    """V-measure of best-of-n k-means with k = distinct labels; None when ≤ 1 class or too few rows."""
    from .metrics import v_measure
    stats = df.agg(F.countDistinct(label_col).alias("k"), F.count(F.lit(1)).alias("n")).first()
    k, n = int(stats["k"]), int(stats["n"])
    if k <= 1 or n < k:
        return None
    preds, _ = kmeans_best(df.select(label_col, vec_col), k, vec_col, seed, n_init)
    return float(v_measure(preds, label_col, "cluster").first()["v_measure"])
