"""Stage evaluation of an adapter: loss, V-measure of mapped and teacher vectors."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .cluster import kmeans_v_measure
from .project import AdapterModel
from .vectors import mse_loss


def class_count(df: DataFrame, label_col: str = "label") -> tuple[int, int]:
    r = df.agg(F.countDistinct(label_col).alias("k"), F.count(F.lit(1)).alias("n")).first()
    return int(r["k"]), int(r["n"])


def teacher_v_measure(df: DataFrame, seed: int = 42, n_init: int = 10, label_col: str = "label",
                      teacher_col: str = "teacher") -> float | None:
    """V-measure of k-means on the teacher vectors; constant across epochs, so computed once."""
    return kmeans_v_measure(df.select(label_col, F.col(teacher_col).alias("embedding")), label_col,
                            "embedding", seed, n_init)


def evaluate_adapter(df: DataFrame, model: AdapterModel, stage: str, seed: int = 42, n_init: int = 10,
                     teacher_v=None, label_col: str = "label", base_col: str = "base",
                     teacher_col: str = "teacher") -> dict[str, float | None]:
    """``{stage}_loss``, ``{stage}_v_measure_pred`` and ``{stage}_v_measure_teacher`` (M6).

    ``teacher_v`` is the teacher's score when already known: a float, or a
    future that is only waited for after the adapter's own fit, so both fits
    overlap. None computes it here, next to the adapter's fit.
    The V-measures are skipped (absent) with ≤ 1 class or fewer rows than classes.
    """
    # written once: the loss, the class count and every k-means fit read it back
    projected = materialize(model.transform(df.select(label_col, base_col, teacher_col), base_col, "adapted"), "evaluate")
    out = {f"{stage}_loss": mse_loss(projected, "adapted", teacher_col).first()["mse"]}
    k, n = class_count(projected, label_col)
    if k > 1 and n >= k:
        pred_in = projected.select(label_col, F.col("adapted").alias("embedding"))
        with ThreadPoolExecutor(max_workers=2) as pool:
            # the two sets of restarts are independent jobs: run them side by side
            pred = pool.submit(kmeans_v_measure, pred_in, label_col, "embedding", seed, n_init)
            teach = None if teacher_v is not None else pool.submit(
                teacher_v_measure, projected, seed, n_init, label_col, teacher_col)
            out[f"{stage}_v_measure_pred"] = pred.result()
            known = teacher_v if teach is None else teach
            out[f"{stage}_v_measure_teacher"] = known.result() if hasattr(known, "result") else known
    return out


def quality_gap_value(teacher_v: float | None, pred_v: float | None) -> float | None:
    """``(v_teacher − v_pred) / v_teacher`` (A12); None when undefined."""
    if teacher_v is None or pred_v is None or teacher_v == 0:
        return None
    return (teacher_v - pred_v) / teacher_v


def measure_projection(df: DataFrame, model: AdapterModel, base_col: str = "base",
                       warmup: bool = True) -> tuple[float, float | None, int]:
    """Seconds to project ``df`` (forced through the ``noop`` sink), per-row seconds, rows (M8)."""
    projected = model.transform(df.select(base_col), base_col, "adapted").select("adapted")
    if warmup:
        projected.limit(1).write.format("noop").mode("overwrite").save()
    start = time.perf_counter()
    projected.write.format("noop").mode("overwrite").save()
    total = time.perf_counter() - start
    n = df.count()
    return total, (total / n if n else None), n
