"""Evaluation aggregates: classes, contingency, V-measure, best epoch, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def num_classes(df: DataFrame, label_col: str = "label", group_cols: list[str] | None = None) -> DataFrame:
    """Distinct labels (A3) and rows, per group."""
    return df.groupBy(*(group_cols or [])).agg(
        F.countDistinct(label_col).cast("long").alias("n_classes"),
        F.count(F.lit(1)).cast("long").alias("n_rows"))


def contingency(df: DataFrame, label_col: str = "label", cluster_col: str = "cluster",
                group_cols: list[str] | None = None) -> DataFrame:
    """``(label, cluster, n)`` counts (A8); combined map-side, so hot cells are cheap."""
    g = list(group_cols or [])
    return df.groupBy(*g, F.col(label_col).alias("label"), F.col(cluster_col).alias("cluster")) \
        .agg(F.count(F.lit(1)).cast("long").alias("n"))


def _xlogx(c: Column) -> Column:
    return F.when(c > 0, c * F.log(c)).otherwise(F.lit(0.0))


def v_measure_from_contingency(cont: DataFrame, group_cols: list[str] | None = None,
                               beta: float = 1.0) -> DataFrame:
    """Homogeneity, completeness and V-measure (natural log) from ``(label, cluster, n)``.

    With N rows, a_i class sizes and b_j cluster sizes:
    MI = ln N + (Σ n ln n − Σ a ln a − Σ b ln b)/N, H(C) = ln N − Σ a ln a / N,
    H(K) = ln N − Σ b ln b / N. The three sums come from one aggregate over
    the cells and both margins stacked together.
    """
    g = list(group_cols or [])
    cells = cont.select(*g, F.lit("ij").alias("kind"), F.col("n").cast("double").alias("m"))
    rows = cont.groupBy(*g, "label").agg(F.sum("n").cast("double").alias("m")) \
        .select(*g, F.lit("a").alias("kind"), "m")
    cols = cont.groupBy(*g, "cluster").agg(F.sum("n").cast("double").alias("m")) \
        .select(*g, F.lit("b").alias("kind"), "m")
    stacked = cells.unionByName(rows).unionByName(cols)

    def s(kind):
        return F.sum(F.when(F.col("kind") == kind, _xlogx(F.col("m"))).otherwise(0.0))

    agg = stacked.groupBy(*g).agg(
        F.sum(F.when(F.col("kind") == "ij", F.col("m")).otherwise(0.0)).alias("N"),
        s("ij").alias("s_ij"), s("a").alias("s_a"), s("b").alias("s_b"))
    n = F.col("N")
    ln_n = F.log(n)
    mi = ln_n + (F.col("s_ij") - F.col("s_a") - F.col("s_b")) / n
    h_c = ln_n - F.col("s_a") / n
    h_k = ln_n - F.col("s_b") / n
    eps = 1e-15
    # entropies and MI of exactly-equal partitions can be off by a few ulps
    h = F.when(F.abs(h_c) < eps, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mi / h_c)))
    c = F.when(F.abs(h_k) < eps, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mi / h_k)))
    out = agg.select(*g, h.alias("homogeneity"), c.alias("completeness"))
    hh, cc = F.col("homogeneity"), F.col("completeness")
    v = F.when(hh + cc == 0, F.lit(0.0)).otherwise((1 + beta) * hh * cc / (beta * hh + cc))
    return out.withColumn("v_measure", v)


def v_measure(df: DataFrame, label_col: str = "label", cluster_col: str = "cluster",
              group_cols: list[str] | None = None, beta: float = 1.0) -> DataFrame:
    return v_measure_from_contingency(contingency(df, label_col, cluster_col, group_cols), group_cols, beta)


def best_by(df: DataFrame, value_col: str, order_col: str, mode: str = "max",
            group_cols: list[str] | None = None) -> DataFrame:
    """Top-1 row by ``value_col`` (``max``/``min``), smallest ``order_col`` on ties (A10).

    A plain aggregate (partial + final), so it scales with groups, not rows.
    """
    mode = mode.lower()
    if mode not in ("max", "min"):
        raise ValueError(f"mode must be min or max, not {mode}")
    g = list(group_cols or [])
    v = F.col(value_col)
    base = df.where(v.isNotNull() & ~F.isnan(v.cast("double")))
    if mode == "max":
        best = F.max(F.struct(v.alias("v"), (-F.col(order_col)).alias("o")))
        return base.groupBy(*g).agg(best.alias("_b")).select(
            *g, (-F.col("_b.o")).alias(order_col), F.col("_b.v").alias(value_col))
    best = F.min(F.struct(v.alias("v"), F.col(order_col).alias("o")))
    return base.groupBy(*g).agg(best.alias("_b")).select(
        *g, F.col("_b.o").alias(order_col), F.col("_b.v").alias(value_col))


def best_epoch(metrics: DataFrame, metric: str, mode: str = "max") -> DataFrame:
    """Best epoch of one monitored metric in a long metrics table ``(stage, epoch, metric, value)``."""
    return best_by(metrics.where(F.col("metric") == metric), "value", "epoch", mode)


def per_row_ms(seconds: Column, rows: Column) -> Column:
    """Milliseconds per row; null when there are no rows."""
    return F.try_divide(seconds.cast("double"), F.when(rows > 0, rows.cast("double"))) * F.lit(1e3)


def speedup(slow_seconds: Column, fast_seconds: Column) -> Column:
    """``slow / fast``; null when ``fast`` is zero or missing."""
    return F.try_divide(slow_seconds.cast("double"), F.when(fast_seconds > 0, fast_seconds.cast("double")))


def quality_gap(teacher_v: Column, pred_v: Column) -> Column:
    """Relative V-measure loss against the teacher (A12); the documented target is ≤ 0.10."""
    return F.try_divide(teacher_v - pred_v, F.when(teacher_v != 0, teacher_v))
