"""Vector-table operators: normalise, pair, align checks, losses, stats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import as_float_vector, l2_normalize, row_mse


def normalize_vectors(df: DataFrame, col: str = "embedding", out: str | None = None,
                      as_float: bool = True) -> DataFrame:
    v = l2_normalize(col)
    return df.withColumn(out or col, as_float_vector(v) if as_float else v)


def to_long(df: DataFrame, id_col: str, vec_col: str, digits: int | None = 6,
            pos_col: str = "pos", value_col: str = "value") -> DataFrame:
    """``(id, pos, value)`` rows of a vector column, pos 0-based."""
    # the outer form infers no size filter on the vector (which could re-run a UDF below it)
    out = df.select(id_col, F.posexplode_outer(vec_col).alias(pos_col, value_col)) \
        .where(F.col(pos_col).isNotNull())
    v = F.col(value_col).cast("double")
    return out.withColumn(value_col, F.round(v, digits) if digits is not None else v)


def pair_embeddings(base: DataFrame, teacher: DataFrame, labels: DataFrame | None = None,
                    id_col: str = "row_id") -> DataFrame:
    """``(row_id, base, teacher[, label])`` by equi-join on the row key."""
    out = (base.select(id_col, F.col("embedding").alias("base"))
           .join(teacher.select(id_col, F.col("embedding").alias("teacher")), id_col))
    if labels is not None:
        out = out.join(labels.select(id_col, "label"), id_col)
    return out


def alignment_report(base: DataFrame, teacher: DataFrame, labels: DataFrame | None = None,
                     id_col: str = "row_id") -> DataFrame:
    """One row: counts, unmatched keys per side and dims per side."""
    b = base.select(id_col, F.size("embedding").alias("_bd"), F.lit(1).alias("_b"))
    t = teacher.select(id_col, F.size("embedding").alias("_td"), F.lit(1).alias("_t"))
    j = b.join(t, id_col, "full_outer")
    if labels is not None:
        j = j.join(labels.select(id_col, F.lit(1).alias("_l")), id_col, "full_outer")
    else:
        j = j.withColumn("_l", F.lit(None).cast("int"))
    n = lambda c: F.count(F.col(c)).cast("long")
    return j.agg(
        n("_b").alias("n_base"), n("_t").alias("n_teacher"),
        (n("_l") if labels is not None else F.lit(None).cast("long")).alias("n_labels"),
        F.sum(F.when(F.col("_b").isNotNull() & F.col("_t").isNull(), 1).otherwise(0)).cast("long")
        .alias("base_only"),
        F.sum(F.when(F.col("_t").isNotNull() & F.col("_b").isNull(), 1).otherwise(0)).cast("long")
        .alias("teacher_only"),
        F.min("_bd").alias("base_dim_min"), F.max("_bd").alias("base_dim_max"),
        F.min("_td").alias("teacher_dim_min"), F.max("_td").alias("teacher_dim_max"),
    )


def validate_alignment(base: DataFrame, teacher: DataFrame, labels: DataFrame | None = None,
                       id_col: str = "row_id") -> dict:
    """Raise ``ValueError`` unless both sides hold the same keys with one common dimension."""
    r = alignment_report(base, teacher, labels, id_col).first().asDict()
    if r["base_only"] or r["teacher_only"] or r["base_dim_min"] != r["base_dim_max"] \
            or r["teacher_dim_min"] != r["teacher_dim_max"] or r["base_dim_max"] != r["teacher_dim_max"]:
        raise ValueError(f"base and target vectors do not pair up: {r}")
    if labels is not None and r["n_labels"] != r["n_base"]:
        raise ValueError(f"{r['n_labels']} labels for {r['n_base']} vectors")
    return r


def embedding_stats(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Row count and dimension range (A4)."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                  F.min(F.size(col)).alias("dim_min"), F.max(F.size(col)).alias("dim_max"))


def mse_loss(df: DataFrame, pred: str = "adapted", target: str = "teacher",
             group_cols: list[str] | None = None) -> DataFrame:
    """Mean squared element error (A5); equal dims so the mean of row means."""
    g = df.groupBy(*(group_cols or []))
    return g.agg(F.avg(row_mse(pred, target)).alias("mse"),
                 F.count(F.lit(1)).cast("long").alias("n_rows"))


def batch_losses(df: DataFrame, pred: str = "adapted", target: str = "teacher",
                 batch_col: str = "batch_id") -> DataFrame:
    """Per-batch loss and size."""
    return df.groupBy(batch_col).agg(F.avg(row_mse(pred, target)).alias("loss"),
                                     F.count(F.lit(1)).cast("long").alias("n"))


def epoch_loss(batches: DataFrame) -> DataFrame:
    """Batch losses averaged by batch size."""
    return batches.agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))
