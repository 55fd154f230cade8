"""Target codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.npy import read_npy
from .ordering import key_rank

#: Code tables of up to this many rows are broadcast; rows meet larger ones over this many tasks a target.
BROADCAST_CODES, SALTS = 200_000, 16


def factor_codes(df: DataFrame, target_col: str = "target", order_col: str = "row_id") -> DataFrame:
    """``(label, value)``: dense codes of the non-null targets by first appearance (A2).

    The per-target minimum is combined map-side, so a hot target costs nothing
    extra; the distinct table is then ranked without a one-partition sort.
    """
    firsts = (df.where(F.col(target_col).isNotNull())
              .groupBy(F.col(target_col).alias("value"))
              .agg(F.min(order_col).alias("_first")))
    return key_rank(firsts, "_first", rank_col="label").select("label", "value")


def encode_labels(df: DataFrame, codes: DataFrame, target_col: str = "target",
                  out: str = "label") -> DataFrame:
    """Attach the code of each row's target; a null target gets −1.

    A code table that was counted as small is broadcast, so rows stay where they are. A larger one meets rows that
    are dealt by target and salt: a target that a third of all rows have is spread over ``SALTS`` tasks.
    """
    c = codes.select(F.col("value").alias("_value"), F.col("label").alias("_code"))
    if codes.count() <= BROADCAST_CODES:
        joined = df.join(F.broadcast(c), df[target_col] == c["_value"], "left")
    else:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
        each = c.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(each, (F.col(target_col) == F.col("_value")) & (F.col("_salt") == F.col("_salt2")), "left").drop("_salt", "_salt2")
    return joined.withColumn(out, F.coalesce(F.col("_code"), F.lit(-1)).cast("long")).drop("_value", "_code")


def factorize(df: DataFrame, target_col: str = "target", order_col: str = "row_id",
              out: str = "label") -> tuple[DataFrame, DataFrame]:
    """``(df with label, codes)`` — ``pd.factorize`` semantics on a row-ordered table."""
    codes = materialize(factor_codes(df, target_col, order_col), "codes")
    return encode_labels(df, codes, target_col, out), codes


def decode_labels(df: DataFrame, codes: DataFrame, label_col: str = "label",
                  out: str = "value") -> DataFrame:
    """Back from code to value; −1 and unknown codes give null."""
    c = codes.select(F.col("label").alias("_code"), F.col("value").alias(out))
    return df.join(c, df[label_col] == c["_code"], "left").drop("_code")


MAX_MAPPING_ENTRIES = 1_000_000


def label_mapping_json(codes: DataFrame, max_entries: int = MAX_MAPPING_ENTRIES) -> DataFrame:
    """One-row ``mapping`` JSON object ``{"0": value, …}``.

    The object is one value, built by one task, so the code table is counted
    first and refused beyond ``max_entries`` (the ``(label, value)`` table
    itself is the form for larger dictionaries).
    """
    n = codes.count()
    if n > max_entries:
        raise ValueError(f"{n} codes exceed {max_entries} for a single JSON mapping; "
                         "write the (label, value) table instead")
    entries = F.array_sort(F.collect_list(F.struct(F.col("label").alias("k"), F.col("value").alias("v"))))
    as_str = F.transform(entries, lambda e: F.struct(e["k"].cast("string").alias("k"), e["v"].alias("v")))
    return codes.agg(F.to_json(F.map_from_entries(as_str)).alias("mapping"))


def load_labels(spark, path: str | None, rows: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Stored ``(row_id, label)`` (a table, or ``.npy`` by position: a file or a folder of shards) or, when absent, each row its own class.

    Raises when stored labels do not cover exactly the given rows.
    """
    if path is None:
        return rows.select(id_col, F.col(id_col).cast("long").alias("label"))
    if path.endswith(".npy"):
        labels = read_npy(spark, path, "labels").withColumnRenamed("row_id", id_col)
    else:
        labels = spark.read.parquet(path).select(id_col, F.col("label").cast("long"))
    check = (rows.select(id_col).withColumn("_r", F.lit(1))
             .join(labels.select(id_col).withColumn("_l", F.lit(1)), id_col, "full_outer")
             .agg(F.sum(F.when(F.col("_r").isNull() | F.col("_l").isNull(), 1).otherwise(0)).alias("bad"))
             .first())
    if check["bad"]:
        raise ValueError(f"{check['bad']} ids have either a label or a vector, but not both")
    return labels
