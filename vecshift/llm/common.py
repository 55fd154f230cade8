"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Largest table that is broadcast after its rows were counted; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(col: str | Column = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array where there is none."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once (inside higher-order functions)."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes not to be a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has at most BROADCAST_ROWS rows, else as it is.

    Count a written table only: the count is a job over its footers then.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def bounded_labels(labels: DataFrame, label: str, per_class: int, key: str = "doc_id") -> DataFrame:
    """Up to ``per_class`` labelled ids of each class 0 and 1, the same ones on every run.

    Ids come in the order of their hash, so the choice follows neither id nor file order. One row
    per id: of conflicting labels the smaller holds. Null ids and null labels are left out.
    """
    clean = (labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label"))
             .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
             .groupBy("doc_id").agg(F.min("label").alias("label")))
    order = F.xxhash64("doc_id", F.lit(11))
    parts = [clean.filter(F.col("label") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1])
