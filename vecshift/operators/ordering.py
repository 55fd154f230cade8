"""Exact global ranks without a one-partition sort.

``row_number() over (order by k)`` with no partition moves every row into one
task. Instead each row gets a *bucket* that is monotone in the order (leading
hex digits of a hash, or the quantile range of a key), rows are numbered
inside their bucket, and a running sum over the per-bucket counts gives each
bucket's offset. The count table has one row per bucket (not per row) and is
broadcast up to a fixed number of buckets.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, TimestampType

MAX_BUCKETS = 65536
ROWS_PER_BUCKET = 250_000  # rows one window task sorts (full rows)
SELECT_KEYS = 4096  # keys that a selection ends with on the driver, a rank
HASH_DIGITS = 32  # of md5


def global_rank(df: DataFrame, order_cols: list, bucket_cols: list[str],
                rank_col: str = "rank", n_buckets: int | None = None, first: int | None = None) -> DataFrame:
    """0-based dense position by ``order_cols``.

    ``bucket_cols`` must be non-decreasing in the order; ``order_cols`` must be
    unique per row. Offsets of more than ``MAX_BUCKETS`` buckets are not broadcast.
    With ``first``, only the rows of the least ``first`` keys come out: buckets that
    begin beyond them fall away before anything is sorted.
    """
    counts = df.groupBy(*bucket_cols).agg(F.count(F.lit(1)).alias("_bucket_rows"))
    running = Window.orderBy(*bucket_cols).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *bucket_cols,
        F.coalesce(F.sum("_bucket_rows").over(running), F.lit(0)).cast("long").alias("_bucket_offset"))
    within = Window.partitionBy(*bucket_cols).orderBy(*order_cols)
    if first is not None:
        offsets = offsets.where(F.col("_bucket_offset") < F.lit(int(first)))
    if n_buckets is None or n_buckets <= MAX_BUCKETS:
        offsets = F.broadcast(offsets)
    ranked = (df.join(offsets, bucket_cols)
              .withColumn(rank_col, (F.col("_bucket_offset") + F.row_number().over(within) - 1).cast("long"))
              .drop("_bucket_offset"))
    return ranked if first is None else ranked.where(F.col(rank_col) < F.lit(int(first)))


def hash_order_key(id_col: str, seed: int | str) -> Column:
    """Seeded pseudo-random order key: ``md5('<seed>:<id>')`` (hex string)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def seeded_rank(df: DataFrame, id_col: str = "row_id", seed: int | str = 42,
                rank_col: str = "rank", shuffle: bool = True, hex_digits: int | None = None,
                n: int | None = None) -> DataFrame:
    """Seeded permutation as a 0-based rank.

    Order is ``(md5('<seed>:<id>'), id)``; ``shuffle=False`` ranks by the id.
    Hash buckets are uniform, so no bucket is hot even if ids are clustered.
    A known row count ``n`` gives just enough leading hex digits for about
    ``ROWS_PER_BUCKET`` rows per bucket (one digit, 16 buckets, at least).
    """
    if not shuffle:
        return key_rank(df, id_col, rank_col=rank_col)
    keyed = df.withColumn("_order_h", hash_order_key(id_col, seed))
    if hex_digits is None:
        hex_digits = 4 if n is None else max(1, math.ceil(math.log(max(n, 1) / ROWS_PER_BUCKET, 16)))
    keyed = keyed.withColumn("_order_b", F.conv(F.substring("_order_h", 1, hex_digits), 16, 10).cast("long"))
    return global_rank(keyed, ["_order_h", id_col], ["_order_b"], rank_col, 16 ** hex_digits).drop("_order_h", "_order_b")


def seeded_keys_at(df: DataFrame, ranks: list[int], id_col: str = "row_id", seed: int | str = 42,
                   n: int | None = None) -> dict[int, tuple[str, object]]:
    """The keys ``(md5('<seed>:<id>'), id)`` at some 0-based ranks of the seeded order, by radix selection.

    No row is ranked or sorted. A histogram of leading hash digits tells the prefix that holds each rank; the rows of
    that prefix alone are counted by more digits, until at most ``SELECT_KEYS`` remain, whose distinct keys come to the
    driver. A histogram has at most 16^4 counts a rank. Repeated ids are one key; null ids have none and must not occur.
    """
    keyed = df.select(F.col(id_col).alias("_id"), hash_order_key(id_col, seed).alias("_h"))
    n = keyed.count() if n is None else n
    # by rank: the prefix of its key, its place among the rows with that prefix, and their number
    at = {r: ("", r, n) for r in ranks if 0 <= r < n}
    while wide := sorted({p for p, _, rows in at.values() if rows > SELECT_KEYS and len(p) < HASH_DIGITS}):
        most = max(rows for _, _, rows in at.values())
        depth = min(HASH_DIGITS, len(wide[0]) + min(4, math.ceil(math.log(most / SELECT_KEYS, 16)) + 1))
        counts = (keyed.where(F.substring("_h", 1, len(wide[0])).isin(wide))
                  .groupBy(F.substring("_h", 1, depth).alias("prefix")).count().orderBy("prefix").collect())
        for r, (p, place, _) in at.items():
            if p in wide:
                for c in counts:
                    if c["prefix"].startswith(p):
                        if place < c["count"]:
                            at[r] = (c["prefix"], place, c["count"])
                            break
                        place -= c["count"]
    prefixes = {p for p, _, _ in at.values()}
    if not prefixes:
        return {}
    mine = reduce(or_, (F.col("_h").startswith(p) for p in sorted(prefixes)))
    keys = sorted(tuple(r) for r in keyed.where(mine).groupBy("_h", "_id").count().collect())
    found = {}
    for r, (p, place, _) in at.items():
        for h, key, rows in keys:
            if h.startswith(p):
                if place < rows:
                    found[r] = (h, key)
                    break
                place -= rows
    return found


def key_boundaries(source: DataFrame, key: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[float]:
    """Quantile boundaries of ``key`` so each bucket holds about ``rows_per_bucket`` rows.

    Computed with Spark's distributed quantile sketch; only the boundaries reach the driver, at least three, so that
    small inputs take the same way as large ones.
    """
    n = source.count()
    buckets = max(4, math.ceil(n / rows_per_bucket))
    probs = [i / buckets for i in range(1, buckets)]
    qs = source.select(F.col(key).cast("double").alias(key)).approxQuantile(key, probs, 1.0 / (10 * buckets))
    return sorted(set(q for q in qs if q is not None and not math.isnan(q)))


def with_key_bucket(df: DataFrame, key: str, boundaries: list[float], out: str = "_key_b") -> DataFrame:
    """Bucket index of ``key`` against sorted boundaries (binary search in the JVM)."""
    if not boundaries:
        return df.withColumn(out, F.lit(0))
    splits = [-float("inf")] + list(boundaries) + [float("inf")]
    tmp = df.withColumn("_key_d", F.col(key).cast("double"))
    b = Bucketizer(splits=splits, inputCol="_key_d", outputCol=out, handleInvalid="keep")
    return b.transform(tmp).withColumn(out, F.col(out).cast("int")).drop("_key_d")


def key_rank(df: DataFrame, key: str, rank_col: str = "row_id", prefix_cols: list[str] | None = None,
             bucket_source: DataFrame | None = None, rows_per_bucket: int = ROWS_PER_BUCKET,
             boundaries: list[float] | None = None, first: int | None = None) -> DataFrame:
    """0-based dense rank by ``(*prefix_cols, key)`` (W1), ``key`` unique within a prefix; the ``first`` rows alone if given.

    ``key`` must be a number or a timestamp (its buckets are ranges of its value as a double): :func:`sorted_rank`
    takes any other type.

    Bucket boundaries come from ``bucket_source`` (default ``df``): passing the
    raw table before a filter keeps the sketch a cheap one-column scan, and the
    buckets stay monotone after any filter. ``boundaries`` passes ones already
    computed by :func:`key_boundaries`.
    """
    prefix_cols = list(prefix_cols or [])
    kind = df.schema[key].dataType
    if not isinstance(kind, (NumericType, TimestampType)):
        raise TypeError(f"{key} is {kind.simpleString()}: key_rank needs numbers or timestamps, other types take sorted_rank")
    bounds = boundaries if boundaries is not None else key_boundaries(
        bucket_source if bucket_source is not None else df.select(key), key, rows_per_bucket)
    keyed = with_key_bucket(df, key, bounds)
    ranked = global_rank(keyed, prefix_cols + [key], prefix_cols + ["_key_b"], rank_col,
                         None if prefix_cols else len(bounds) + 1, first)
    return ranked.drop("_key_b")


def with_batch_id(df: DataFrame, batch_size: int, rank_col: str = "rank",
                  out: str = "batch_id") -> DataFrame:
    """Fixed-size batches in rank order; the last may be short."""
    return df.withColumn(out, F.floor(F.col(rank_col) / F.lit(int(batch_size))).cast("long"))


def epoch_batches(df: DataFrame, batch_size: int, epoch: int, seed: int = 42,
                  id_col: str = "row_id") -> DataFrame:
    """Per-epoch reshuffled batches (W6): seeded rank with seed ``'<seed>:<epoch>'``."""
    ranked = seeded_rank(df, id_col, seed=f"{seed}:{epoch}", rank_col="_epoch_rank")
    return with_batch_id(ranked, batch_size, "_epoch_rank").drop("_epoch_rank")


def sorted_rank(df: DataFrame, order_cols: list[str], rank_col: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """0-based rank by any orderable, unique ``order_cols`` (strings included).

    Range partitioning gives partitions that are ordered ranges of the key; a
    reliable checkpoint then pins every row to its partition, which becomes the
    bucket of :func:`global_rank` (at most ``partitions`` buckets).
    """
    spark = df.sparkSession
    parts = partitions or spark.sparkContext.defaultParallelism
    staged = df.repartitionByRange(parts, *order_cols).withColumn("_part", F.spark_partition_id())
    staged = staged.checkpoint(eager=True)
    return global_rank(staged, order_cols, ["_part"], rank_col).drop("_part")
