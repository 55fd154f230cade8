"""Corpus cleaning: column checks, null rule, first-wins de-duplication, head N."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import null_if_token
from ..session import materialize
from .ordering import ROWS_PER_BUCKET, key_rank


def require_columns(df: DataFrame, columns: list[str], source: str = "input") -> None:
    """Raise ``ValueError`` naming the first missing column and the source."""
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"{source} lacks the column '{c}'; it has {', '.join(df.columns)}")


def first_places(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """The smallest ``order_col`` of every distinct ``key``, alone.

    A hash aggregate on 32-byte digests of the key (SHA-256), combined map-side, so a key that a third of all rows
    share leaves each map task as one narrow row. Null keys are one key.
    """
    digest = F.coalesce(F.unhex(F.sha2(F.col(key).cast("binary"), 256)), F.lit(b""))
    return df.groupBy(digest.alias("_digest")).agg(F.min(order_col).alias(order_col)).select(order_col)


def dedup_first(df: DataFrame, key: str = "text", order_col: str = "row_id") -> DataFrame:
    """Keep the first row (smallest ``order_col``, unique) of every distinct ``key`` (A1).

    The rows meet their first places in one semi-join on the order key: no text is sorted or compared.
    """
    return df.join(first_places(df, key, order_col), order_col, "left_semi").select(*df.columns)


def clean_corpus(df: DataFrame, text_col: str = "text", target_col: str | None = "target",
                 order_col: str = "row_id", dropna: bool = True, deduplicate: bool = True,
                 pandas_nulls: bool = True, row_id_col: str = "row_id", rows_per_bucket: int = ROWS_PER_BUCKET,
                 head: int | None = None) -> DataFrame:
    """Drop null text, keep the first copy of each text, select/rename, number rows.

    Output: ``row_id`` (dense, 0-based, in ``order_col`` order), ``order_col``
    (kept under its name when it differs), ``text``, ``target``. ``head`` keeps the first
    so many rows (L1), and only those are ranked.

    The order keys of the rows that stay are written alone and numbered; one join on them both drops the other rows
    and gives each its number, so a text moves once at most.
    """
    cols = [text_col, order_col] + ([target_col] if target_col else [])
    require_columns(df, cols)
    text = null_if_token(text_col) if pandas_nulls else F.col(text_col).cast("string")
    sel = [F.col(order_col).alias("_order"), text.alias("text")]
    if target_col:
        # the target goes through the same reader as the text
        target = F.col(target_col).cast("string")
        sel.append((null_if_token(target) if pandas_nulls else target).alias("target"))
    out = df.select(*sel)
    if dropna:
        out = out.where(F.col("text").isNotNull())
    places = materialize(first_places(out, "text", "_order") if deduplicate else out.select("_order"), "clean")
    ids = key_rank(places, "_order", rank_col="_row", rows_per_bucket=rows_per_bucket, first=head)
    if not dropna:
        # a kept missing text is written out as the string 'nan'
        out = out.withColumn("text", F.coalesce(F.col("text"), F.lit("nan")))
    ranked = out.join(ids, "_order").withColumnRenamed("_row", row_id_col)
    keep = [row_id_col] + ([] if order_col == row_id_col else [F.col("_order").alias(order_col)])
    return ranked.select(*keep, "text", *(["target"] if target_col else []))


def head_rows(df: DataFrame, n: int | None, row_id_col: str = "row_id") -> DataFrame:
    """First ``n`` rows (L1). ``row_id`` is dense from 0, so this is a filter, not a sort."""
    if n is None:
        return df
    return df.where(F.col(row_id_col) < F.lit(int(n)))
