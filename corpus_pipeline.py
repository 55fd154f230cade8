"""The corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents; rows that a stage rejects are gone for
the stages after it.

Defined results: null texts are empty texts; empty tables pass through as empty tables; columns that
documents does not have, and repeated rows, are carried along (near-duplicates keep one row of a group).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecshift.llm.common import fresh, table
from vecshift.llm.decontaminate import remove_leaks
from vecshift.llm.mixing import mix_sources
from vecshift.llm.pii import find_personal_data, redact
from vecshift.llm.quality import fit_quality, not_held_out, score_quality
from vecshift.llm.simhash import keep_one_row
from vecshift.session import checkpoint_dir, scratch_path

#: Documents that score less are rejected: the threshold of the quality classifier's contract.
QUALITY_THRESHOLD = 0.3
#: Shingle length in words and most differing bits, as in the contract of the SimHash operator.
SHINGLE, RADIUS = 3, 3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; its model is learned from the rows that its query learns from."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), allowed=not_held_out())
    score = fresh(docs, "quality_score")
    return score_quality(docs, model, out=score).filter(F.col(score) >= QUALITY_THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each group; rows near no other stay, whatever their ids."""
    return keep_one_row(docs, shingle=SHINGLE, radius=RADIUS).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return remove_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` is that of the new text."""
    base, spans = fresh(docs, "base"), fresh(docs, "spans")
    clean = redact(find_personal_data(docs, base_col=base, spans_col=spans), spans_col=spans)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return clean.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("mixture", mixture)]

#: No SQL: the classifier, fingerprints and mixture are not expressible; tests hold each stage against its own brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``, each written under the checkpoint folder and read again."""
    checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    base = scratch_path(spark, "corpus-pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = os.path.join(base, f"{i}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
