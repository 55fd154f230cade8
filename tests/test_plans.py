from pyspark.sql import functions as F

from conftest import SF_MID
from vecshift.operators.clean import dedup_first
from vecshift.operators.encode import HashEncoder, encode_text
from vecshift.operators.labels import encode_labels, factor_codes
from vecshift.operators.split import assign_split, split_rows


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_aggregates_digests_and_moves_texts_once(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    df = dedup_first(docs.select(F.col("doc_id").alias("_order"), "text", F.col("lang").alias("target")),
                     "text", "_order")
    plan = _plan(df)
    assert "SortAggregate" not in plan and "HashAggregate" in plan and "hashpartitioning(text" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
    assert "n_chars" not in plan and "LeftSemi" in plan
    left = plan.split("LeftSemi")[1].split("BroadcastExchange")[0]
    assert "Exchange" not in left  # few first places: the rows stay where they are


def test_split_plans_carry_no_text(spark):
    ids = spark.read.parquet(f"{SF_MID}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text")
    plan = _plan(assign_split(ids, n=1000))
    assert "text#" not in plan
    # the one task that sums up is over a row a bucket, aggregated before
    assert plan.count("SinglePartition") == 1 and "HashAggregate" in plan.split("SinglePartition")[1]


def test_split_by_selection_moves_no_row(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").withColumnRenamed("doc_id", "row_id")
    assert "Exchange" not in _plan(split_rows(docs))


def test_labels_of_a_small_code_table_leave_rows_where_they_are(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("target"))
    plan = _plan(encode_labels(docs, factor_codes(docs)).select("row_id", "label"))
    assert "BroadcastHashJoin" in plan and "hashpartitioning(target" not in plan.split("BroadcastExchange")[0]


def test_filter_before_encoder_reaches_the_scan(spark):
    # the encoder column is non-deterministic for the optimiser (it must not be
    # copied into inferred filters), so filters belong before encode_text
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text", "lang")
    enc = encode_text(docs.where(F.col("lang") == "en"), HashEncoder(16)).select("doc_id", "embedding")
    plan = _plan(enc)
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    assert "source" not in plan.split("ReadSchema")[1].split("\n")[0]
