import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from vecshift.operators.labels import factor_codes, label_mapping_json
from vecshift.session import ensure_parallelism, input_bytes


def _jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup())


def _aggregated(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return docs.join(counts, "lang")


def test_input_bytes_runs_no_job_and_ignores_join_blowup(spark):
    df = _aggregated(spark)
    before = _jobs(spark)
    size = input_bytes(df)
    assert _jobs(spark) == before
    # two reads of the documents file: the join does not inflate the figure
    one = input_bytes(spark.read.parquet(f"{SF_MID}/documents.parquet"))
    assert size == 2 * one


def test_ensure_parallelism_spreads_small_inputs_only(spark):
    df = _aggregated(spark)
    slots = spark.sparkContext.defaultParallelism
    before = _jobs(spark)
    spread = ensure_parallelism(df)
    kept = ensure_parallelism(df, small_bytes=0)
    assert _jobs(spark) == before
    assert spread.rdd.getNumPartitions() == 2 * slots
    assert "Repartition" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(spread.collect()) == sorted(df.collect())


def test_label_mapping_json_refuses_oversized_tables(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "row_id LONG, target STRING")
    codes = factor_codes(df)
    assert label_mapping_json(codes).first()["mapping"].startswith('{"0":"v0"')
    with pytest.raises(ValueError):
        label_mapping_json(codes, max_entries=4)
