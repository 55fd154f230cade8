import pytest

from vecshift.operators.clean import clean_corpus, dedup_first, head_rows, require_columns
from vecshift.operators.labels import decode_labels, factorize


def test_null_tokens(spark):
    vals = ["", "NA", "nan", "None", "null", "N/A", "na", " NA"]
    df = spark.createDataFrame([(i, v, "t") for i, v in enumerate(vals)], "id LONG, text STRING, target STRING")
    kept = [r.text for r in clean_corpus(df, order_col="id").orderBy("row_id").collect()]
    assert kept == ["na", " NA"]


def test_conflicting_dups_first_wins(spark):
    df = spark.createDataFrame([(0, "a", "x"), (1, "a", "y"), (2, "b", None), (3, "c", "x")],
                               "id LONG, text STRING, target STRING")
    c = clean_corpus(df, order_col="id")
    rows = [(r.row_id, r.text, r.target) for r in c.orderBy("row_id").collect()]
    assert rows == [(0, "a", "x"), (1, "b", None), (2, "c", "x")]
    coded, codes = factorize(c)
    assert {r.text: r.label for r in coded.collect()} == {"a": 0, "b": -1, "c": 0}
    back = decode_labels(coded, codes).collect()
    assert {r.text: r.value for r in back} == {"a": "x", "b": None, "c": "x"}


def test_dropna_false_gives_nan_string(spark):
    df = spark.createDataFrame([(0, None), (1, "x"), (2, None)], "id LONG, text STRING")
    c = clean_corpus(df, target_col=None, order_col="id", dropna=False, deduplicate=False)
    assert [r.text for r in c.orderBy("row_id").collect()] == ["nan", "x", "nan"]


def test_dedup_hot_key(spark):
    from pyspark.sql import functions as F
    df = spark.range(3000).select(F.col("id").alias("row_id"),
                                  F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
                                  .alias("text"))
    out = dedup_first(df, "text", "row_id")
    assert out.count() == 2001
    assert out.where("text = 'hot'").first().row_id == 0


def test_head_rows_and_columns(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id")
    assert head_rows(df, 3).count() == 3 and head_rows(df, None).count() == 10
    with pytest.raises(ValueError, match="lacks the column 'text'"):
        require_columns(df, ["text"])


def test_clean_corpus_bucketed_path_equals_single_bucket(spark):
    from conftest import SF_MID
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    one = clean_corpus(docs, "text", "lang", order_col="doc_id")
    many = clean_corpus(docs, "text", "lang", order_col="doc_id", rows_per_bucket=50)
    cols = ["row_id", "doc_id", "text", "target"]
    a = [tuple(r) for r in one.select(*cols).orderBy("row_id").collect()]
    b = [tuple(r) for r in many.select(*cols).orderBy("row_id").collect()]
    assert a == b
    assert [r[0] for r in a] == list(range(len(a)))


def test_clean_corpus_head_equals_first_rows(spark):
    from conftest import SF_MID
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    whole = clean_corpus(docs, "text", "lang", order_col="doc_id", rows_per_bucket=50).where("row_id < 123")
    head = clean_corpus(docs, "text", "lang", order_col="doc_id", rows_per_bucket=50, head=123)
    assert sorted(map(tuple, head.collect())) == sorted(map(tuple, whole.collect()))
    assert clean_corpus(docs, "text", "lang", order_col="doc_id", head=0).count() == 0
