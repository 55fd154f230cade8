import os
import time

import pytest
from pyspark.sql import functions as F

from vecshift.operators.encode import HashEncoder
from vecshift.plans.catalog import all_queries
from vecshift.plans import queries
from vecshift.plans.infer import infer_corpus
from vecshift.plans.oracle import PROMPT
from vecshift.plans.preprocess import preprocess_corpus
from vecshift.plans.train import TrainConfig, train_pipeline
from vecshift.operators.project import analytic_teacher_model
from vecshift.session import checkpoint_dir, list_folders, path_exists, scratch_path
from vecshift.sources.corpus import read_corpus_csv, read_corpus_jsonl, write_corpus_csv
from vecshift.streaming.encode_stream import encode_stream, stream_corpus

from conftest import SF_MID, SF_SMALL


def test_preprocess_train_infer(spark):
    out = scratch_path(spark, "t-pre")
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    enc = HashEncoder(64)
    first = preprocess_corpus(spark, docs, out, enc, PROMPT, "text", "lang", order_col="doc_id")
    assert not first["cached"] and first["metadata"]["num_samples"] == 927
    again = preprocess_corpus(spark, docs, out, enc, PROMPT, "text", "lang", order_col="doc_id")
    assert again["cached"]
    emb = first["embeddings"]
    base = spark.read.parquet(f"{emb}/base")
    teacher = spark.read.parquet(f"{emb}/instruct")
    labels = spark.read.parquet(f"{emb}/labels")
    res = train_pipeline(spark, base, teacher, labels, TrainConfig(l2=1e-8, n_init=3),
                         out_dir=scratch_path(spark, "t-train"))
    names = {r.metric for r in res.metrics.collect()}
    assert {"train_loss", "val_loss", "val_v_measure_pred", "test_v_measure_teacher", "test_loss"} <= names
    assert res.summary["test_loss"] < 5e-4
    # the documented gate: mapped vectors cluster within 10 % of the teacher
    assert res.summary["test_quality_gap"] is not None and res.summary["test_quality_gap"] <= 0.10

    ckpt = res.model.save(spark, scratch_path(spark, "t-ckpt"))
    csv = scratch_path(spark, "t-bench")
    write_corpus_csv(spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").orderBy("item_id"), csv)
    outd = scratch_path(spark, "t-infer")
    r1 = infer_corpus(spark, csv, outd, ckpt, enc, PROMPT, "text", limit=30)
    assert not r1["cached"] and r1["metadata"]["num_samples"] == 30
    assert spark.read.parquet(f"{outd}/adapter").count() == 30
    assert spark.read.parquet(f"{outd}/teacher").count() == 30
    r2 = infer_corpus(spark, csv, outd, ckpt, enc, PROMPT, "text", limit=30)
    assert r2["cached"]


def test_gd_solver_pipeline(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    base = emb.select(F.col("vec_id").alias("row_id"), "embedding")
    labels = emb.select(F.col("vec_id").alias("row_id"), F.col("label").cast("long").alias("label"))
    res = train_pipeline(spark, base, base, labels,
                         TrainConfig(solver="gd", epochs=3, n_init=2, eval_every=2,
                                     optimizer={"name": "sgd", "lr": 0.1, "momentum": 0.9}))
    epochs = {r.epoch for r in res.metrics.where("metric = 'val_loss'").collect()}
    assert epochs == {0, 2} and res.best_epoch in epochs
    rows = res.metrics.collect()
    names = {r.metric for r in rows}
    assert {"test_loss", "test_v_measure_pred", "test_v_measure_teacher", "adapter_latency_sec"} <= names
    assert {r.epoch for r in rows if r.stage == "test"} == {res.best_epoch}


def test_unknown_solver_is_rejected(spark):
    import pytest
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    base = emb.select(F.col("vec_id").alias("row_id"), "embedding")
    with pytest.raises(ValueError):
        train_pipeline(spark, base, base, None, TrainConfig(solver="lbfgs"), validate=False)


def test_stream_encode(spark):
    stream = stream_corpus(spark, SF_SMALL, "doc_id LONG, text STRING", glob="documents.parquet")
    out = encode_stream(stream, HashEncoder(16))
    q = out.writeStream.format("memory").queryName("enc_t").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) FROM enc_t").first()[0] == 200


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_query_reads_a_table_that_is_a_file_or_a_folder(spark, tmp_path, parts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "NA", None, "c", "a  a"])], "doc_id LONG, text STRING")
    docs.repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    if parts == 1:
        part = next((tmp_path / "documents.parquet").glob("part-*"))
        (tmp_path / "one").mkdir()
        part.rename(tmp_path / "one" / "documents.parquet")
    sf_dir = str(tmp_path / "one") if parts == 1 else str(tmp_path)
    got = all_queries()["stream_hash_encode"](spark, sf_dir)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {0, 3, 4}


def scratch_tables(spark):
    """Scratch tables of any size; a cleaned corpus also leaves its order keys."""
    top = f"{checkpoint_dir(spark).rstrip('/')}/scratch"
    return {f for f in (list_folders(spark, top) if path_exists(spark, top) else []) if not f.startswith("clean-")}


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for top in dirs for _, _, names in os.walk(top.toString()) for f in names if f.startswith("shuffle_")}


ODD_TEXTS = ['a "q"', "two\nlines", "win\r\ndows", "\rbare", " NA", "\u00e9\u2028z\U0001f600", 'back\\slash\\"', "\x01\x0b", "x,y", "tab\t", '{"text": 1}', "a\u0085b"]


def test_pipelines_keep_their_outputs_alone(spark):
    rows = [(i, f"{ODD_TEXTS[i % 12]} {i}" + ODD_TEXTS[i % 7], None if i % 5 == 0 else ODD_TEXTS[(i * 7) % 12]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, target STRING").repartition(5)
    enc, before, merge = HashEncoder(16), scratch_tables(spark), "spark.sql.adaptive.coalescePartitions.enabled"
    out = scratch_path(spark, "t-files, all")
    merged = spark.conf.get(merge)
    spark.conf.set(merge, "false")  # several part files
    try:
        for cached in (False, True):
            assert preprocess_corpus(spark, docs, out, enc, "q ", order_col="doc_id")["cached"] == cached
            assert {f for f in scratch_tables(spark) - before if not f.startswith("t-files")} == set()
    finally:
        spark.conf.set(merge, merged)
    files = [f"{out}/processed/corpus_clean.{kind}" for kind in ("csv", "jsonl")]
    assert all(len(spark.read.text(f).inputFiles()) > 1 for f in files)
    csv = read_corpus_csv(spark, files[0]).orderBy("_order").select("text", "target")
    assert [tuple(r) for r in csv.collect()] == [r[1:] for r in rows]
    lines = read_corpus_jsonl(spark, files[1], "text STRING, target STRING")
    assert sorted(tuple(r) for r in lines.select("text", F.coalesce("target", F.lit("-"))).collect()) == sorted((t, g or "-") for _, t, g in rows)

    ckpt = analytic_teacher_model(16).save(spark, scratch_path(spark, "t-ckpt"))
    before, out = scratch_tables(spark), scratch_path(spark, "t-infer")
    for cached in (False, True):
        assert infer_corpus(spark, "documents", out, ckpt, enc, "q ", corpus=docs, order_col="doc_id", teacher=False)["cached"] == cached
        assert {f for f in scratch_tables(spark) - before if not f.startswith("t-infer")} == set()


def test_empty_corpus_has_empty_files(spark):
    docs = spark.createDataFrame([], "doc_id LONG, text STRING, target STRING")
    out = scratch_path(spark, "t-none")
    assert preprocess_corpus(spark, docs, out, HashEncoder(16), None, order_col="doc_id")["metadata"]["num_samples"] == 0
    assert read_corpus_jsonl(spark, f"{out}/processed/corpus_clean.jsonl", "text STRING, target STRING").count() == 0
    assert path_exists(spark, f"{out}/processed/corpus_clean.csv/_SUCCESS")


def test_cache_rules_holds_one_table_at_a_time(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i % 30} of some words", "abc"[i % 3], "de"[i % 2]) for i in range(40)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING").write.parquet(f"{tmp_path}/documents.parquet")
    tables, shuffles, seen = scratch_tables(spark), shuffle_files(spark), []

    def watched(state):
        def run(*args, **kw):
            end = time.time() + 10
            while (left := shuffle_files(spark) - shuffles) and time.time() < end:
                time.sleep(0.2)
            folders = sorted(f.rsplit("-", 1)[0] for f in scratch_tables(spark) - tables)
            # the run's folder and a table
            seen.append((len(folders) <= 2 and set(folders) <= {"cache-rules"}, len(left)))
            return state(*args, **kw)
        return run

    for name in ("corpus_state", "inference_state"):
        monkeypatch.setattr(queries, name, watched(getattr(queries, name)))
    cleanup = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    found = {r["scenario"]: r["hit"] for r in queries.q_cache_rules(spark, str(tmp_path)).collect()}
    assert found == queries.CACHE_SCENARIOS
    assert seen == [(True, 0)] * 11
    assert scratch_tables(spark) == tables
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == cleanup
