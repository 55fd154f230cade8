import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshift.functions.text import null_if_token
from vecshift.session import local_path, scratch_path
from vecshift.sources.corpus import (choose_splits, load_split_files, read_corpus_csv, read_corpus_jsonl,
                                     write_corpus_csv, write_corpus_jsonl)
from vecshift.plans.preprocess import ingest_corpus
from vecshift.sources.metadata import (INFERENCE_SCHEMA, content_fingerprint, inference_metadata, is_cached,
                                       read_metadata, write_metadata)
from vecshift.sources.vectors import (load_vector_folder, read_npy_embeddings, synthetic_pairs,
                                      write_npy_shards)

QUOTED = [(0, 'He said "hi", then left'), (1, "line one\nline two"), (2, "a,b,c"), (3, "Grüße — 東京"),
          (4, " NA"), (5, "NA"), (6, ""), (7, None), (8, "trailing  ")]


def test_quoted_csv_roundtrip(spark):
    df = spark.createDataFrame(QUOTED, "id LONG, text STRING")
    path = scratch_path(spark, "t-csv")
    write_corpus_csv(df, path)
    back = read_corpus_csv(spark, path, "id LONG, text STRING").select("id", null_if_token("text").alias("t"))
    got = {r.id: r.t for r in back.collect()}
    expect = {i: (None if t in ("NA", "", None) else t) for i, t in QUOTED}
    assert got == expect


def test_csv_order_key_follows_file(spark):
    df = spark.range(50).selectExpr("id", "concat('t', id) AS text")
    path = scratch_path(spark, "t-order")
    write_corpus_csv(df.orderBy("id").repartitionByRange(3, "id"), path)
    back = read_corpus_csv(spark, path, "id LONG, text STRING")
    ids = [r.id for r in back.orderBy("_order").collect()]
    assert ids == list(range(50))


def test_jsonl_roundtrip(spark):
    df = spark.createDataFrame(QUOTED, "id LONG, text STRING")
    path = scratch_path(spark, "t-jsonl")
    write_corpus_jsonl(df, path)
    local = local_path(path)
    raw = "".join(open(os.path.join(local, f), encoding="utf-8").read() for f in os.listdir(local) if f.endswith(".json"))
    assert "東京" in raw and '"text":null' in raw
    back = {r.id: r.text for r in read_corpus_jsonl(spark, path, "id LONG, text STRING").collect()}
    assert back == dict(QUOTED)


def test_choose_splits():
    assert choose_splits(["test", "train"], ["train", "validation", "test"]) == ["train", "test"]
    assert choose_splits(["b", "a"], ["x"]) == ["a", "b"]


def test_npy_shards_in_name_order(spark):
    df = spark.range(100).select(F.col("id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    path = scratch_path(spark, "t-npy")
    write_npy_shards(df, path, "id", shards=4)
    back = read_npy_embeddings(spark, path).orderBy("row_id").collect()
    assert [r.row_id for r in back] == list(range(100))
    assert [r.embedding[0] for r in back] == [float(i) for i in range(100)]


def test_json_vector_folder_and_missing(spark, tmp_path):
    d = tmp_path / "vec"
    d.mkdir()
    for i in (3, 1, 2):
        (d / f"{i:03d}.json").write_text(json.dumps({"embedding": [i, i + 0.5]}))
    back = load_vector_folder(spark, str(d)).orderBy("row_id").collect()
    assert [r.embedding[0] for r in back] == [1.0, 2.0, 3.0]
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        load_vector_folder(spark, str(empty))


def test_metadata_cache_rules(spark, tmp_path):
    meta = {"file_hash": "h", "num_samples": 3, "instruction": "I", "adapter_checkpoint": "ck",
            "text_column": "text", "embedding_model": "m", "adapter_latency_sec": 0.0,
            "base_encode_seconds": 1.0, "teacher_encode_seconds": 10.0}
    rec = inference_metadata(spark, meta).first().asDict()
    assert rec["latency_speedup"] is None  # adapter time 0 → no ratio, no error
    good = str(tmp_path / "good")
    write_metadata(inference_metadata(spark, meta), good)
    stored = read_metadata(spark, good, INFERENCE_SCHEMA)
    assert read_metadata(spark, str(tmp_path / "missing"), INFERENCE_SCHEMA) is None
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.json").write_text("{not json")
    assert read_metadata(spark, str(broken), INFERENCE_SCHEMA) is None
    outputs = [str(tmp_path / "good")]
    keyed = str(tmp_path / "keyed")
    write_metadata(inference_metadata(spark, meta | {"cache_key": "k"}), keyed)
    assert is_cached(spark, "k", keyed, INFERENCE_SCHEMA, outputs) and is_cached(spark, "k", f"file://{keyed}", INFERENCE_SCHEMA, [f"file://{outputs[0]}"])
    assert not is_cached(spark, "other", keyed, INFERENCE_SCHEMA, outputs) and not is_cached(spark, "k", good, INFERENCE_SCHEMA, outputs)
    assert not is_cached(spark, "k", keyed, INFERENCE_SCHEMA, [*outputs, str(tmp_path / "missing")])


def test_content_fingerprint_sees_order_values_and_pairs(spark):
    def of(*rows):
        return content_fingerprint(spark.createDataFrame(list(rows), "row_id LONG, text STRING"), ["row_id", "text"]).first()["content_hash"]
    base = of((0, "a"), (1, "b"), (2, None))
    assert base == of((2, None), (0, "a"), (1, "b"))
    assert len({base, of((0, "b"), (1, "a"), (2, None)), of((0, "a"), (1, "b"), (2, "")), of((0, "a"), (1, "b")), of((0, "a"), (1, "b"), (2, None), (2, None))}) == 5
    alike = [content_fingerprint(spark.createDataFrame([(t,) for t in x], "text STRING"), ["text"]).first()["content_hash"] for x in (("a", "a", "x"), ("b", "b", "x"))]
    assert alike[0] != alike[1]


def test_forty_splits_keep_their_order_and_file_paths(spark, tmp_path):
    paths = {}
    for i in range(40):
        folder = tmp_path / f"s{i:02d}"
        folder.mkdir()
        (folder / "b.csv").write_text(f"text,n\n\"second, of\n{i}\",{i}\n")
        (folder / "a.csv").write_text(f"text,n\nfirst {i},{i}\n")
        paths[f"s{i:02d}"] = f"file:{folder}" if i % 2 else str(folder)
    wanted = [f"s{i:02d}" for i in reversed(range(40))]
    got = load_split_files(spark, paths | {"none": "file:/no/such"}, wanted + ["none"]).orderBy("_order").collect()
    assert [(r.split, r.text.split()[0]) for r in got] == [(n, w) for n in wanted for w in ("first", "second,")]
    out = ingest_corpus(spark, paths, wanted, str(tmp_path / "all.csv"))
    back = read_corpus_csv(spark, out)
    assert [c for c in back.columns if not c.startswith("_")] == ["text", "n"]
    assert [r.n for r in back.orderBy("_order").collect()] == [str(39 - i // 2) for i in range(80)]
    with pytest.raises(FileNotFoundError):
        load_split_files(spark, {"x": str(tmp_path / "none")}, ["x"])


def test_synthetic_pairs_partition_independent(spark):
    ids = spark.range(64).withColumnRenamed("id", "row_id")
    a = {r.row_id: tuple(r.target) for r in synthetic_pairs(ids, 8, 4).collect()}
    b = {r.row_id: tuple(r.target) for r in synthetic_pairs(ids.repartition(5), 8, 4).collect()}
    assert a == b and len(next(iter(a.values()))) == 4


def test_shard_writers_refuse_non_posix_paths(spark):
    from vecshift.sources.vectors import write_json_vectors, write_npy_shards
    df = spark.createDataFrame([(0, [1.0, 2.0])], "id LONG, embedding ARRAY<DOUBLE>")
    with pytest.raises(ValueError):
        write_npy_shards(df, "hdfs://nn/x", "id")
    with pytest.raises(ValueError):
        write_json_vectors(df, "s3a://bucket/x", "id")


def test_file_fingerprint_matches_hashlib(spark):
    import hashlib
    import pathlib
    from vecshift.sources.metadata import file_fingerprint
    base = pathlib.Path(local_path(scratch_path(spark, "fingerprint")))
    base.mkdir(parents=True)
    one = base / "a.csv"
    one.write_bytes(b"text,target\n\"x, y\",1\n" * 1000)
    assert file_fingerprint(spark, str(one)) == hashlib.md5(one.read_bytes()).hexdigest()
    folder = base / "parts"
    folder.mkdir()
    parts = [b"p0" * 10, b"p1" * 20, b"p2"]
    for i, b in enumerate(parts):
        (folder / f"part-{i}.csv").write_bytes(b)
    want = hashlib.md5("".join(hashlib.md5(b).hexdigest() for b in parts).encode()).hexdigest()
    assert file_fingerprint(spark, str(folder)) == want
