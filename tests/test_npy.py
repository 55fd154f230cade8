"""The .npy data source: ranges by offset, commit of attempts."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecshift.operators.labels import load_labels
from vecshift.session import local_path, scratch_path
from vecshift.sources.npy import NpyWriter, npy_files, ranges, read_npy, write_npy


@pytest.fixture()
def folder(spark):
    path = local_path(scratch_path(spark, "t-npy"))
    os.makedirs(path)
    return path


@pytest.mark.parametrize("dtype, order", [("<f4", "C"), (">f8", "C"), ("<f2", "C"), ("<i4", "F")])
def test_a_file_is_read_by_many_tasks(spark, folder, dtype, order):
    a = np.random.default_rng(0).normal(scale=9, size=(1_003, 2, 3)).astype(dtype)
    np.save(f"{folder}/b.npy", np.asarray(a[:1_000], order=order))
    np.save(f"{folder}/c.npy", np.asarray(a[1_000:], order=order))
    np.save(f"{folder}/a.npy", np.zeros((0, 6), dtype))
    df = read_npy(spark, folder, rangeBytes=1_000)
    assert df.rdd.getNumPartitions() == len(ranges(folder, 1_000)) and (order == "F") == (len(ranges(folder, 1_000)) == 2)
    got = df.orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(1_003))
    assert np.array_equal(np.array([r.embedding for r in got], np.float32), a.reshape(1_003, -1).astype(np.float32))


def test_no_files_and_no_rows(spark, folder):
    with pytest.raises(FileNotFoundError):
        read_npy(spark, folder)
    np.save(f"{folder}/a.npy", np.zeros((0, 4), np.float32))
    assert read_npy(spark, folder).count() == 0
    np.save(f"{folder}/b.npy", np.array([{}], object), allow_pickle=True)
    with pytest.raises(Exception, match="array of numbers"):
        read_npy(spark, folder).count()


def test_only_attempts_that_count_are_committed(folder):
    writer = NpyWriter(folder, "labels", True)
    rows = [pa.record_batch({"label": pa.array(range(at, at + 5), pa.int64())}) for at in (0, 5, 10)]

    def failing():
        yield rows[0]
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(failing())
    late = writer.write(iter(rows[:2]))       # a speculative attempt that does not count
    counted = writer.write(iter(rows[:2]))
    second = writer.write(iter(rows[2:]))
    second.partition, empty = 1, writer.write(iter([]))
    assert npy_files(folder) == [] and late.path != counted.path
    writer.commit([second, None, empty, counted])
    assert [os.path.basename(f) for f in npy_files(folder)] == ["part-00000.npy", "part-00001.npy"]
    assert np.concatenate([np.load(f) for f in npy_files(folder)]).tolist() == list(range(15))
    assert not [e for e in os.listdir(folder) if e.startswith("_")]
    again = NpyWriter(folder, "labels", True)
    again.write(iter(rows))
    again.abort([])
    assert len(os.listdir(folder)) == 2


def test_a_failed_write_leaves_what_was_there(spark, folder):
    df = spark.range(100).select(F.col("id"), F.array(F.col("id").cast("float")).alias("embedding"))
    write_npy(df, folder, "id", "embedding", shards=3)
    bad = df.withColumn("embedding", F.when(F.col("id") == 60, F.lit(None)).otherwise(F.col("embedding")))
    with pytest.raises(Exception, match="null embedding"):
        write_npy(bad, folder, "id", "embedding", shards=3)
    assert [r.embedding[0] for r in read_npy(spark, folder).orderBy("row_id").collect()] == list(range(100))
    assert len(os.listdir(folder)) == 3
    write_npy(df.limit(7), folder, "id", "embedding", shards=2)
    assert read_npy(spark, folder).count() == 7


def test_labels_by_position(spark, folder):
    df = spark.range(1_000).select(F.col("id").alias("row_id"), (F.col("id") * 7 % 11).alias("label"))
    write_npy(df, f"{folder}/labels.npy", "row_id", "label", "labels", shards=4)
    assert load_labels(spark, f"{folder}/labels.npy", df).exceptAll(df).count() == 0
    np.save(f"{folder}/one.npy", np.arange(999))
    with pytest.raises(ValueError, match="1 ids"):
        load_labels(spark, f"{folder}/one.npy", df)
    plan = read_npy(spark, f"{folder}/labels.npy", "labels")._jdf.queryExecution().toString()
    assert "binaryFile" not in plan
