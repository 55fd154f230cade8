import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshift.functions.vector import l2_normalize
from vecshift.operators.project import AdapterModel, analytic_teacher_model
from vecshift.operators.vectors import alignment_report, mse_loss, validate_alignment

from conftest import SF_SMALL


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0],), ([3.0, 4.0, 0.0],)], "v ARRAY<DOUBLE>")
    got = [r.n for r in df.select(l2_normalize("v").alias("n")).collect()]
    assert got == [[0.0, 0.0, 0.0], [0.6, 0.8, 0.0]]


def test_arrow_and_jvm_projection_agree(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding")
    m = analytic_teacher_model(64)
    a = {r.vec_id: np.array(r.y) for r in m.transform(emb, "embedding", "y", "arrow").collect()}
    b = {r.vec_id: np.array(r.y) for r in m.transform(emb, "embedding", "y", "jvm").collect()}
    assert a.keys() == b.keys()
    assert max(np.abs(a[k] - b[k]).max() for k in a) < 1e-5  # arrow form stores float


def test_misaligned_raises(spark):
    base = spark.createDataFrame([(i, [1.0, 2.0, 3.0, 4.0]) for i in range(3)], "row_id LONG, embedding ARRAY<DOUBLE>")
    teacher = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(2)], "row_id LONG, embedding ARRAY<DOUBLE>")
    rep = alignment_report(base, teacher).first()
    assert rep.base_only == 1 and rep.base_dim_max == 4 and rep.teacher_dim_max == 3
    with pytest.raises(ValueError):
        validate_alignment(base, teacher)
    validate_alignment(base, base)


def test_mse(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 0.0]), ([0.0, 0.0], [2.0, 2.0])], "p ARRAY<DOUBLE>, t ARRAY<DOUBLE>")
    assert abs(mse_loss(df, "p", "t").first().mse - (4 / 2 + 8 / 2) / 2) < 1e-12


def test_adapter_save_load(spark, tmp_path):
    m = AdapterModel(np.arange(6.0).reshape(2, 3), np.array([0.5, -1.0]))
    path = m.save(spark, str(tmp_path / "adapter"))
    back = AdapterModel.load(spark, path)
    assert np.array_equal(back.weights, m.weights) and np.array_equal(back.bias, m.bias)
    with pytest.raises(FileNotFoundError):
        AdapterModel.load(spark, str(tmp_path / "missing"))


def test_jvm_projection_refuses_large_maps(spark):
    import pytest
    from vecshift.operators.project import AdapterModel
    big = AdapterModel.identity(512)
    with pytest.raises(ValueError):
        big.project_jvm_col("embedding")
