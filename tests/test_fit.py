import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshift.operators.fit import fit_adapter, gd_epochs, gram_stats, scheduled_lr, solve_normal
from vecshift.operators.project import analytic_teacher_model

from conftest import SF_MID


def _pairs(spark):
    emb = spark.read.parquet(f"{SF_MID}/embeddings.parquet").select("embedding")
    m = analytic_teacher_model(64)
    return emb.withColumn("teacher", m.project_col(spark, "embedding", as_float=False)), m


def test_exact_recovery(spark):
    df, truth = _pairs(spark)
    model, stats = fit_adapter(df, "embedding", "teacher")
    assert np.abs(model.weights - truth.weights).max() < 1e-8
    assert np.abs(model.bias - truth.bias).max() < 1e-8
    assert stats.n == 500 and stats.loss(np.vstack([model.weights.T, model.bias])) < 1e-15


def test_partition_invariance(spark):
    df, _ = _pairs(spark)
    a = gram_stats(df, "embedding", "teacher")
    b = gram_stats(df.repartition(5).withColumnRenamed("embedding", "base"), "base", "teacher")
    assert a.n == b.n and np.allclose(a.gram, b.gram) and np.allclose(a.cross, b.cross)


def test_gd_decreases_loss(spark):
    df, _ = _pairs(spark)
    stats = gram_stats(df, "embedding", "teacher")
    losses = [loss for _, _, loss, _ in gd_epochs(stats, 5, 64, {"name": "adam", "lr": 1e-2})]
    assert losses[-1] < losses[0]
    for name in ("sgd", "adamw"):
        ls = [loss for _, _, loss, _ in gd_epochs(stats, 3, 64, {"name": name, "lr": 1e-2})]
        assert ls[-1] <= ls[0]
    with pytest.raises(ValueError):
        list(gd_epochs(stats, 1, 64, {"name": "rmsprop"}))


def test_schedulers():
    assert scheduled_lr(1.0, 0, {"name": "cosine", "T_max": 10}) == 1.0
    assert abs(scheduled_lr(1.0, 10, {"name": "cosine", "T_max": 10})) < 1e-12
    assert scheduled_lr(1.0, 5, {"name": "step", "step_size": 2, "gamma": 0.5}) == 0.25
    with pytest.raises(ValueError):
        scheduled_lr(1.0, 1, {"name": "plateau"})


def test_dropout_is_ridge_on_weights(spark):
    df, _ = _pairs(spark)
    stats = gram_stats(df, "embedding", "teacher")
    plain = solve_normal(stats)
    drop = solve_normal(stats, dropout=0.3)
    assert np.linalg.norm(drop[:-1]) < np.linalg.norm(plain[:-1])


def test_rank_deficient_falls_back(spark):
    rows = [([float(i), 2.0 * i], [float(i)]) for i in range(10)]
    df = spark.createDataFrame(rows, "base ARRAY<DOUBLE>, teacher ARRAY<DOUBLE>")
    model, stats = fit_adapter(df)
    pred = np.array([r[0] for r in rows]) @ model.weights.T + model.bias
    assert np.allclose(pred[:, 0], [r[1][0] for r in rows])
