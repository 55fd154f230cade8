import math

import pytest

from vecshift.operators.metrics import best_by, per_row_ms, quality_gap, speedup, v_measure


def _v(spark, pairs):
    df = spark.createDataFrame(pairs, "label LONG, cluster LONG")
    r = v_measure(df).first()
    return r.homogeneity, r.completeness, r.v_measure


def _v_ref(pairs):
    from collections import Counter
    n = len(pairs)
    a, b, ab = Counter(p[0] for p in pairs), Counter(p[1] for p in pairs), Counter(pairs)
    hc = -sum(x / n * math.log(x / n) for x in a.values())
    hk = -sum(x / n * math.log(x / n) for x in b.values())
    mi = sum(x / n * math.log(n * x / (a[i] * b[j])) for (i, j), x in ab.items())
    h = mi / hc if hc else 1.0
    c = mi / hk if hk else 1.0
    return h, c, (2 * h * c / (h + c) if h + c else 0.0)


@pytest.mark.parametrize("pairs", [
    [(0, 0)] * 5,                                        # one class, one cluster
    [(0, 1), (0, 1), (1, 0), (2, 2)],                    # perfect (relabelled)
    [(0, 0), (0, 1), (1, 0), (1, 1)],                    # independent
    [(0, 0), (0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (-1, 2)],
])
def test_v_measure_matches_formula(spark, pairs):
    got, ref = _v(spark, pairs), _v_ref(pairs)
    assert all(abs(x - y) < 1e-12 for x, y in zip(got, ref))


def test_v_measure_edges(spark):
    assert _v(spark, [(0, 0)] * 3)[2] == 1.0
    assert _v(spark, [(0, 0), (0, 1), (1, 0), (1, 1)])[2] == 0.0


def test_metric_ties(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.5), (2, 0.5), (3, 0.2)], "epoch INT, value DOUBLE")
    assert best_by(df, "value", "epoch", "max").first().epoch == 1
    assert best_by(df, "value", "epoch", "min").first().epoch == 0
    with pytest.raises(ValueError):
        best_by(df, "value", "epoch", "median")


def test_latency_nulls(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(10.0, 0.0, 0)], "t DOUBLE, a DOUBLE, n LONG")
    r = df.select(speedup(F.col("t"), F.col("a")).alias("s"), per_row_ms(F.col("a"), F.col("n")).alias("ms"),
                  quality_gap(F.lit(0.0), F.lit(0.5)).alias("g")).first()
    assert r.s is None and r.ms is None and r.g is None
