import numpy as np
from pyspark.sql import functions as F

from vecshift.llm import rules


def test_trees_and_threshold_come_from_all_labelled_rows(spark, monkeypatch):
    docs = spark.range(2310).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five six seven eight nine ten "), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") >= 10).cast("int").alias("quality"))
    seen = {}
    grow, calibrate = rules.grow, rules.calibrate
    monkeypatch.setattr(rules, "grow", lambda rows, *a: (seen.update(rows=rows.count()), grow(rows, *a))[1])
    monkeypatch.setattr(rules, "calibrate", lambda score, label, weight: (seen.update(weight=int(weight.sum())), calibrate(score, label, weight))[1])
    rules.fit_forest(docs, labels, trees=2, subsample=4)
    assert seen == {"rows": 2310, "weight": 2310}


def test_nodes_split_the_range_of_all_their_rows(spark):
    draw = np.random.default_rng(1)
    x = [[float(v) for v in draw.random(rules.N_SHARES)] for _ in range(60)]
    rows = spark.createDataFrame([(i % 2, v) for i, v in enumerate(x)], "label int, shares array<double>")
    grown = [rules.grow(rows.repartition(p), trees=3, size=8) for p in (1, 5)]
    for name in ("feature", "cut", "depth"):
        assert np.array_equal(getattr(grown[0], name), getattr(grown[1], name))
    f = grown[0].feature[0, 0]
    values = [v[f] for v in x]
    assert min(values) < grown[0].cut[0, 0] <= max(values)
    assert (grown[0].depth[0][np.unique(grown[0].walk(0, np.array(x), 3))] > 0).all()
