import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshift.operators import cluster
from vecshift.operators.cluster import assign_nearest, kmeans_best, kmeans_v_measure
from vecshift.operators.metrics import v_measure

CENTRES = np.array([[0.0, 0.0, 0.0], [10.0, 0.0, 0.0], [0.0, 10.0, 0.0]])


@pytest.fixture(scope="module")
def blobs(spark):
    """Three tight, well-separated groups of 40 points; the optimum is the group means."""
    rng = np.random.default_rng(7)
    labels = np.arange(120) % 3
    pts = CENTRES[labels] + rng.normal(scale=0.3, size=(120, 3))
    best = sum(((pts[labels == g] - pts[labels == g].mean(axis=0)) ** 2).sum() for g in range(3))
    rows = [(i, int(g), [float(x) for x in p]) for i, (g, p) in enumerate(zip(labels, pts))]
    return spark.createDataFrame(rows, "id LONG, label LONG, embedding ARRAY<DOUBLE>"), float(best)


def test_best_fit_is_the_optimum_however_rows_are_dealt(spark, blobs):
    df, best_cost = blobs
    for parts in (1, 4, 16):
        preds, info = kmeans_best(df.repartition(parts).select("label", "embedding"), 3, n_init=4)
        assert info["cost"] == pytest.approx(best_cost, rel=1e-6)
        assert v_measure(preds, "label", "cluster").first()["v_measure"] == pytest.approx(1.0)


def test_class_limit_and_single_class(spark, blobs, monkeypatch):
    df, _ = blobs
    assert kmeans_v_measure(df.withColumn("label", F.lit(1))) is None
    monkeypatch.setattr(cluster, "MAX_CLASSES", 2)
    with pytest.raises(ValueError):
        kmeans_v_measure(df)


@pytest.mark.parametrize("k", [3, 256, 257, 600])
def test_nearest_is_the_first_of_equals_at_any_number_of_centres(spark, blobs, k):
    df, _ = blobs
    centres = np.concatenate([CENTRES, CENTRES[2:], np.full((max(k - 4, 0), 3), 1e6)])[:k]
    got = assign_nearest(df, centres).select("label", "cluster").distinct().collect()
    assert {(r.label, r.cluster) for r in got} == {(0, 0), (1, 1), (2, 2)}


def test_all_fits_share_the_job_of_a_step(spark):
    """Ten fits of up to 30 steps: jobs for the first centres of each, then one a step for all (a job a step and fit before)."""
    x = np.random.default_rng(3).normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id LONG, embedding ARRAY<DOUBLE>").repartition(2)
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    kmeans_best(df, 6, n_init=10, max_iter=30, tol=0.0)
    assert len(set(tracker.getJobIdsForGroup()) - before) <= 10 * 13 + 30 + 5


def test_steps_are_those_of_each_fit_alone(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(200, 3)), np.zeros((40, 3))])
    far = np.full((1, 3), 1e3)
    starts = [x[:4], np.concatenate([x[10:12], far]), x[20:26]]
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "embedding ARRAY<DOUBLE>").repartition(3)
    for most in (1, 3, 300):
        for start, (got, cost) in zip(starts, cluster.lloyd_steps(df, starts, "embedding", most, 1e-4)):
            want = np.array(start)
            for _ in range(most):
                dist = ((x[:, None] - want[None]) ** 2).sum(axis=2)
                near, was = dist.argmin(axis=1), want.copy()
                for j in set(near.tolist()):
                    want[j] = x[near == j].mean(axis=0)
                if (((want - was) ** 2).sum(axis=1) <= 1e-8).all():
                    break
            assert got == pytest.approx(want, abs=1e-9) and cost == pytest.approx(dist.min(axis=1).sum())
    assert (cluster.lloyd_steps(df, starts, "embedding", 5)[1][0][2] == 1e3).all()


def test_a_step_has_no_more_tasks_than_slots_however_rows_are_dealt(spark, monkeypatch):
    """120 rows in 60 partitions: a step had 60 tasks, whose results all reach the driver; a task a slot now, and more by bytes alone."""
    df = spark.range(120).repartition(60).select(F.array(*[F.sin(F.col("id") * i) for i in (1, 2, 3)]).alias("embedding"))
    x = np.sin(np.arange(10)[:, None] * np.array([1.0, 2.0, 3.0]))
    slots, tracker = spark.sparkContext.defaultParallelism, spark.sparkContext.statusTracker()
    assert slots < 60

    def most_tasks():
        before = set(tracker.getJobIdsForGroup())
        fits = cluster.lloyd_steps(df, [x[:4], x[5:9]], "embedding", 2)
        stages = {s for j in set(tracker.getJobIdsForGroup()) - before for s in tracker.getJobInfo(j).stageIds}
        # the deal of the rows itself (60 tasks at most) is a stage before; steps are those of Python's sums
        return fits, [i.numTasks for i in map(tracker.getStageInfo, stages) if i and "cluster.py" in i.name]

    fits, tasks = most_tasks()
    assert tasks and max(tasks) <= slots
    monkeypatch.setattr(cluster, "TASK_BYTES", 1)
    wide, tasks = most_tasks()
    assert max(tasks) == 60
    for (a, cost), (b, other) in zip(fits, wide):
        assert a == pytest.approx(b) and cost == pytest.approx(other)
