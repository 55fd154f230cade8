import pytest
from pyspark.sql import functions as F

from vecshift.operators.split import assign_split, cut_ranks, split_ranges, split_rows, split_sizes


@pytest.mark.parametrize("n,expected", [
    (1, (1, 1, 1)), (2, (1, 1, 1)), (3, (1, 1, 1)), (4, (2, 1, 1)), (5, (3, 1, 1)), (10, (7, 2, 1)),
    (87, (60, 18, 9)), (927, (648, 186, 93)), (2000, (1400, 400, 200)),
])
def test_split_sizes(n, expected):
    s = split_sizes(split_ranges(n))
    assert (s["train"], s["val"], s["test"]) == expected


def test_ratio_fallbacks():
    assert cut_ranks(10, 0, 0, 0) == cut_ranks(10, 0.8, 0.1, 0.1)
    # missing keys: train 0.2, val 0.1, test = rest
    assert cut_ranks(10, None, None, None) == (2, 3)


def test_all_train_ratio_moves_single_rows():
    plan = split_ranges(100, 1.0, 0.0, 0.0)
    assert split_sizes(plan) == {"train": 98, "val": 1, "test": 1}


def _splits(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    return {(r.row_id, r.split) for r in assign_split(df).collect()}


def test_tiny_n_overlaps(spark):
    one = _splits(spark, 1)
    assert one == {(0, "train"), (0, "val"), (0, "test")}
    two = _splits(spark, 2)
    val = {r for r, s in two if s == "val"}
    test = {r for r, s in two if s == "test"}
    assert val == test and len(val) == 1


def test_split_is_a_partition_for_large_n(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    rows = assign_split(df).collect()
    assert len(rows) == 1000 and len({r.row_id for r in rows}) == 1000
    assert sorted(r.rank for r in rows) == list(range(1000))


def test_split_invariant_under_repartition(spark):
    df = spark.range(500).withColumnRenamed("id", "row_id")
    a = {tuple(r) for r in assign_split(df).collect()}
    b = {tuple(r) for r in assign_split(df.repartition(7)).collect()}
    assert a == b


def test_seeded_rank_matches_sort(spark):
    import hashlib
    from vecshift.operators.ordering import seeded_rank
    df = spark.range(300).withColumnRenamed("id", "row_id")
    got = {r.row_id: r.rank for r in seeded_rank(df, seed=7).collect()}
    order = sorted(range(300), key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
    assert got == {rid: pos for pos, rid in enumerate(order)}


def test_key_rank_many_buckets(spark):
    from vecshift.operators.ordering import key_rank
    df = spark.range(5000).select((F.col("id") * 7 + 3).alias("k"))
    got = key_rank(df, "k", rank_col="r", rows_per_bucket=100).orderBy("k").collect()
    assert [r.r for r in got] == list(range(5000))


def test_key_rank_one_bucket_equals_many(spark):
    from vecshift.operators.ordering import key_rank
    df = spark.range(3000).select(((F.col("id") * 7919) % 3001).alias("k"))
    one = key_rank(df, "k", rank_col="r").orderBy("k").collect()
    many = key_rank(df, "k", rank_col="r", rows_per_bucket=200).orderBy("k").collect()
    assert [(r.k, r.r) for r in one] == [(r.k, r.r) for r in many]
    assert [r.r for r in one] == list(range(3000))


def test_seeded_rank_paths_agree(spark):
    from vecshift.operators.ordering import seeded_rank
    df = spark.range(2000).withColumnRenamed("id", "row_id")
    direct = {r.row_id: r.rank for r in seeded_rank(df, seed=3, n=2000).collect()}
    bucketed = {r.row_id: r.rank for r in seeded_rank(df, seed=3).collect()}
    few = {r.row_id: r.rank for r in seeded_rank(df, seed=3, hex_digits=1).collect()}
    assert direct == bucketed == few
    assert sorted(direct.values()) == list(range(2000))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 50, 30_000])
def test_split_rows_equals_ranked_split(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    a = sorted((r.row_id, r.split) for r in assign_split(df, seed=5).collect())
    assert sorted((r.row_id, r.split) for r in split_rows(df, seed=5).collect()) == a
    assert sorted((r.row_id, r.split) for r in split_rows(df.repartition(3), seed=5, n=n).collect()) == a


def test_selected_keys_by_refined_histograms(spark, monkeypatch):
    import hashlib
    from vecshift.operators import ordering
    monkeypatch.setattr(ordering, "SELECT_KEYS", 2)
    ids = [f"k{i}" for i in range(2000)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    order = sorted((hashlib.md5(f"s:{i}".encode()).hexdigest(), i) for i in ids)
    ranks = [0, 1, 999, 1000, 1998, 1999, 2000, -1]
    assert ordering.seeded_keys_at(df, ranks, "id", "s") == {r: order[r] for r in ranks if 0 <= r < 2000}
    # an id repeated more often than the driver takes keys is one key
    hot = spark.range(300).select(F.when(F.col("id") < 200, 7).otherwise(F.col("id")).alias("id"))
    order = sorted((hashlib.md5(f"s:{i}".encode()).hexdigest(), i) for i in [7] * 200 + list(range(200, 300)))
    assert ordering.seeded_keys_at(hot, [0, 100, 150, 299], "id", "s") == {r: order[r] for r in (0, 100, 150, 299)}


def test_split_rows_edges(spark):
    assert split_rows(spark.range(0).withColumnRenamed("id", "row_id")).columns == ["row_id", "split"]
    assert split_rows(spark.range(0).withColumnRenamed("id", "row_id")).count() == 0
    df = spark.range(40).select(F.when(F.col("id") > 1, F.col("id")).alias("row_id"), F.col("id").alias("rank"))
    rows = split_rows(df).collect()
    assert len(rows) == 40 and all((r.split is None) == (r.row_id is None) for r in rows)


def test_key_rank_takes_numbers_only_and_stops_at_first(spark):
    from vecshift.operators.ordering import key_rank
    with pytest.raises(TypeError, match="sorted_rank"):
        key_rank(spark.createDataFrame([("a",)], "k string"), "k")
    df = spark.range(5000).select((F.col("id") * 7 + 3).alias("k"))
    got = key_rank(df, "k", rank_col="r", rows_per_bucket=100, first=321).orderBy("k").collect()
    assert [(r.k, r.r) for r in got] == [(i * 7 + 3, i) for i in range(321)]
