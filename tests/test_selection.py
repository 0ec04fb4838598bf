"""Cuts by counting, permutations without a sort, draws on any key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import permutation
from pathloom.functions.draws import DRAWS, shuffle_key
from pathloom.operators import negatives, selection, splits
from pathloom.operators.skew import row_index


def moved(df):
    """Exchanges in the plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.mark.parametrize("draw", ["hash", "arithmetic"])
@pytest.mark.parametrize("small", [3, 10_000])
def test_split_equals_sorting(spark, monkeypatch, draw, small):
    monkeypatch.setattr(selection, "_SMALL", small)
    rows = spark.range(2000).select(F.format_string("user-%05d", "id").alias("k")).repartition(5)
    cut = splits.split_rows(rows, "k", 0.7, 0.2, seed=3, draw=draw)
    assert moved(cut) == moved(rows)
    got = {r["k"]: r["split"] for r in cut.collect()}
    order = [r["k"] for r in rows.orderBy(shuffle_key(F.col("k"), 3, 0, draw), "k").collect()]
    assert [got[k] for k in order] == ["train"] * 1400 + ["valid"] * 400 + ["test"] * 200


@pytest.mark.parametrize("copies", [1, 37, 500])
def test_split_is_exact_on_equal_and_null_ids(spark, copies):
    ids = [None] * 300 + [7] * copies + list(range(100, 200))
    rows = spark.createDataFrame([(i,) for i in ids], "k int").repartition(4)
    n = len(ids)
    sizes = {r["split"]: r["count"] for r in splits.split_rows(rows, "k", 0.5, 0.3).groupBy("split").count().collect()}
    assert sizes == {"train": int(n * 0.5), "valid": int(n * 0.3), "test": n - int(n * 0.5) - int(n * 0.3)}
    assert splits.split_rows(rows, "k").groupBy("k").count().count() == 101 + 1
    one_id = splits.split_rows(rows.filter("k = 7"), "k", 0.5, 0.25)
    assert one_id.filter("split = 'train'").count() == int(copies * 0.5)


def test_all_or_nothing(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    assert splits.split_rows(rows, "k", 1.0, 0.0).filter("split <> 'train'").count() == 0
    assert splits.split_rows(rows, "k", 0.0, 0.0).filter("split <> 'test'").count() == 0
    assert splits.split_rows(rows.limit(0), "k").count() == 0
    assert splits.split_users(rows, 0.05, "k").filter("half = 1").count() == 0
    assert splits.split_users(rows, 1.0, "k").filter("half = 2").count() == 0


def test_users_split_by_comparison(spark):
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("u"), F.col("id") % 40)).alias("user_id"))
    halves = splits.split_users(rows, 0.5)
    assert "Join" not in halves._jdf.queryExecution().executedPlan().toString()
    users = {(r["user_id"], r["half"]) for r in halves.collect()}
    n = rows.filter("user_id IS NOT NULL").select("user_id").distinct().count()
    assert len(users) == n and sum(h == 1 for _, h in users) == int(n * 0.5)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 12, 100, 101, 997, 4096, 10_007])
def test_bijection(n):
    for epoch in range(4):
        keys = permutation.round_keys(11, epoch)
        a, b = permutation.radices(n)
        x = permutation.permuted(np.arange(n, dtype=np.int64), a, b, keys)
        times = 1
        while (x >= n).any():
            x, times = np.where(x >= n, permutation.permuted(x, a, b, keys), x), times + 1
        assert sorted(x.tolist()) == list(range(n)) and times <= permutation.walks(n, keys)


def test_radices_of_large_tables():
    for n in (10**6, 10**9 + 7, 10**12 + 39):
        a, b = permutation.radices(n)
        assert a * b >= n and a * b - n < a and a < 2**31
    assert permutation.walks(10**9 + 7, permutation.round_keys(1, 0)) < 10


def test_epochs_of_one_index(spark):
    indexed = row_index(spark.range(3001).withColumnRenamed("id", "k").repartition(7))
    assert sorted(r["idx"] for r in indexed.collect()) == list(range(1, 3002))
    one, two = splits.shuffle_epoch(indexed, 3001, epoch=0), splits.shuffle_epoch(indexed, 3001, epoch=1)
    assert moved(one) == 0
    first, second = ([r["place"] for r in x.orderBy("idx").collect()] for x in (one, two))
    assert sorted(first) == sorted(second) == list(range(1, 3002)) and first != second
    assert abs(np.corrcoef(first, np.arange(3001))[0, 1]) < 0.08 and abs(np.corrcoef(first, second)[0, 1]) < 0.08
    assert np.mean(np.abs(np.diff(first)) == 1) < 0.01


@pytest.mark.parametrize("draw", list(DRAWS))
def test_draws_on_text_users(spark, draw):
    data = [(u, s, [(i * 3 + j * j + s) % 12 + 1 for j in range(2 + (i + s) % 7)]) for i, u in enumerate(["Ann", "bob", None, "émile", "7"]) for s in range(3)]
    windows = spark.createDataFrame(data, "user_id string, seq_no int, item_seq array<int>")
    for drawn in (negatives.sample_negatives(windows, 12, draw=draw), negatives.sample_shared_negatives(windows, 12, 100, 2, 16, draw=draw)):
        found = drawn.collect()
        assert len(found) == len(data) and all(r["neg_item"] and not set(r["neg_item"]) & set(r["item_seq"]) for r in found)
    places = negatives.sample_per_position(windows, 12, 3, draw=draw).collect()
    assert len(places) == sum(len(d[2]) - 1 for d in data) and all(1 <= x <= 12 for r in places for x in r["neg_item"])
    assert len({str(r["neg_item"]) for r in places}) > 5


def test_equal_integers_of_any_type_draw_alike(spark):
    df = spark.range(50).select(*[F.col("id").cast(t).alias(t) for t in ("int", "long", "string")])
    for f in DRAWS.values():
        got = df.select(*[f(1000, 5, F.col(c), F.lit(3)).alias(c) for c in df.columns]).collect()
        assert all(len(set(r)) == 1 for r in got)
