"""Merged states of shards equal one run over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import metrics, states

RANKING = ["hit", "mrr", "map", "recall", "ndcg", "precision", "gauc", "itemcoverage", "averagepopularity", "shannonentropy", "giniindex", "tailpercentage"]
VALUE = ["auc", "mae", "rmse", "logloss"]


def _values(table):
    return {r["metric"]: r["value"] for r in table.collect()}


def test_merged_shards_equal_one_run(spark):
    draw = random.Random(3)
    recs = [(u, r, draw.randrange(30), int(draw.random() < 0.3), 4) for u in range(40) for r in range(1, 6)]
    recs = spark.createDataFrame(recs, "user_id int, rank int, item_id int, hit int, pos_len int")
    ranks = spark.createDataFrame([(u, float(draw.randrange(3, 40)), 20, draw.randrange(3)) for u in range(40)], "user_id int, pos_rank_sum double, candidates long, positives long")
    popularity = spark.createDataFrame([(i, draw.randrange(1, 50)) for i in range(30)], "item_id int, n long")
    more = {"popularity": popularity, "item_count": 30}
    whole = metrics.evaluate(RANKING, [1, 3, 5], recs=recs, mean_rank=ranks, places=None, **more)
    mine = [lambda t, low=a, high=b: t.filter(f"user_id >= {low} AND user_id < {high}") for a, b in ((0, 1), (1, 25), (25, 40), (40, 50))]
    parts = [states.evaluation_state(RANKING, [1, 3, 5], recs=m(recs), mean_rank=m(ranks), **more) for m in mine]
    state = states.merge_states(states.merge_states(*parts[:2]), *parts[2:])
    got, want = _values(states.state_values(state, RANKING, [1, 3, 5], 30, None)), _values(whole)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_value_metrics_merge(spark):
    draw = random.Random(4)
    scored = spark.createDataFrame([(draw.randrange(20) / 20, float(draw.random() < 0.4)) for _ in range(300)], "pred double, label double")
    parts = [states.evaluation_state(VALUE, scored=scored.filter(F.col("pred") < 0.3)), states.evaluation_state(VALUE, scored=scored.filter(F.col("pred") >= 0.3))]
    got, want = _values(states.state_values(parts[0].unionByName(parts[1]), VALUE, places=None)), _values(metrics.evaluate(VALUE, scored=scored, places=None))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
