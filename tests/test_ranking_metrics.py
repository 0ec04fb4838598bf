"""Ranking, scoring and metrics against hand results and brute force."""

import math

import numpy as np
import pytest

from pathloom.operators import metrics, ranking, scoring
from pathloom.plans.evaluation import evaluate_vectors, hits_of_targets, recommend


def test_average_rank_example(spark):
    data = [(1, i, s) for i, s in enumerate([1, 2, 2, 2, 3, 3, 6])] + [(2, i, s) for i, s in enumerate([2, 2, 2, 2, 4, 5, 5])]
    df = spark.createDataFrame(data, "user_id int, item_id int, score int")
    for min_rows in (1, 10**6):
        got = ranking.average_rank(df, descending=False, min_rows=min_rows).orderBy("user_id", "item_id").collect()
        assert [r["avg_rank"] for r in got] == [1, 3, 3, 3, 5.5, 5.5, 7, 2.5, 2.5, 2.5, 2.5, 5, 6.5, 6.5]


@pytest.fixture(scope="module")
def recs(spark):
    """Hit rows [0,1,0], [1,0,1], [0,0,0] with 1, 2 and 1 positives."""
    hits = {1: ([0, 1, 0], 1), 2: ([1, 0, 1], 2), 3: ([0, 0, 0], 1)}
    data = [(u, r, 10 * u + r, h, n) for u, (row, n) in hits.items() for r, h in enumerate(row, 1)]
    return spark.createDataFrame(data, "user_id int, rank int, item_id int, hit int, pos_len int")


def test_hand_metrics(recs):
    got = {r["metric"]: r["value"] for r in metrics.evaluate(
        ["Hit", "MRR", "Recall", "Precision", "MAP", "NDCG"], [1, 3], recs=recs, places=None).collect()}
    assert got["hit@3"] == pytest.approx(2 / 3) and got["mrr@3"] == pytest.approx(0.5)
    assert got["recall@3"] == pytest.approx(2 / 3) and got["precision@3"] == pytest.approx(1 / 3)
    assert got["hit@1"] == pytest.approx(1 / 3) and got["recall@1"] == pytest.approx(1 / 6)
    assert got["map@3"] == pytest.approx((0.5 + (1 + 2 / 3) / 2) / 3)
    ideal = 1 + 1 / math.log2(3)
    assert got["ndcg@3"] == pytest.approx((1 / math.log2(3) + (1 + 1 / math.log2(4)) / ideal) / 3)


def test_metric_requests_are_checked(recs):
    with pytest.raises(NotImplementedError):
        metrics.evaluate(["nope"], 5, recs=recs)
    with pytest.raises(RuntimeError):
        metrics.evaluate(["hit", "auc"], 5, recs=recs)
    with pytest.raises(ValueError):
        metrics.evaluate(["hit"], [5, 0], recs=recs)
    with pytest.raises(TypeError):
        metrics.evaluate(["hit"], "5", recs=recs)
    with pytest.raises(ValueError):
        metrics.evaluate(["giniindex"], 5, recs=recs)
    with pytest.raises(ValueError):
        metrics.register_metric("hit", metrics.METRICS["hit"])


def test_diversity_by_hand(spark):
    lists = {1: [1, 2, 3], 2: [1, 2, 4], 3: [1, 5, 4]}
    recs = spark.createDataFrame([(u, r, i, 0, 1) for u, l in lists.items() for r, i in enumerate(l, 1)],
                                 "user_id int, rank int, item_id int, hit int, pos_len int")
    pop = spark.createDataFrame([(1, 50), (2, 20), (3, 20), (4, 3), (6, 1)], "item_id int, n long")
    names = ["itemcoverage", "averagepopularity", "shannonentropy", "giniindex", "tailpercentage"]
    got = {r["metric"]: r["value"] for r in metrics.evaluate(
        names, [2, 3], recs=recs, item_count=10, popularity=pop, tail=5, places=None).collect()}
    counts = np.array([1, 1, 2, 2, 3])
    p = counts / 9
    n = 10
    place = np.arange(n - 5 + 1, n + 1)
    assert got["itemcoverage@3"] == pytest.approx(0.5)
    assert got["shannonentropy@3"] == pytest.approx(-(p * np.log(p)).sum() / 5)
    assert got["giniindex@3"] == pytest.approx(((2 * place - n - 1) * counts).sum() / 9 / n)
    assert got["averagepopularity@2"] == pytest.approx((70 + 70 + 50) / 6)
    assert got["tailpercentage@3"] == pytest.approx(2 / 9)
    share = metrics.tail_items(pop, 0.5).orderBy("item_id").collect()
    assert [r[0] for r in share] == [4, 6]


def test_auc_with_ties_and_degenerate_labels(spark):
    rng = np.random.default_rng(3)
    pred, label = rng.integers(0, 12, 300) / 10, rng.integers(0, 2, 300)
    pairs = (pred[label == 1][:, None] > pred[label == 0]).sum() + 0.5 * (pred[label == 1][:, None] == pred[label == 0]).sum()
    want = pairs / ((label == 1).sum() * (label == 0).sum())
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(pred, label)], "pred double, label double")
    assert metrics.evaluate(["auc"], scored=df, places=None).first()["value"] == pytest.approx(want)
    assert math.isnan(metrics.evaluate(["auc"], scored=df.filter("label = 1")).first()["value"])


def test_value_metrics(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.5, 1.0)], "pred double, label double")
    got = {r["metric"]: r["value"] for r in metrics.evaluate(["mae", "rmse", "logloss"], scored=df, places=None).collect()}
    assert got["mae"] == pytest.approx(0.5) and got["rmse"] == pytest.approx(math.sqrt(1.25 / 3))
    assert got["logloss"] == pytest.approx((-math.log(1 - 1e-15) - math.log(1 - (1 - 1e-15)) - math.log(0.5)) / 3, rel=1e-6)


def test_valid_score(recs):
    row = metrics.valid_score(metrics.evaluate(["recall"], [10], recs=recs)).first()
    assert row["metric"] == "recall@10" and row["bigger_is_better"]


USERS, ITEMS, WIDTH = 23, 57, 6


@pytest.fixture(scope="module")
def world(spark):
    """Vectors with exact copies (ties), histories and targets; some targets are in the history."""
    rng = np.random.default_rng(11)
    items = rng.normal(size=(ITEMS, WIDTH))
    items[30:40] = items[10:20]
    users = rng.normal(size=(USERS, WIDTH))
    seen = sorted({(int(u), int(i)) for u, i in zip(rng.integers(1, USERS + 1, 300), rng.integers(1, ITEMS + 1, 300))})
    targets = sorted({(int(u), int(i)) for u, i in zip(rng.integers(1, USERS + 1, 60), rng.integers(1, ITEMS + 1, 60))})
    frame = lambda m, name: spark.createDataFrame(
        [(k + 1, [float(x) for x in v]) for k, v in enumerate(m)], f"{name} int, vector array<double>")
    pair = "user_id int, item_id int"
    score = np.round(users @ items.T, 9)
    return {
        "users": frame(users, "user_id"), "items": frame(items, "item_id"), "score": score,
        "seen": spark.createDataFrame(seen + seen[:50], pair), "targets": spark.createDataFrame(targets, pair),
        "seen_set": set(seen), "target_list": targets,
    }


def ranked(world, user, suppress=True):
    free = [i for i in range(1, ITEMS + 1) if not suppress or (user, i) not in world["seen_set"]]
    return sorted(free, key=lambda i: (-world["score"][user - 1, i - 1], i))


@pytest.mark.parametrize("block", [1, 7, 4096])
@pytest.mark.parametrize("suppress", [True, False])
def test_top_k_equals_brute_force(world, block, suppress):
    seen = world["seen"] if suppress else None
    got = {}
    for r in recommend(world["users"], world["items"], 9, seen, block).collect():
        got.setdefault(r["user_id"], {})[r["rank"]] = r["item_id"]
    for user in range(1, USERS + 1):
        want = ranked(world, user, suppress)[:9]
        assert [got[user][r] for r in range(1, len(want) + 1)] == want


@pytest.mark.parametrize("block", [5, 4096])
def test_target_rank_equals_brute_force(world, block):
    got = {(r["user_id"], r["item_id"]): r for r in scoring.target_rank(
        world["users"], world["items"], world["targets"], world["seen"], block).collect()}
    assert set(got) == set(world["target_list"])
    for user, item in world["target_list"]:
        order = ranked(world, user)
        row = got[user, item]
        assert row["candidates"] == len(order)
        if (user, item) in world["seen_set"]:
            assert row["rank"] == row["avg_rank"] == len(order) + 1
            continue
        scores = [world["score"][user - 1, i - 1] for i in order]
        mine = world["score"][user - 1, item - 1]
        places = [p for p, s in enumerate(scores, 1) if s == mine]
        assert row["rank"] == order.index(item) + 1
        assert row["avg_rank"] == sum(places) / len(places)


def test_metrics_from_target_ranks_equal_metrics_from_lists(world):
    names = ["hit", "mrr", "map", "recall", "ndcg", "precision"]
    lists = ranking.mark_positives(recommend(world["users"], world["items"], 20, world["seen"]), world["targets"])
    users = world["targets"].select("user_id").distinct()
    by_list = metrics.evaluate(names, [5, 20], recs=lists.join(users, "user_id", "left_semi"))
    by_rank = metrics.evaluate(names, [5, 20], recs=hits_of_targets(scoring.target_rank(
        world["users"], world["items"], world["targets"], world["seen"]), 20))
    as_dict = lambda df: {r["metric"]: r["value"] for r in df.collect()}
    assert as_dict(by_list) == as_dict(by_rank)


def test_gauc_equals_pair_counting(world):
    got = evaluate_vectors(world["users"], world["items"], world["targets"], ["gauc"], [1]).first()["value"]
    total, weight = 0.0, 0
    for user in range(1, USERS + 1):
        pos = [i for u, i in world["target_list"] if u == user]
        if not pos:
            continue
        s = world["score"][user - 1]
        neg = [s[i - 1] for i in range(1, ITEMS + 1) if i not in pos]
        won = sum((s[p - 1] > x) + 0.5 * (s[p - 1] == x) for p in pos for x in neg)
        total, weight = total + won / len(neg), weight + len(pos)
    assert got == pytest.approx(total / weight, abs=6e-6)


def test_suppression_and_tail_of_pipeline(world):
    names = ["hit", "itemcoverage", "gauc"]
    got = evaluate_vectors(world["users"], world["items"], world["targets"], names, [5], seen=world["seen"], item_count=ITEMS)
    assert {r["metric"] for r in got.collect()} == {"hit@5", "itemcoverage@5", "gauc"}


def test_sort_multi_checks_lengths(world):
    with pytest.raises(ValueError):
        ranking.sort_multi(world["seen"], ("user_id", "up"))
    first = ranking.sort_multi(world["seen"], ("user_id", "desc"), ("item_id", "asc")).first()
    assert first["user_id"] == USERS
