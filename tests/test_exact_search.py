"""Exact search over item blocks with bounds: any ids, bitmaps over many items, fewer visits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import metrics, scoring
from pathloom.plans.evaluation import evaluate_vectors, recommend


def make(spark, users, items, ids, names, text=True):
    kind = "string" if text else "long"
    u = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in zip(names, users)], f"user_id {kind}, vector array<double>")
    i = spark.createDataFrame([(int(n), [float(x) for x in v]) for n, v in zip(ids, items)], "item_id long, vector array<float>")
    return u, i


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_sparse_ids_and_text_users(spark, spread):
    rng = np.random.default_rng(3)
    items = rng.normal(size=(300, 5)).astype(np.float32).astype(float) * np.exp(spread * rng.normal(size=(300, 1)))
    items = items.astype(np.float32).astype(float)
    if not spread:
        items[100:150] = items[:50]
    users = rng.normal(size=(12, 5))
    ids = rng.permutation(np.arange(1, 301) * 10**13 + 7)
    names = [f"user {i}" for i in range(12)]
    u, i = make(spark, users, items, ids, names)
    seen = [(names[a], int(ids[b])) for a, b in zip(rng.integers(0, 12, 400), rng.integers(0, 300, 400))] + [(names[0], int(x)) for x in ids[:295]] + [("stranger", 5), (names[1], 999)]
    gone = spark.createDataFrame(seen, "user_id string, item_id long")
    score, met = np.round(users @ items.T, 9), set(seen)
    got = {}
    for r in recommend(u, i, 7, gone, block=20).collect():
        got.setdefault(r["user_id"], []).append((r["rank"], r["item_id"]))
    targets = [(names[a], int(ids[b])) for a in range(12) for b in (3, 77, 298)] + [(names[2], 424242)]
    ranks = {(r["user_id"], r["item_id"]): r for r in scoring.target_rank(u, i, spark.createDataFrame(targets, "user_id string, item_id long"), gone, block=20).collect()}
    for a, name in enumerate(names):
        order = sorted((x for x in range(300) if (name, int(ids[x])) not in met), key=lambda x: (-score[a, x], ids[x]))
        assert [x for _, x in sorted(got[name])] == [int(ids[x]) for x in order[:7]]
        for b in (3, 77, 298):
            row = ranks[name, int(ids[b])]
            assert row["candidates"] == len(order)
            assert row["rank"] == (order.index(b) + 1 if b in order else len(order) + 1)
            if b in order:
                same = [p for p, x in enumerate(order, 1) if score[a, x] == score[a, b]]
                assert row["avg_rank"] == sum(same) / len(same)
    assert ranks[names[2], 424242]["rank"] == ranks[names[2], 424242]["candidates"] + 1 and len(ranks) == len(set(targets))


def test_bitmaps_over_many_items(spark):
    n = 40_000  # one block holds more items than one bitmap
    items = spark.range(1, n + 1).select((F.col("id") * 3).alias("item_id"), F.array(F.col("id").cast("double")).alias("vector"))
    users = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "user_id int, vector array<double>")
    seen = items.filter((F.col("item_id") % 2 == 0) | (F.col("item_id") > 3 * 39_000)).select(F.lit(1).alias("user_id"), "item_id")
    got = recommend(users, items, 3, seen, block=n).collect()
    assert {(r["user_id"], r["rank"], r["item_id"] // 3) for r in got} == {(1, 1, 38999), (1, 2, 38997), (1, 3, 38995), (2, 1, n), (2, 2, n - 1), (2, 3, n - 2)}
    blocks = scoring.ItemBlocks(items, n)
    bits = scoring.seen_bits(seen.unionByName(seen.withColumn("user_id", F.lit(99))), users, blocks)
    rows = bits.collect()
    assert {r["user_id"] for r in rows} == {1} and len(rows) == 2 and all(len(r["bits"]) == 4096 for r in rows)
    asked = spark.createDataFrame([(1, 3 * 5), (2, 3 * 5)], "user_id int, item_id long")
    ranks = {r["user_id"]: (r["rank"], r["candidates"]) for r in scoring.target_rank(users, items, asked, seen, block=n).collect()}
    assert ranks == {1: (19_500 - 2, 19_500), 2: (n - 4, n)}


def test_bounds_save_visits(spark):
    """Few long vectors, many short ones: most users never leave the first blocks."""
    rng = np.random.default_rng(5)
    items = rng.normal(size=(400, 4))
    items *= (np.where(np.arange(400) < 40, 50, 0.1) / np.linalg.norm(items, axis=1))[:, None]
    u, i = make(spark, rng.normal(size=(30, 4)), items, np.arange(1, 401), range(30), text=False)
    blocks = scoring.ItemBlocks(i, 20)
    assert len(blocks.bounds) == 20 and blocks.bounds == sorted(blocks.bounds, reverse=True) and not blocks.even
    near = u.withColumn("_last", blocks.reached(scoring._length("vector"), F.lit(5.0)))
    visits = scoring._cells(blocks, near, None, None).filter(F.col("kind") == 3).count()
    assert visits <= 30 * 3 < 30 * 20
    best = {(r["user_id"], r["rank"]): r["item_id"] for r in recommend(u, i, 2, block=20).collect()}
    score = np.round(np.array([r["vector"] for r in u.orderBy("user_id").collect()]) @ np.array([r["vector"] for r in i.orderBy("item_id").collect()]).T, 9)
    assert best == {(a, p + 1): int(x) + 1 for a in range(30) for p, x in enumerate(np.argsort(-score[a], kind="stable")[:2])}


def test_nothing_to_score(spark):
    u, i = make(spark, np.ones((2, 3)), np.ones((4, 3)), [1, 2, 3, 4], ["a", "b"])
    assert recommend(u, i.limit(0), 3).count() == 0 and recommend(u.limit(0), i, 3).count() == 0
    assert scoring.target_rank(u, i, spark.createDataFrame([], "user_id string, item_id long")).count() == 0


def test_tail_of_an_evaluation(spark):
    counts = spark.createDataFrame([(i, i // 4) for i in range(1, 41)], "item_id long, n long")
    for tail, want in ((0.1, [1, 2, 3, 4]), (0.01, [1]), (None, [1, 2, 3, 4]), (-1, [1, 2, 3, 4]), (2, list(range(1, 12))), (1, list(range(1, 41)))):
        assert sorted(r[0] for r in metrics.tail_items(counts, tail).collect()) == want
    u, i = make(spark, np.eye(3), np.eye(3), [1, 2, 3], [1, 2, 3], text=False)
    wanted = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "user_id long, item_id long")
    got = [evaluate_vectors(u, i, wanted, ["tailpercentage"], [1], popularity=spark.createDataFrame([(1, 1), (2, 5), (3, 9)], "item_id long, n long"), tail=t).first()["value"] for t in (0.1, 5, 0.7)]
    assert got == pytest.approx([1 / 3, 2 / 3, 2 / 3], abs=1e-4)


def test_visits_do_not_grow_with_the_product(spark):
    """F1 to F3: whatever small block is asked for, a user's vector is copied a bounded number of times."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 4))
    u, i = make(spark, rng.normal(size=(10, 4)), v / np.linalg.norm(v, axis=1)[:, None], np.arange(1, 3001), range(10), text=False)
    for block in (8, None):
        blocks = scoring.ItemBlocks(i, block)
        everyone = u.withColumn("_last", F.lit(len(blocks.bounds)))
        rows = {r["kind"]: r["count"] for r in scoring._cells(blocks, everyone, None, None).groupBy("kind").count().collect()}
        assert rows[3] <= 10 * scoring.BLOCKS and rows[0] <= 3000 * max(1, 2 * scoring.slots(spark) // len(blocks.bounds) + 1)
    assert len(scoring.ItemBlocks(i, 8).bounds) == scoring.BLOCKS


def test_few_seen_items_are_lists(spark):
    """before the shuffle a seen item is a place, and a user with few of them gets no whole bitmap."""
    items = spark.range(1, 5001).select(F.col("id").alias("item_id"), F.array(F.lit(1.0)).alias("vector"))
    users = spark.createDataFrame([(1, [1.0])], "user_id int, vector array<double>")
    seen = spark.createDataFrame([(1, x) for x in (4, 4, 9, 5000)], "user_id int, item_id long")
    bits = scoring.seen_bits(seen, users, scoring.ItemBlocks(items, 5000)).collect()
    assert [(r["n"], len(r["bits"])) for r in bits] == [(3, 6)]
    assert [r["item_id"] for r in recommend(users, items, 4, seen).orderBy("rank").collect()] == [1, 2, 3, 5]


def test_scores_of_a_chunk_are_bounded(monkeypatch):
    """users are multiplied as many at a time as SCORE_BYTES of scores hold, with the same results."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    vectors, users = rng.normal(size=(50, 3)), rng.normal(size=(7, 3))
    kinds = [scoring._ITEM] * 50 + [scoring._USER] * 7
    rows = pa.RecordBatch.from_pydict({"kind": kinds, "place": [*rng.permutation(50).tolist(), *[None] * 7], "item": [*range(1, 51), *[None] * 7],
                                       "user_id": [None] * 50 + [*range(7)], "vector": [*vectors.tolist(), *users.tolist()], "score": [None] * 57, "bits": pa.array([None] * 57, pa.binary())})
    sizes = []
    whole = scoring._matrix
    monkeypatch.setattr(scoring, "_matrix", lambda column, at: (sizes.append(len(at)), whole(column, at))[1])
    monkeypatch.setattr(scoring, "SCORE_BYTES", 8 * 50 * 2)
    cell = scoring._Cell()
    got = {user: dict(zip(ids.tolist(), line.tolist())) for user, ids, line in cell.scored(rows, cell.add(rows))}
    assert max(sizes[1:]) == 2 and not cell.parts
    assert all(got[u][i + 1] == pytest.approx(users[u] @ vectors[i], abs=1e-8) for u in range(7) for i in range(50))
