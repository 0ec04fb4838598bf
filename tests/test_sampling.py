"""Negatives, splits, shards, batches, contrastive evaluation and the graph."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.functions.draws import skip_seen
from pathloom.operators import batches, contrastive, graph, negatives, splits
from pathloom.operators.skew import global_index
from pathloom.plans.training import training_examples


@pytest.fixture(scope="module")
def windows(spark):
    data = [(u, s, [(u * 3 + j * j + s) % 12 + 1 for j in range(2 + (u + s) % 7)]) for u in range(1, 30) for s in range(3)]
    return spark.createDataFrame(data, "user_id int, seq_no int, item_seq array<int>")


@pytest.mark.parametrize("draw", ["hash", "arithmetic"])
def test_negatives_avoid_the_window(windows, draw):
    rows = negatives.sample_negatives(windows, 12, draw=draw).collect()
    assert len(rows) == windows.count()
    for r in rows:
        assert len(r["neg_item"]) == len(r["item_seq"]) - 1
        assert not set(r["neg_item"]) & set(r["item_seq"])
        assert all(1 <= x <= 12 for x in r["neg_item"])


def test_draws_repeat_for_a_seed_and_reach_every_item(windows):
    one = negatives.sample_negatives(windows, 12, seed=1).repartition(3).collect()
    two = negatives.sample_negatives(windows.repartition(7), 12, seed=1).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    other = negatives.sample_negatives(windows, 12, seed=2).collect()
    assert sorted(map(str, one)) != sorted(map(str, other))
    assert {x for r in one for x in r["neg_item"]} == set(range(1, 13))


def test_window_with_every_item_gets_padding(spark):
    full = spark.createDataFrame([(1, 0, [1, 2, 3, 3])], "user_id int, seq_no int, item_seq array<int>")
    assert negatives.sample_negatives(full, 3).first()["neg_item"] == [0, 0, 0]
    single = spark.createDataFrame([(1, 0, [2])], "user_id int, seq_no int, item_seq array<int>")
    assert negatives.sample_negatives(single, 3).first()["neg_item"] == []
    assert negatives.left_pad_negatives(full, 6, 3).first()["item_seq"] == [0, 0, 1, 2, 3, 3]


def test_shared_negatives(windows):
    assert negatives.shared_count(100, 2, 16) == 4
    rows = negatives.sample_shared_negatives(windows, 12, 100, 2, 16).collect()
    assert all(len(r["neg_item"]) == 4 and not set(r["neg_item"]) & set(r["item_seq"]) for r in rows)
    free = negatives.sample_shared_negatives(windows, 12, 100, 2, 16, exclude_history=False).collect()
    assert any(set(r["neg_item"]) & set(r["item_seq"]) for r in free)


def test_padding_with_negatives(windows):
    for r in negatives.left_pad_negatives(windows, 10, 12).join(
        windows.withColumnRenamed("item_seq", "before"), ["user_id", "seq_no"]).collect():
        assert len(r["item_seq"]) == 10 and r["item_seq"][-len(r["before"]):] == r["before"]
        assert not set(r["item_seq"][: 10 - len(r["before"])]) & set(r["before"])


def test_dropout_rate_and_place(windows):
    wide = windows.withColumn("item_seq", F.array_repeat(F.lit(1), 200))
    kept = negatives.item_dropout(wide, F.transform("item_seq", lambda x: F.lit(1)), 100, 0.25).collect()
    early = [m for r in kept for m in r["mask"][:100]]
    late = [m for r in kept for m in r["mask"][100:]]
    assert set(early) == {1} and 0.22 < 1 - sum(late) / len(late) < 0.28
    with pytest.raises(ValueError):
        negatives.item_dropout(wide, F.col("item_seq"), 0, 1.5)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seen=st.lists(st.integers(0, 15), max_size=12))
def test_skip_seen_walks_all_unseen_items(spark, seen):
    unseen = [i for i in range(1, 21) if i not in seen]
    df = spark.createDataFrame([(seen,)], "s array<int>")
    got = df.select(*[skip_seen(F.lit(k + 1), F.col("s")) for k in range(len(unseen))]).first()
    assert list(got) == unseen


@pytest.mark.parametrize("n", [0, 1, 9, 10, 101])
def test_split_sizes_are_exact(spark, n):
    rows = splits.split_rows(spark.range(n).withColumnRenamed("id", "k"), "k", seed=5).collect()
    sizes = {s: sum(r["split"] == s for r in rows) for s in ("train", "valid", "test")}
    assert len({r["k"] for r in rows}) == n
    assert sizes == {"train": int(n * 0.8), "valid": int(n * 0.1), "test": n - int(n * 0.8) - int(n * 0.1)}


def test_user_split_and_shuffle(spark, windows):
    halves = splits.split_users(windows, 0.5)
    per_user = halves.groupBy("user_id").agg(F.countDistinct("half").alias("h")).filter("h > 1").count()
    assert per_user == 0 and splits.restrict_users(halves, 1).select("user_id").distinct().count() == 14
    rows = spark.range(50).withColumnRenamed("id", "k")
    order = [[r["k"] for r in splits.shuffle_rows(rows, "k", epoch=e).orderBy("idx").collect()] for e in (0, 0, 1)]
    assert order[0] == order[1] != order[2] and sorted(order[0]) == list(range(50))
    approx = splits.split_rows_approximately(spark.range(5000).withColumnRenamed("id", "k"), "k")
    assert 3800 < approx.filter("split = 'train'").count() < 4200


@pytest.mark.parametrize("n,shards,batch", [(10, 3, 2), (12, 3, 4), (1, 2, 4)])
def test_contiguous_shards(spark, n, shards, batch):
    indexed = global_index(spark.range(n).withColumnRenamed("id", "k"), [F.col("k")])
    rows = splits.shard_contiguous(indexed, shards, batch)
    per = math.ceil(n / batch / shards) * batch
    assert {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()} == {s: per for s in range(shards)}
    assert splits.without_fillers(rows).count() == n
    assert {r["k"] for r in rows.filter("filler").collect()} <= {n - 1}
    assert splits.shard_strided(indexed, 3).filter("shard = k % 3").count() == n


def test_pack_batches(windows):
    indexed = global_index(windows, [F.col("user_id"), F.col("seq_no")])
    packed = batches.pack_batches(indexed, 16, ["user_id"], ["item_seq"]).orderBy("batch_id").collect()
    assert [len(r["user_id"]) for r in packed] == [16] * 5 + [7]
    flat = [x for r in indexed.orderBy("idx").collect() for x in r["item_seq"]]
    assert [x for r in packed for x in r["item_seq"]] == flat
    assert all(sum(r["item_seq_lens"]) == len(r["item_seq"]) for r in packed)


def test_contrastive_equals_numpy(spark):
    rng = np.random.default_rng(2)
    o, p, g = rng.normal(size=(3, 11, 4))
    g[3] = 5 * p[2]
    data = [(i // 6, i, *[[float(x) for x in m[i]] for m in (o, p, g)]) for i in range(11)]
    df = spark.createDataFrame(data, "batch_id long, example_id long, output array<double>, positive array<double>, negative array<double>")
    got = {r["example_id"]: r for r in contrastive.batch_negatives(df).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    o, p, g = unit(o), unit(p), unit(g)
    for i in range(11):
        others = [j for j in range(11) if j // 6 == i // 6 and p[i] @ g[j] <= 0.99]
        logits = 20 * np.array([o[i] @ p[i], *[o[i] @ g[j] for j in others]])
        assert got[i]["kept"] == len(others)
        assert got[i]["loss"] == pytest.approx(np.log(np.exp(logits).sum()) - logits[0])
        assert got[i]["pos_rank"] == 1 + (logits[1:] > logits[0]).sum()
    metrics = {r["metric"]: r["value"] for r in contrastive.contrastive_eval(df).collect()}
    assert metrics["nce_samples"] == pytest.approx(np.mean([got[i]["kept"] + 1 for i in range(11)]))
    assert "nce_top10_acc" not in metrics and "nce_top5_acc" in metrics


@pytest.mark.parametrize("tile", [3, 8, 2048])
def test_pool_of_a_masked_batch(spark, tile):
    """Any number of negatives an example, masked examples without a row, cells of any size."""
    rng = np.random.default_rng(8)
    o, p = rng.normal(size=(2, 40, 4))
    g = [rng.normal(size=(int(rng.integers(0, 4)), 4)) for _ in range(40)]
    g[7] = np.stack([p[9] * 3, p[1]])
    batch = [0 if i < 30 else 1 + i % 2 for i in range(40)]
    data = [(batch[i], i, o[i].tolist(), p[i].tolist(), g[i].tolist(), i % 4 != 1) for i in range(40)] + [(9, 100, [1.0, 0.0, 0.0, 0.0], [1.0, 1.0, 0.0, 0.0], [], True)]
    schema = "batch_id long, example_id long, output array<double>, positive array<double>, negatives array<array<double>>, used boolean"
    df = spark.createDataFrame(data, schema).repartition(3)
    got = {r["example_id"]: r for r in contrastive.batch_negatives(df, mask="used", tile=tile).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    o, p = unit(o), unit(p)
    assert set(got) == {i for i in range(40) if i % 4 != 1} | {100}
    for i in set(got) - {100}:
        pool = unit(np.concatenate([g[j] for j in range(40) if batch[j] == batch[i]]))
        keep = pool[p[i] @ pool.T <= 0.99]
        logits = 20 * np.array([o[i] @ p[i], *(keep @ o[i])])
        assert (got[i]["negatives"], got[i]["kept"], got[i]["pos_rank"]) == (len(pool), len(keep), 1 + (logits[1:] > logits[0]).sum())
        assert got[i]["loss"] == pytest.approx(np.log(np.exp(logits).sum()) - logits[0]) and got[i]["best_negative"] == pytest.approx(logits[1:].max() / 20)
    assert (got[100]["negatives"], got[100]["pos_rank"], got[100]["best_negative"]) == (0, 1, None) and got[100]["loss"] == pytest.approx(0)


@pytest.mark.parametrize("frequent", [None, [], [1, 4]])
def test_adjacency(spark, rows, frequent):
    events = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (1, 1)], "user_id int, item_id int")
    got = rows(graph.normalized_adjacency(events, 3, frequent))
    degree = {1: 3, 2: 1, 4: 3, 5: 1}
    want = sorted(((s, d, 1 / math.sqrt(degree[s]) * (1 / math.sqrt(degree[d])))
                   for a, b in [(1, 4), (1, 5), (2, 4), (1, 4)] for s, d in ((a, b), (b, a))), key=repr)
    assert [r[:2] for r in got] == [w[:2] for w in want]
    assert [r[2] for r in got] == pytest.approx([w[2] for w in want])


@pytest.mark.parametrize("random_padding", [False, True])
def test_training_examples(spark, random_padding):
    events = spark.createDataFrame([(u, u + j, 60 * j) for u in (1, 2) for j in range(3 + 6 * u)],
                                   "user_id int, item_id int, event_time int")
    out = training_examples(events, ["event_time"], 4, 40, random_padding=random_padding).orderBy("user_id", "seq_no").collect()
    # 7 events left of 9: two dropped, one window; 13 left of 15: three dropped, two windows.
    assert [(r["user_id"], r["seq_no"]) for r in out] == [(1, 0), (2, 0), (2, 1)]
    for r in out:
        assert len(r["item_seq"]) == len(r["neg_item"]) == len(r["time_ids"]) == 5 and len(r["masked_index"]) == 4
        assert (0 in r["item_seq"]) <= (not random_padding)
        real = [x for x, m in zip(r["neg_item"][1:], r["masked_index"]) if m]
        assert real and 0 not in real


def test_tasks_of_tiles_follow_the_rows(spark, monkeypatch):
    """more rows of cells mean more tasks, not larger ones; floats stay floats on the way."""
    monkeypatch.setattr(contrastive, "TASK_ROWS", 40)
    rows = [(b, 100 * b + e, *[[float(x + e + b), float(x * e % 7 + 1)] for x in (1, 2, 3)]) for b in range(40) for e in range(10)]
    df = spark.createDataFrame(rows, "batch_id long, example_id long, output array<float>, positive array<float>, negative array<float>")
    pool = df.select("batch_id", "example_id", "negative", F.lit(0).alias("_no"))
    cells = contrastive._tiles(df, pool, 4)
    assert cells.count() == 40 * (10 * 3 + 10 * 3)
    assert cells.rdd.getNumPartitions() == 40 * 60 // 40 and cells.schema["a"].dataType.elementType.typeName() == "float"
    narrow = contrastive.batch_negatives(df, tile=4)
    wide = contrastive.batch_negatives(df.withColumns({c: F.col(c).cast("array<double>") for c in ("output", "positive", "negative")}))
    shown = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
    assert shown(narrow) == shown(wide)


def test_events_are_not_copied_to_every_task(spark, monkeypatch):
    """each event meets the next one in a merge, not by a broadcast of one row for each event."""
    from pathloom.catalog import sampling

    seen = []
    monkeypatch.setattr(sampling, "global_index", lambda df, *more: (seen.append(df), global_index(df, *more))[1])
    sampling.contrastive_examples(spark, "/root/testdata/sf0.001")
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [user_id" in plan and "BroadcastHashJoin [user_id" not in plan


@pytest.mark.parametrize(("tile", "task_rows"), [(3, 1 << 17), (3, 60), (2048, 1 << 17)])
def test_named_vectors_travel_once(spark, monkeypatch, tile, task_rows):
    """examples that name their vectors give the sums of examples that hold them; a task gets a vector once."""
    monkeypatch.setattr(contrastive, "TASK_ROWS", task_rows)
    rng = np.random.default_rng(5)
    table = [(7 * i, rng.normal(size=4).tolist()) for i in range(9)]
    vectors = spark.createDataFrame(table, "id long, vector array<float>")
    ids = rng.integers(0, 8, size=(120, 3)) * 7
    data = [(i // 30, i, *map(int, ids[i]), i % 3 != 0) for i in range(120)] + [(0, 1, 0, 7, 14, True)]  # one id twice
    named = spark.createDataFrame(data, "batch_id long, example_id long, output long, positive long, negative long, used boolean").repartition(5)
    held = named
    for c in ("output", "positive", "negative"):
        held = held.withColumnRenamed(c, "id").join(vectors, "id").drop("id").withColumnRenamed("vector", c)
    shown = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
    got = shown(contrastive.batch_negatives(named, mask="used", tile=tile, vectors=vectors))
    assert len(got) == 80 and got == shown(contrastive.batch_negatives(held, mask="used", tile=tile))
    assert contrastive.contrastive_eval(named, vectors=vectors).count() == contrastive.contrastive_eval(held).count()

    pool = named.select("batch_id", "example_id", "negative", F.lit(0).alias("_no"))
    cells = contrastive._named_tiles(named, pool, tile, vectors).withColumn("task", F.spark_partition_id()).collect()
    sent = [(r["task"], r["example_id"]) for r in cells if r["vector"] is not None]
    used = {(r["task"], v) for r in cells if r["vector"] is None for v in (r["a"], r["b"]) if v is not None}
    assert len(sent) == len(set(sent)) and set(sent) == used
    assert len(cells) - len(sent) == (2 * (31 * 11 + 3 * 30 * 10) if task_rows == 60 else 242)
    with pytest.raises(Exception, match="a vector is null or not in the table"):
        contrastive.batch_negatives(named, vectors=vectors.filter("id > 7")).collect()


def test_contrastive_examples_name_their_vectors(spark, tmp_path):
    """no vector is shuffled with an example, and the query's rows are those of examples that hold vectors, with
    items that have no vector and items that have two."""
    from pathloom.catalog import sampling
    from pathloom.catalog.registry import QUERIES
    from pathloom.catalog.tables import item_vectors

    rng = np.random.default_rng(6)
    events = [(i, i % 7, int(rng.integers(0, 12)), i * 60) for i in range(200)]
    events = spark.createDataFrame(events, "event_id long, user_id long, k int, s long")
    events = events.select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"),
                           F.format_string('{"k": %d}', "k").alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    table = [(i, rng.normal(size=6).tolist(), 0) for i in [*range(11), 3, 3, 5]]
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")

    examples, vectors = sampling.contrastive_examples(spark, str(tmp_path))
    assert {f.dataType.typeName() for f in examples.schema} == {"long"}
    assert vectors.count() == vectors.select("id").distinct().count() == 14
    held = examples
    for c in ("output", "positive", "negative"):
        held = held.withColumnRenamed(c, "id").join(vectors, "id").drop("id").withColumnRenamed("vector", c)
    want = contrastive.batch_negatives(held.withColumn("used", F.col("example_id") % 3 != 0), mask="used", tile=20)
    got = QUERIES["contrastive_masked"](spark, str(tmp_path))
    shown = lambda d: {r[0]: pytest.approx(tuple(r), abs=2e-6) for r in d.select("example_id", "negatives", "kept", "loss", "pos_rank").collect()}
    want = shown(want)
    assert {r["example_id"]: tuple(r) for r in got.collect()} == want and len(want) > 50

    # The same examples straight from the log: an example needs all three items, and comes once for each choice of their vectors.
    choices = {r["item_id"]: r["n"] for r in item_vectors(spark, str(tmp_path)).groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    log = {}
    for r in sorted(events.collect(), key=lambda r: r["event_id"]):
        log.setdefault(r["user_id"] + 1, []).append(int(r["props"].split(":")[1].rstrip("}")) + 1)
    top, index, expected = max(map(max, log.values())), 0, {}
    for user in sorted(log):
        for pos, (o, t) in enumerate(zip(log[user], log[user][1:]), 1):
            index += 1
            n = choices.get(o, 0) * choices.get(t, 0) * choices.get(1 + (7 + user * 7919 + pos * 104729) % top, 0)
            if n:
                expected[index] = n
    found = {r["example_id"]: r["count"] for r in examples.groupBy("example_id").count().collect()}
    assert found == expected and len(expected) < index and max(expected.values()) > 1
