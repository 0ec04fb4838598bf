"""Answers do not depend on the path taken: the metrics asked together, frequent keys, segments."""

import pytest
from pyspark.sql import functions as F

from pathloom.functions.text import item_prompt_text
from pathloom.functions.arrays import insert_placeholders
from pathloom.operators import clean, ranking
from pathloom.operators.skew import lookup
from pathloom.plans.evaluation import evaluate_vectors


def test_metrics_alone_and_together(spark):
    users = spark.createDataFrame([(u, [1.0, float(u)]) for u in (1, 2, 3)], "user_id long, vector array<double>")
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in (1, 2, 3, 4)], "item_id long, vector array<double>")
    targets = spark.createDataFrame([(1, 4), (1, 9), (2, 1), (7, 2)], "user_id long, item_id long")  # item 9 and user 7 have no vector
    ask = lambda *names: {r["metric"]: r["value"] for r in evaluate_vectors(users, items, targets, names, [1, 3], item_count=4).collect()}
    together = ask("recall", "hit", "itemcoverage", "gauc")
    assert {**ask("recall", "hit"), **ask("itemcoverage"), **ask("gauc")} == together
    assert together["recall@1"] == 0.25  # one of two targets of the first user, none of the second's


def test_average_rank_with_and_without_frequent_keys(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 0.5), (1, None), (None, 0.5), (None, 0.0), (None, -0.0)], "user_id long, score double")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    cold, hot = (sorted(((r["row"], r["avg_rank"]) for r in ranking.average_rank(rows, frequent=f).collect())) for f in ([], [1, None]))
    assert cold == hot and len(hot) == 6


def test_filter_min_history_keeps_null_users(spark):
    rows = spark.createDataFrame([(None, [1, 2], 0), (1, [1], 0)], "user_id long, item_id array<int>, segment int")
    assert clean.filter_min_history(rows, "item_id", 2).count() == clean.filter_min_history(rows.drop("segment"), "item_id", 2).count() == 1


def test_equal_rows_of_a_frequent_key_are_spread(spark):
    rows = spark.range(4000).select(F.lit(5).alias("k"))
    right = spark.createDataFrame([(5, "x")], "k int, v string")
    joined = lookup(rows, right, "k", frequent=[5])
    assert joined.count() == 4000 and set(joined.columns) == {"k", "v"}


def test_numbers_and_booleans_in_prompts(spark):
    row = spark.createDataFrame([(12345678.0, 1e16, 0.00001, 1.5, True, False)], "a double, b double, c double, d double, e boolean, f boolean")
    text = row.select(item_prompt_text(row, list("abcdef"), "").alias("t")).first()["t"]
    assert text == "a: 12345678.0b: 1e+16c: 1e-05d: 1.5e: True"


def test_insert_plan_beyond_the_window(spark):
    with pytest.raises(Exception, match="window holds 3"):
        spark.range(1).select(insert_placeholders(F.array(F.lit(1), F.lit(2), F.lit(3)), [(5, 2)], 2)).collect()


@pytest.mark.parametrize("segment_rows", [1, 3, 7, 65_536])
def test_group_function_whatever_the_segments(spark, segment_rows):
    from pathloom.catalog.hooks import first_and_last, joined_segments
    from pathloom.operators.items import group_apply

    rows = spark.createDataFrame([(u, 10 * u + i, i, float(i)) for u in (1, 2, 3) for i in range(2 * u + 1)], "user_id int, item_id int, event_time int, value double")
    schema = "user_id int, segment int, events long, first_item int, last_item int, total double"
    got = group_apply(rows, ["user_id"], ["event_time"], first_and_last, schema, joined_segments, segment_rows).collect()
    assert sorted(map(tuple, got)) == [(u, 0, 2 * u + 1, 10 * u, 12 * u, float(sum(range(2 * u + 1)))) for u in (1, 2, 3)]
    if segment_rows < 7:
        with pytest.raises(Exception, match="needs a merge function"):
            group_apply(rows, ["user_id"], ["event_time"], first_and_last, schema, segment_rows=segment_rows).collect()


@pytest.mark.parametrize("segment_length", [1, 2, 5, 65_536])
def test_places_of_any_segments(spark, segment_length):
    from pathloom.operators.history import build_history_arrays, explode_history

    rows = spark.createDataFrame([(u, i * 2, i) for u in (1, 2, None) for i in range(9 if u == 2 else 4)], "user_id int, item_id int, event_time int")
    cut = build_history_arrays(rows, ["item_id"], ["event_time"], segment_length=segment_length)
    got = sorted(tuple(r) for r in explode_history(cut, ["item_id"]).fillna(0, "user_id").collect())
    assert got == sorted((u or 0, i + 1, i * 2) for u in (1, 2, None) for i in range(9 if u == 2 else 4))


def test_negatives_of_whole_windows_and_random_padding(spark):
    from pathloom.operators.negatives import sample_shared_negatives
    from pathloom.plans.training import training_examples

    full = spark.createDataFrame([(1, 0, [1, 2, 3]), (2, 0, [1, 2])], "user_id int, seq_no int, item_seq array<int>")
    assert {r["user_id"]: r["neg_item"] for r in sample_shared_negatives(full, 3, 4, 1, 1).collect()} == {1: [0] * 4, 2: [3] * 4}
    events = spark.createDataFrame([(f"u{u}", u + j, 60 * j) for u in (1, 2) for j in range(3 + 6 * u)], "user_id string, item_id int, event_time int")
    for r in training_examples(events, ["event_time"], 9, 40, num_negatives=6).collect():
        assert len(r["neg_item"]) == 6 and not set(r["neg_item"]) & set(r["item_seq"]) and len(r["item_seq"]) == 10
    for r in training_examples(events, ["event_time"], 9, 40, random_padding=True).collect():
        real = sum(r["masked_index"])
        assert len(r["neg_item"]) == 10 and 0 not in r["neg_item"] and 0 not in r["item_seq"]
        assert not set(r["neg_item"][: 10 - real]) & set(r["neg_item"][10 - real :])


def test_item_with_two_texts_does_not_double_rows(spark):
    from pathloom.operators.items import attach_item_text

    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, 0)], "user_id int, item_id int")
    items = spark.createDataFrame([(5, "b"), (5, "a"), (6, None), (7, "c"), (0, "pad")], "item_id int, title string")
    got = sorted(map(tuple, attach_item_text(rows, items, ["title"]).select("user_id", "text").collect()))
    assert [u for u, _ in got] == [1, 2, 3, 4] and got[0][1] == got[1][1] != "" and "a" in got[0][1] and got[2][1] == got[3][1] == ""


def test_groups_are_not_merged_into_few_tasks(spark):
    """F8: many small groups are spread over tasks, however few bytes they are, and so are their merges."""
    from pyspark import TaskContext

    from pathloom.operators.items import group_apply

    def where(rows):
        return rows.iloc[:1][["user_id"]].assign(task=TaskContext.get().partitionId(), merged=-1)

    def last(parts):
        return parts.iloc[:1].assign(merged=TaskContext.get().partitionId())

    rows = spark.createDataFrame([(u, i) for u in range(200) for i in (1, 2)], "user_id int, event_time int")
    got = group_apply(rows, ["user_id"], ["event_time"], where, "user_id int, task int, merged int", last, frequent=[]).collect()
    assert len(got) == 200 and len({r["task"] for r in got}) > 4 and len({r["merged"] for r in got}) > 4
