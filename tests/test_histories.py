"""Histories, sessions, ids and the preparation plan on small fixtures."""

import pytest
from pyspark.sql import functions as F

from pathloom.operators import clean, history, ids, profile
from pathloom.plans.dataset import build_dataset
from pathloom.sources.schemas import EVENT_FIELDS, MARKET_EVENT_CODES


@pytest.fixture(scope="module")
def events(spark):
    data = [("b", "x", 5, "item_view"), ("b", "y", 3, "buy_comp"), ("a", "x", 1, "item_like"), ("a", "z", 1, "item_view"),
            (None, "x", 9, "item_view"), ("b", "x", 9, "item_view"), ("c", "y", 2, "item_view")]
    return spark.createDataFrame(data, "user_id string, object_id string, event_time int, event_id string")


def test_history_segments_keep_all_events_in_order(spark, events, rows):
    whole = history.build_history_arrays(events.dropna(), ["object_id", "event_time"], ["event_time", "object_id"])
    assert rows(whole) == [("a", 0, ["x", "z"], [1, 1]), ("b", 0, ["y", "x", "x"], [3, 5, 9]), ("c", 0, ["y"], [2])]
    cut = history.build_history_arrays(events.dropna(), ["object_id"], ["event_time", "object_id"], segment_length=2)
    assert rows(cut) == [("a", 0, ["x", "z"]), ("b", 0, ["y", "x"]), ("b", 1, ["x"]), ("c", 0, ["y"])]
    assert rows(history.explode_history(cut, ["object_id"], segment_length=2).filter("user_id = 'b'")) == [
        ("b", 1, "y"), ("b", 2, "x"), ("b", 3, "x")]
    assert rows(clean.filter_min_history(cut, "object_id", 3), "user_id", "segment") == [("b", 0), ("b", 1)]


def test_null_elements_stay_in_place(spark, rows):
    df = spark.createDataFrame([(1, 1, "p"), (1, 2, None), (1, 3, "q")], "user_id int, event_time int, v string")
    assert rows(history.build_history_arrays(df, ["v"], ["event_time"])) == [(1, 0, ["p", None, "q"])]


def test_sessions_concatenate_in_session_order(spark, rows):
    df = spark.createDataFrame(
        [(1, 2, 10, "c"), (1, 1, 30, "b"), (1, 1, 20, "a"), (2, 1, 5, "d")], "user_id int, sequence_id int, stime int, item string"
    ).withColumn("seq_user_id", F.concat_ws("_", "user_id", "sequence_id"))
    sessions = history.build_session_arrays(df, ["item"], ["stime"])
    assert rows(sessions, "seq_user_id", "item") == [("1_1", ["a", "b"]), ("1_2", ["c"]), ("2_1", ["d"])]
    joined = history.concat_sessions(sessions, ["item"])
    assert rows(joined, "user_id", "item") == [(1, ["a", "b", "c"]), (2, ["d"])]
    split = history.build_session_arrays(df, ["item"], ["stime"], segment_length=1)
    assert rows(history.concat_sessions(split, ["item"]), "user_id", "item") == [(1, ["a", "b", "c"]), (2, ["d"])]


@pytest.mark.parametrize("min_rows", [2, 10**6])
def test_sessions_fall_into_segments(spark, rows, min_rows):
    sizes = {1: [3, 0, 9, 1, 4], 2: [2], None: [5, 6], 3: [0]}
    data = [(u, q, [f"{u}-{q}-{i}" for i in range(n)], list(range(n))) for u, ns in sizes.items() for q, n in enumerate(ns)]
    sessions = spark.createDataFrame([*data, (2, 7, None, [1])], "user_id int, sequence_id int, item array<string>, place array<int>")
    joined = history.concat_sessions(sessions, ["item", "place"], segment_length=4, min_rows=min_rows)
    whole = {u: [x for d in data if d[0] == u for x in d[2]] for u in sizes}
    got = {(r["user_id"], r["segment"]): (r["item"], r["place"]) for r in joined.collect()}
    want = {(u, s // 4): x[s : s + 4] for u, x in whole.items() for s in range(0, len(x), 4)}
    assert {k: v[0] for k, v in got.items()} == want
    assert all([int(x.split("-")[2]) for x in items] == places for items, places in got.values())
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_item_table_takes_the_earliest_values(spark, events, rows):
    got = history.build_item_table(events.dropna(), ["event_id"], ["event_time", "user_id"])
    assert rows(got) == [("x", "item_like"), ("y", "item_view"), ("z", "item_view")]


@pytest.mark.parametrize("min_rows", [1, 10**6])
def test_gap_to_next_crosses_blocks(spark, rows, min_rows):
    df = spark.range(9000).select(F.lit(1).alias("user_id"), (F.col("id") * 2).cast("int").alias("event_time"))
    got = history.gap_to_next(df, "event_time", ["event_time"], min_rows=min_rows)
    assert got.count() == 9000
    assert got.filter("gap = 2").count() == 8999
    assert rows(got.filter("gap = 0"), "event_time") == [(17998,)]


def test_vocabularies(spark, events, rows):
    assert rows(ids.dense_vocabulary(events, "user_id")) == [("a", 1, 2), ("b", 2, 3), ("c", 3, 1)]
    first = ids.first_seen_vocabulary(events, "object_id", [F.col("event_time"), F.col("user_id"), F.col("object_id")])
    assert rows(first, "token", "id") == [("x", 1), ("y", 3), ("z", 2)]
    assert rows(ids.dense_ids(events, "user_id"), "user_id", "object_id")[-1] == (None, "x")
    assert rows(ids.sorted_ids(events, "user_id"), "user_id")[0] == (0,)


def test_unknown_tokens(spark, events, rows):
    vocabulary = ids.dense_vocabulary(events.filter("object_id <> 'z'"), "object_id")
    coded = ids.encode_ids(events, "object_id", vocabulary)
    assert coded.filter("object_id is null").count() == 1
    back = ids.decode_ids(coded, "object_id", vocabulary)
    assert rows(back.dropna(), "object_id") == rows(events.filter("object_id <> 'z'").dropna(), "object_id")


def test_build_dataset(spark, events, rows):
    raw = events.withColumns(
        {"stime": F.timestamp_millis(F.col("event_time") * 1000 + 500), "brand_name": F.lit("q"), "product_id": F.col("object_id"),
         "c0_name": F.lit("top"), "c1_name": F.when(F.col("object_id") == "x", "mid"), "c2_name": F.lit(None).cast("string")}
    ).drop("object_id", "event_time")
    histories, items = build_dataset(raw, event_codes=MARKET_EVENT_CODES, min_events=2, tie=["product_id"], share_events=True)
    # x.5 seconds round to the even second; ids are dense over the kept users and their items.
    assert rows(histories) == [(1, 0, [1, 3], [2, 2], [1, 0]), (2, 0, [2, 1, 1], [4, 6, 10], [5, 0, 0])]
    assert rows(items) == [(1, "q", "mid"), (2, "q", "top"), (3, "q", "top")]


def test_event_codes_and_rejects(spark, events, rows):
    kept, rejected = clean.split_by_event_code(events, "event_id", {"item_view": 0, "item_like": 1})
    assert kept.count() == 6 and rows(rejected, "event_id") == [("buy_comp",)]


def test_struct_has_all_fields_in_order(spark):
    df = spark.range(1).select(*[F.lit(None).cast(t).alias(n) for n, t in EVENT_FIELDS.items()])
    assert list(df.select(clean.pack_event_struct().alias("e")).select("e.*").columns) == list(EVENT_FIELDS)
    assert len(EVENT_FIELDS) == 14


def test_core_filter_rechecks_users(spark, rows):
    data = [(u, i) for u in range(6) for i in range(5)] + [(9, 0), (9, 1), (9, 2), (9, 3), (9, 77)]
    df = spark.createDataFrame(data, "user_id int, item_id int")
    kept = clean.filter_core_once(df, 5)
    assert {r["user_id"] for r in kept.collect()} == set(range(6))


def test_length_histogram_bounds(spark, rows):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4096, 4097)], "history_len int")
    got = dict(rows(profile.length_survival_histogram(df)))
    assert got[1] == 4 and got[2] == 3 and got[4] == 1 and got[2048] == 1 and len(got) == 12
