"""Cutting, padding and masking on the worked examples and edge lengths."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pathloom.functions import arrays, times
from pathloom.operators import sequences


def placed(spark, *lengths):
    data = [(u, i, 100 * i, i, n) for u, n in enumerate(lengths, 1) for i in range(1, n + 1)]
    return spark.createDataFrame(data, "user_id int, item_id int, event_time int, pos long, n long")


def chunks(df):
    return [(r["user_id"], r["seq_no"], r["item_seq"]) for r in df.orderBy("user_id", "seq_no").collect()]


def test_chunks_drop_the_oldest_remainder(spark):
    got = chunks(sequences.chunk_sequences(placed(spark, 7, 6, 3, 2), 3))
    assert got == [
        (1, 0, [2, 3, 4]), (1, 1, [5, 6, 7]), (2, 0, [1, 2, 3]), (2, 1, [4, 5, 6]), (3, 0, [1, 2, 3]), (4, 0, [1, 2]),
    ]
    assert chunks(sequences.chunk_sequences(placed(spark, 7), 3, split=False)) == [(1, 0, [5, 6, 7])]


def test_right_aligned_chunks(spark):
    assert chunks(sequences.right_aligned_chunks(placed(spark, 7, 2, 3), 3)) == [
        (1, 1, [5, 6, 7]), (1, 2, [2, 3, 4]), (3, 1, [1, 2, 3])
    ]


def test_leave_last_k(spark):
    left = sequences.leave_last_k_train(placed(spark, 1, 2, 4), 2)
    assert [(r["user_id"], r["pos"], r["n"]) for r in left.orderBy("pos").collect()] == [(3, 1, 2), (3, 2, 2)]


def test_prefixes(spark):
    windows = sequences.chunk_sequences(placed(spark, 3, 1), 5)
    got = sorted(r["item_seq"] for r in sequences.prefix_augment(windows).collect())
    assert got == [[1, 2], [1, 2, 3]]


def test_eval_split(spark):
    valid = {r["user_id"]: r for r in sequences.eval_split(placed(spark, 5, 2, 1), 4, "valid", 2).collect()}
    assert set(valid) == {1, 2}
    assert valid[1]["item_seq"] == [0, 1, 2, 3] and valid[1]["target"] == 4 and valid[1]["history_len"] == 3
    assert valid[2]["item_seq"] == [0, 0, 0, 0] and valid[2]["target"] == 1
    test = {r["user_id"]: r for r in sequences.eval_split(placed(spark, 5), 3, "test", 2).collect()}
    assert test[1]["item_seq"] == [2, 3, 4] and test[1]["target"] == 5
    assert sequences.eval_history(placed(spark, 5), "valid", 2).count() == 3
    assert sequences.short_histories(placed(spark, 5, 1)).count() == 1
    with pytest.raises(ValueError):
        sequences.eval_split(placed(spark, 5), 3, "test", 1)


SLICES = [(-7, -2), (0, None), (-20, -3), (3, 0), (2, 5), (12, None), (0, -20), (-3, None)]


@pytest.mark.parametrize("start,end", SLICES)
def test_slices_follow_python(spark, start, end):
    seq = list(range(1, 11))
    want = seq[start:(end or None)]
    df = spark.createDataFrame([(seq,)], "s array<int>")
    assert df.select(arrays.position_slice(F.col("s"), start, end)).first()[0] == want
    sliced = sequences.slice_events(placed(spark, 10), start, end).orderBy("pos").collect()
    assert [r["item_id"] for r in sliced] == want
    assert [r["pos"] for r in sliced] == list(range(1, len(want) + 1))
    assert all(r["n"] == len(want) for r in sliced)


def test_window_example(spark):
    """History 1..6 with L = 5: inputs 1-5, targets 2-6, mask all 1."""
    row = spark.createDataFrame([([1, 2, 3, 4, 5, 6],)], "s array<int>").select(
        arrays.input_items(F.col("s")), arrays.target_items(F.col("s")), arrays.position_mask(F.size("s"), 5)
    ).first()
    assert list(row) == [[1, 2, 3, 4, 5], [2, 3, 4, 5, 6], [1] * 5]


@pytest.mark.parametrize("seq,want", [([], [0, 0, 0]), ([4], [0, 0, 4]), ([1, 2, 3], [1, 2, 3]), ([1, 2, 3, 4, 5, 6], [4, 5, 6])])
def test_left_pad(spark, seq, want):
    df = spark.createDataFrame([(seq,)], "s array<int>")
    padded, mask = df.select(arrays.left_pad(F.col("s"), 3).alias("p")).select("p", arrays.real_item_mask(F.col("p"))).first()
    assert padded == want and mask == [int(x != 0) for x in want]
    assert len(df.select(arrays.position_mask(F.size("s"), 3)).first()[0]) == 3


def test_placeholders_segments_and_loss_mask(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],)], "s array<int>")
    plan = [(2, 1), (4, 2)]
    seq = arrays.insert_placeholders(F.col("s"), plan, 3)
    bounds = arrays.segment_bounds(F.size("s"), plan, 3)
    mask = arrays.insert_placeholders(F.lit([1] * 5), plan, 3, marker=1)
    got = df.select(seq, bounds, arrays.loss_mask(mask, bounds), arrays.loss_mask(mask, bounds, True)).first()
    assert got[0] == [1, 2, -1, 3, 4, -1, -1, 5]
    assert [tuple(b) for b in got[1]] == [(0, 1), (3, 4), (7, 7)]
    assert got[2] == [1, 1, 0, 1, 1, 0, 0, 1] and got[3] == [0, 0, 0, 0, 0, 0, 0, 1]
    with pytest.raises(ValueError):
        arrays.insert_placeholders(F.col("s"), plan, 2)


def test_split_long_recent(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],)], "s array<int>")
    assert list(df.select(*arrays.split_long_recent(F.col("s"), 2, 2)).first()) == [[1, 2], [4, 5]]
    with pytest.raises(PySparkException):
        df.select(*arrays.split_long_recent(F.col("s"), 4, 2)).collect()


def test_token_layout(spark):
    df = spark.createDataFrame([([7, 8, 9],), ([],)], "t array<int>")
    got = [tuple(r[0]) for r in df.select(arrays.token_layout(F.col("t"), 2, 1)).collect()]
    assert got == [([7, 8, 0], 3, [0, 1, 2]), ([0], 1, [2])]
    none = df.select(arrays.token_layout(F.col("t"), 2, 0).alias("x")).collect()
    assert tuple(none[1]["x"]) == ([], 0, [])


def test_pad_scores(spark):
    df = spark.createDataFrame([([1.5],)], "s array<double>")
    assert df.select(arrays.pad_scores(F.col("s"), 3)).first()[0] == [1.5, float("-inf"), float("-inf")]


def test_epochs(spark):
    df = spark.sql("select * from values (timestamp'2024-01-01 00:00:00.5'), (timestamp'2024-01-01 00:00:01.5'), "
                   "(timestamp'1969-12-31 23:59:58.4') as t(ts)")
    got = [tuple(r) for r in df.select(times.epoch_seconds_rounded(F.col("ts")), times.epoch_seconds_truncated(F.col("ts"))).collect()]
    assert got == [(1704067200, 1704067200), (1704067202, 1704067201), (-2, -1)]


def test_decompose_padding_time(spark):
    df = spark.createDataFrame([([0, 1704164645],)], "t array<int>")
    assert df.select(times.decompose_time(F.col("t"))).first()[0] == [[1970, 1, 1, 0, 0, 0], [2024, 1, 2, 3, 4, 5]]


@pytest.mark.parametrize("gap,bucket", [(0, 0), (1, 0), (2, 2), (-100, 15), (10**9, 68)])
def test_gap_bucket(spark, gap, bucket):
    assert spark.range(1).select(times.time_gap_bucket(F.lit(gap))).first()[0] == bucket
