"""The balanced building blocks against plain Spark, with every key treated as frequent."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pathloom.operators.skew import frequent_keys, global_index, lookup, positions, running_sums


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 events: a third belong to user 1, a tenth to no user; a third are exact copies."""
    base = spark.range(0, 3000, 1, 6)
    user = F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 37 + 2).cast("int")
    copy = F.col("id") % 3 == 0
    return base.select(
        user.alias("user_id"),
        F.when(copy, 7).otherwise(F.col("id") % 11).cast("int").alias("item_id"),
        F.when(copy, F.floor(F.col("id") / 900)).otherwise(F.col("id") % 50).cast("int").alias("event_time"),
    )


def test_frequent_keys_are_found_and_bounded(spark, skewed):
    found = frequent_keys(skewed, "user_id", min_rows=100)
    assert found[0] == 1 and None in found
    assert len(found) <= 4 * max(spark.sparkContext.defaultParallelism, 4)
    assert frequent_keys(skewed, "user_id") == []


def test_sampled_detection_finds_a_heavy_key(spark):
    events = spark.range(400_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"))
    assert frequent_keys(events, "k", min_rows=40_000) == [5]


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("min_rows", [1, 100, 10**6])
def test_lookup_equals_plain_join(spark, skewed, rows, how, min_rows):
    right = spark.range(1, 30).select(F.col("id").cast("int").alias("user_id"), (F.col("id") * 2).alias("twice"))
    got = lookup(skewed, right, "user_id", how, min_rows=min_rows)
    assert got.columns == ["user_id", "item_id", "event_time", "twice"]
    assert rows(got) == rows(skewed.join(right, "user_id", how).select(got.columns))


def test_lookup_salts_frequent_keys(spark, skewed):
    right = spark.range(1, 30).select(F.col("id").cast("int").alias("user_id"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        distinct = skewed.withColumn("event_time", F.monotonically_increasing_id())
        sizes = (
            lookup(distinct, right, "user_id", "inner", min_rows=100)
            .filter("user_id = 1").groupBy(F.spark_partition_id()).count().collect()
        )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 1000


@pytest.mark.parametrize("min_rows", [1, 100, 10**6])
@pytest.mark.parametrize("keys", [["user_id"], ["user_id", "item_id"]])
def test_positions_equal_window(spark, skewed, rows, min_rows, keys):
    order = [F.col("event_time").desc(), F.col("item_id")]
    group = Window.partitionBy(*keys)
    want = skewed.withColumn("pos", F.row_number().over(group.orderBy(*order)).cast("long")).withColumn(
        "n", F.count("*").over(group)
    )
    got = positions(skewed, keys, order, total="n", min_rows=min_rows)
    assert rows(got) == rows(want)


def test_hot_group_with_copies_is_spread(spark, skewed):
    """The rows of the hot user, all equal but for four times, are numbered by several tasks."""
    from pathloom.operators.skew import _numbered

    hot = skewed.filter("user_id = 1")
    parts = _numbered(hot, [F.col("user_id"), F.col("event_time"), F.col("item_id")], "test").groupBy("_part").count()
    assert max(r["count"] for r in parts.collect()) < 400


def test_global_index_is_dense_and_ordered(spark, skewed):
    got = global_index(skewed, [F.col("event_time"), F.col("user_id")]).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(1, 3001))
    times = [r["event_time"] for r in got]
    assert times == sorted(times)


def test_global_index_of_nothing(spark, skewed):
    assert global_index(skewed.filter("event_time > 1000"), [F.col("event_time")]).count() == 0


def test_running_sums_equal_window(spark, skewed, rows):
    counts = skewed.groupBy("event_time").agg(F.count("*").alias("n"), F.sum("item_id").alias("s"))
    down = Window.orderBy(F.col("event_time").desc())
    want = counts.withColumn("rn", F.sum("n").over(down)).withColumn("rs", F.sum("s").over(down))
    got = running_sums(counts, [F.col("event_time").desc()], {"n": "rn", "s": "rs"})
    assert rows(got, "event_time", "n", "s", "rn", "rs") == rows(want, "event_time", "n", "s", "rn", "rs")
