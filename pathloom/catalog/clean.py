"""Projections, predicates, event codes and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.catalog.registry import query
from pathloom.catalog.tables import (
    LOG_A, LOG_B, MARKET, ORDER_A, PLACED_A, hot, hot_b, log_a, log_b, market, placed_a, table,
)
from pathloom.functions.arrays import real_item_mask
from pathloom.functions.text import usable_text
from pathloom.functions.times import decompose_time, epoch_seconds_rounded, epoch_seconds_truncated
from pathloom.operators import clean
from pathloom.operators.history import build_history_arrays
from pathloom.operators.sequences import eval_split

# Codes of the event log; 'error' has none, so its rows are rejected.
CODES = {"view": 0, "click": 1, "signup": 2, "purchase": 3}


@query("backfill_category", "p_partkey:i category_name:s", """
SELECT p_partkey, coalesce(nullif(p_name, 'blue bolt'), nullif(p_brand, 'Brand#2'), p_type) AS category_name FROM part""")
def _(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", F.col("p_type").alias("c0"), F.nullif("p_brand", F.lit("Brand#2")).alias("c1"),
        F.nullif("p_name", F.lit("blue bolt")).alias("c2"),
    )
    return part.select("p_partkey", clean.backfill_category(["c0", "c1", "c2"]).alias("category_name"))


@query("project_events", "user_id:i product_id:s category_name:s category_id:i stime:i", f"WITH {MARKET} SELECT * FROM market")
def _(spark, sf):
    return clean.project_events(market(spark, sf), ["user_id", "product_id"])


@query("pack_event_struct", "user_id:i name:s category_name:s brand_id:i item_id:i stime:i price:d shipper_name:s",
       f"WITH {MARKET} SELECT * FROM market")
def _(spark, sf):
    events = market(spark, sf)
    flat = clean.project_events(events, [c for c in events.columns if c not in ("stime", "category_name")])
    return flat.select("user_id", clean.pack_event_struct().alias("e")).select("user_id", "e.*")


@query("rename_columns", "user_id:i object_id:i event_time:i",
       f"WITH {LOG_A} SELECT user_id, item_id AS object_id, event_time FROM log_a")
def _(spark, sf):
    return clean.rename_columns(log_a(spark, sf), {"item_id": "object_id"}, drop=["ts", "value"])


@query("filter_min_events", "user_id:i item_id:i event_time:i", f"""
WITH {LOG_B}, c AS (SELECT user_id, count(*) AS n FROM log_b GROUP BY user_id)
SELECT log_b.* FROM log_b JOIN c USING (user_id) WHERE n >= 40""")
def _(spark, sf):
    return clean.filter_min_events(log_b(spark, sf), 40, frequent=hot(spark, sf, "b", "user_id"))


@query("filter_min_history", "user_id:i object_id:a", f"""
WITH {PLACED_A} SELECT user_id, list(item_id ORDER BY pos) AS object_id FROM placed GROUP BY user_id HAVING count(*) >= 70""")
def _(spark, sf):
    events = log_a(spark, sf).withColumnRenamed("item_id", "object_id")
    return clean.filter_min_history(build_history_arrays(events, ["object_id"], ORDER_A, frequent=hot(spark, sf, "a", "user_id")), "object_id", 70)


RATED_SQL = f"""{LOG_B}, rated AS (
  SELECT user_id, item_id, event_time AS timestamp, count(*) OVER (PARTITION BY item_id) AS item_count,
         count(*) OVER (PARTITION BY user_id) AS user_count FROM log_b)"""


def rated(spark, sf):
    events = log_b(spark, sf).select("user_id", "item_id", F.col("event_time").alias("timestamp"))
    return clean.attach_counts(events, {"item_id": "item_count", "user_id": "user_count"}, hot_b(spark, sf))


@query("filter_rating_counts", "user_id:i item_id:i item_count:i user_count:i",
       f"WITH {RATED_SQL} SELECT * FROM rated WHERE item_count >= 30 AND user_count >= 30")
def _(spark, sf):
    return clean.filter_rating_counts(rated(spark, sf), 30)


@query("select_interaction_columns", "item_id:i user_id:i timestamp:i",
       f"WITH {LOG_B} SELECT item_id, user_id, event_time AS timestamp FROM log_b")
def _(spark, sf):
    return clean.select_interaction_columns(clean.rename_columns(log_b(spark, sf), {"event_time": "timestamp"}))


@query("is_real_item", "user_id:i mask:a", f"""
WITH {PLACED_A} SELECT user_id, list_concat(list_resize([]::INTEGER[], greatest(80 - (n - 2), 0), 0),
  list_resize([]::INTEGER[], least(n - 2, 80), 1)) AS mask FROM placed WHERE pos = 1""")
def _(spark, sf):
    rows = eval_split(placed_a(spark, sf), 80)
    return rows.select("user_id", real_item_mask(F.col("item_seq")).alias("mask"))


@query("usable_text", "p_partkey:i name_ok:i size_ok:i", """
SELECT p_partkey, CASE WHEN p_name NOT IN ('blue bolt', 'red widget') THEN 1 ELSE 0 END AS name_ok,
       CASE WHEN p_size % 5 <> 0 AND p_size % 7 <> 0 THEN 1 ELSE 0 END AS size_ok FROM part""")
def _(spark, sf):
    """Some names become '', 'nan', some sizes 0 or null."""
    name = F.when(F.col("p_name") == "blue bolt", "").when(F.col("p_name") == "red widget", "nan").otherwise(F.col("p_name"))
    size = F.when(F.col("p_size") % 5 == 0, 0).when(F.col("p_size") % 7 != 0, F.col("p_size"))
    return table(spark, sf, "part").select(
        "p_partkey", usable_text(name).cast("int").alias("name_ok"), usable_text(size, True).cast("int").alias("size_ok")
    )


@query("filter_ids_in_vocabulary", "user_id:i item_id:i known:i", f"""
WITH {LOG_B} SELECT user_id, item_id, CASE WHEN item_id <= (SELECT max(vec_id) + 1 FROM embeddings) THEN 1 ELSE 0 END AS known
FROM log_b""")
def _(spark, sf):
    size = table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    kept, rejected = clean.split_by_vocabulary(log_b(spark, sf).select("user_id", "item_id"), "item_id", size)
    return kept.withColumn("known", F.lit(1)).unionByName(rejected.withColumn("known", F.lit(0)))


@query("map_event_code", "event_no:i code:i rejected:i", f"""
WITH {LOG_A} SELECT event_no, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2
  WHEN 'purchase' THEN 3 END AS code, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS rejected FROM log_a""")
def _(spark, sf):
    kept, rejected = clean.split_by_event_code(log_a(spark, sf), "event_type", CODES)
    shown = kept.select("event_no", F.col("event_type").alias("code"), F.lit(0).alias("rejected"))
    return shown.unionByName(rejected.select("event_no", F.lit(None).cast("int").alias("code"), F.lit(1).alias("rejected")))


@query("epoch_seconds_rounded", "event_id:i event_time:i",
       "SELECT event_id, CAST(epoch(ts) AS INTEGER) AS event_time FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", epoch_seconds_rounded(F.col("ts")).alias("event_time"))


@query("epoch_seconds_truncated", "event_id:i event_time:i",
       "SELECT event_id, CAST(trunc(epoch(ts)) AS BIGINT) AS event_time FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", epoch_seconds_truncated(F.col("ts")).alias("event_time"))


@query("decompose_time", "user_id:i place:i fields:a", f"""
WITH {PLACED_A}, spots AS (
  SELECT u.user_id, i AS place, p.event_time FROM (SELECT user_id, n FROM placed WHERE pos = 1) u
  CROSS JOIN range(0, 80) AS r(i) LEFT JOIN placed p ON p.user_id = u.user_id AND p.pos = u.n - 2 - 80 + i + 1),
timed AS (SELECT *, make_timestamp(CAST(coalesce(event_time, 0) AS BIGINT) * 1000000) AS t FROM spots)
SELECT user_id, place, [year(t), month(t), day(t), hour(t), minute(t), second(t)] AS fields FROM timed""")
def _(spark, sf):
    rows = eval_split(placed_a(spark, sf), 80)
    return rows.select("user_id", F.posexplode(decompose_time(F.col("time_seq"))).alias("place", "fields"))
