"""Ids, ranks, orders, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.catalog.joins import EDGES_SQL, both_edges
from pathloom.catalog.registry import query
from pathloom.catalog.sources import SPLIT_SQL
from pathloom.catalog.tables import (
    HABIT, LOG_A, LOG_B, MARKET, ORDER_A, ORDER_B, PLACED_B, SCORED, VECTORS, WINDOWS_A, habit_recs, hot, log_a, log_b, market,
    placed_b, scored_documents, seen_a, table, targets_a, unit_item_vectors, user_vectors, windows_a,
)
from pathloom.functions.arrays import position_slice
from pathloom.functions.text import composite_key
from pathloom.functions.times import time_gap_bucket
from pathloom.operators import clean, history, ids, metrics, profile, ranking, scoring, splits
from pathloom.operators.skew import positions
from pathloom.plans.evaluation import recommend


@query("dense_ids", "user_id:i p_name:s name_id:i brand_id:i", """
SELECT p_partkey AS user_id, p_name, CASE WHEN p_name <> 'blue bolt'
  THEN dense_rank() OVER (ORDER BY nullif(p_name, 'blue bolt') NULLS LAST) END AS name_id,
  dense_rank() OVER (ORDER BY p_brand) AS brand_id FROM part""")
def _(spark, sf):
    """Null names stay null."""
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("user_id"), "p_name", F.nullif("p_name", F.lit("blue bolt")).alias("name_id"),
        F.col("p_brand").alias("brand_id"),
    )
    return ids.dense_ids(ids.dense_ids(part, "name_id"), "brand_id")


@query("first_seen_ids", "event_no:i user_id:i item_id:i", f"""
WITH {LOG_A}, u AS (SELECT user_id AS t, row_number() OVER (ORDER BY min(event_no)) AS uid FROM log_a GROUP BY user_id),
i AS (SELECT item_id AS t, row_number() OVER (ORDER BY min(event_no)) AS iid FROM log_a GROUP BY item_id)
SELECT event_no, uid AS user_id, iid AS item_id FROM log_a JOIN u ON u.t = user_id JOIN i ON i.t = item_id""")
def _(spark, sf):
    events = log_a(spark, sf).select("event_no", "user_id", "item_id")
    return ids.first_seen_ids(ids.first_seen_ids(events, "user_id", [F.col("event_no")]), "item_id", [F.col("event_no")])


@query("sorted_ids", "p_partkey:i p_name:i", """
SELECT p_partkey, CASE WHEN p_name = 'blue bolt' THEN 0 ELSE dense_rank() OVER (
  ORDER BY nullif(p_name, 'blue bolt') NULLS LAST) END AS p_name FROM part""")
def _(spark, sf):
    """Null names become 0."""
    part = table(spark, sf, "part").select("p_partkey", F.nullif("p_name", F.lit("blue bolt")).alias("p_name"))
    return ids.sorted_ids(part, "p_name")


@query("event_positions", "user_id:i item_id:i pos:i n:i", f"WITH {PLACED_B} SELECT * FROM placed")
def _(spark, sf):
    return placed_b(spark, sf)


CANDIDATES = f"""{LOG_B}, cand AS (
  SELECT user_id, item_id, sum(quantity) AS score FROM log_b GROUP BY user_id, item_id)"""


def candidates_b(spark, sf):
    """Every (customer, part) with the quantity bought as score: many ties."""
    return log_b(spark, sf).groupBy("user_id", "item_id").agg(F.sum("quantity").alias("score"))


@query("average_rank", "user_id:i item_id:i score:d avg_rank:d", f"""
WITH {CANDIDATES} SELECT *, rank() OVER (PARTITION BY user_id ORDER BY score DESC)
  + (count(*) OVER (PARTITION BY user_id, score) - 1) / 2.0 AS avg_rank FROM cand""")
def _(spark, sf):
    return ranking.average_rank(candidates_b(spark, sf), frequent=hot(spark, sf, "b", "user_id"))


@query("running_hits", "user_id:i rank:i hit:i hits_so_far:i", f"""
WITH {HABIT} SELECT user_id, rank, hit, sum(hit) OVER (PARTITION BY user_id ORDER BY rank) AS hits_so_far FROM recs""")
def _(spark, sf):
    return ranking.running_hits(habit_recs(spark, sf))


@query("roc_points", "pred:d pos:i neg:i tps:i fps:i", f"""
WITH {SCORED}, c AS (SELECT pred, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY pred)
SELECT pred, pos, neg, sum(pos) OVER (ORDER BY pred DESC) AS tps, sum(neg) OVER (ORDER BY pred DESC) AS fps FROM c""")
def _(spark, sf):
    return metrics.roc_points(scored_documents(spark, sf))


@query("time_gap_bucket", "event_no:i gap:i bucket:i", f"""
WITH {LOG_A}, g AS (SELECT event_no, coalesce(lead(event_time) OVER (PARTITION BY user_id ORDER BY event_time, event_no)
  - event_time, 0) AS gap FROM log_a)
SELECT event_no, gap, least(128, floor(ln(greatest(1, abs(gap))) / 0.301)) AS bucket FROM g""")
def _(spark, sf):
    gaps = history.gap_to_next(log_a(spark, sf), "event_time", ORDER_A, frequent=hot(spark, sf, "a", "user_id"))
    return gaps.withColumn("bucket", time_gap_bucket(F.col("gap")))


@query("order_events", "user_id:i pos:i item_id:i event_time:i",
       f"WITH {PLACED_B} SELECT user_id, pos, item_id, event_time FROM placed")
def _(spark, sf):
    return clean.order_events(log_b(spark, sf), ORDER_B, frequent=hot(spark, sf, "b", "user_id"))


@query("order_sessions", "seq_user_id:s pos:i item_id:i", f"""
WITH {MARKET} SELECT user_id || '_' || sequence_id AS seq_user_id, item_id,
  row_number() OVER (PARTITION BY user_id, sequence_id ORDER BY stime, o, l, p, s) AS pos FROM market""")
def _(spark, sf):
    events = market(spark, sf).withColumn("seq_user_id", composite_key(F.col("user_id"), F.col("sequence_id")))
    frequent = None if hot(spark, sf, "b", "sequence_id") else []
    return positions(events, ["seq_user_id"], [F.col(c) for c in ("stime", "o", "l", "p", "s")], frequent=frequent)


@query("sort_multi", "c_custkey:i c_mktsegment:s c_acctbal:d",
       "SELECT * FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def _(spark, sf):
    return ranking.sort_multi(table(spark, sf, "customer"), ("c_mktsegment", "asc"), ("c_acctbal", "desc"), tie=["c_custkey"])


@query("top_k_items", "user_id:i item_id:i score:d rank:i",
       f"WITH {VECTORS} SELECT user_id, item_id, score, rank FROM ranked WHERE rank <= 20")
def _(spark, sf):
    """Twenty best unseen items per user."""
    return recommend(user_vectors(spark, sf), unit_item_vectors(spark, sf), 20, seen_a(spark, sf), block=256)


@query("full_ranking", "user_id:i item_id:i score:d rank:i", f"""
WITH {CANDIDATES} SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM cand""")
def _(spark, sf):
    return ranking.full_ranking(candidates_b(spark, sf), frequent=hot(spark, sf, "b", "user_id"))


@query("target_rank", "user_id:i item_id:i rank:i avg_rank:d candidates:i", f"""
WITH {VECTORS}, free AS (SELECT user_id, count(*) AS candidates FROM candidates GROUP BY user_id)
SELECT t.user_id, t.item_id, coalesce(r.rank, f.candidates + 1) AS rank, coalesce(r.avg_rank, f.candidates + 1) AS avg_rank,
       f.candidates FROM targets t JOIN free f USING (user_id)
LEFT JOIN ranked r ON r.user_id = t.user_id AND r.item_id = t.item_id""")
def _(spark, sf):
    """A target that is itself in the history ranks behind every candidate."""
    return scoring.target_rank(
        user_vectors(spark, sf), unit_item_vectors(spark, sf), targets_a(spark, sf), seen_a(spark, sf), block=256
    )


@query("keep_last_n", "user_id:i item_id:i event_time:i", f"WITH {PLACED_B} SELECT * FROM placed WHERE pos > n - 5")
def _(spark, sf):
    return history.keep_last_n(log_b(spark, sf), 5, ORDER_B)


@query("position_slice", "user_id:i seq_no:i near_end:a whole:a far_left:a", f"""
WITH {WINDOWS_A} SELECT user_id, seq_no, list_slice(item_seq, greatest(len - 7, 0) + 1, len - 2) AS near_end,
  item_seq AS whole, list_slice(item_seq, greatest(len - 30, 0) + 1, len - 3) AS far_left FROM windows""")
def _(spark, sf):
    """[-7:-2], [0:None] and [-30:-3] of each window."""
    items = F.col("item_seq")
    return windows_a(spark, sf).select(
        "user_id", "seq_no", position_slice(items, -7, -2).alias("near_end"), position_slice(items).alias("whole"),
        position_slice(items, -30, -3).alias("far_left"),
    )


@query("bidirectional_edges", "src:i dst:i", f"WITH {EDGES_SQL} SELECT src, dst FROM edges")
def _(spark, sf):
    return both_edges(spark, sf)


@query("union_results", "users:i hits:d recall:d", f"""
WITH {HABIT}, u AS (SELECT user_id, max(CASE WHEN rank <= 10 THEN hit ELSE 0 END) AS h,
  sum(CASE WHEN rank <= 10 THEN hit ELSE 0 END) / max(pos_len) AS r FROM recs GROUP BY user_id)
SELECT count(*) AS users, avg(h) AS hits, avg(r) AS recall FROM u""")
def _(spark, sf):
    """Per-shard sums, united and divided by the number of evaluated users."""
    within = F.when(F.col("rank") <= 10, F.col("hit")).otherwise(0)
    users = habit_recs(spark, sf).groupBy("user_id").agg(
        F.max(within).alias("h"), (F.sum(within) / F.max("pos_len")).alias("r")
    )
    sharded = splits.shard_strided(users, 4, index="user_id")
    partial = sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("c"), F.sum("h").alias("h"), F.sum("r").alias("r"))
    return partial.agg(
        F.sum("c").alias("users"), (F.sum("h") / F.sum("c")).alias("hits"), (F.sum("r") / F.sum("c")).alias("recall")
    )


@query("distinct_users", "user_id:i", f"WITH {LOG_B} SELECT DISTINCT user_id FROM log_b")
def _(spark, sf):
    return profile.distinct_users(log_b(spark, sf))


@query("complement_split", "o_orderkey:i", f"SELECT o_orderkey FROM ({SPLIT_SQL}) WHERE split = 'test'")
def _(spark, sf):
    rows = splits.split_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", draw="arithmetic")
    return splits.complement_split(rows)
