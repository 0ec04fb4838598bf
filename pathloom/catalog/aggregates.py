"""Counts, histories, item tables and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.catalog.clean import RATED_SQL
from pathloom.catalog.joins import EDGES_SQL, both_edges
from pathloom.catalog.registry import query
from pathloom.catalog.tables import (
    LOG_A, LOG_B, MARKET, ORDER_A, ORDER_B, WINDOW, WINDOWS_A, hot, hot_b, item_vectors, log_a, log_b, market, windows_a,
)
from pathloom.operators import clean, graph, history, profile, vectors
from pathloom.operators.skew import lookup
from pathloom.functions.arrays import left_pad, real_item_mask
from pathloom.functions.text import composite_key
from pathloom.plans.dataset import build_dataset

SESSION_COLUMNS = ["item_id", "price", "event_id"]
HISTORY_COLUMNS = ["object_id", "event_time", "event_id"]


@query("count_by_key", "item_id:i n:i", f"WITH {LOG_B} SELECT item_id, count(*) AS n FROM log_b GROUP BY item_id")
def _(spark, sf):
    return clean.count_by_key(log_b(spark, sf), "item_id")


@query("build_history_structs", "user_id:i segment:i names:a times:a spent:d", f"""
WITH {MARKET} SELECT user_id, 0 AS segment, list(name ORDER BY stime, o, l, p, s) AS names,
  list(stime ORDER BY stime, o, l, p, s) AS times, sum(price) AS spent FROM market GROUP BY user_id""")
def _(spark, sf):
    raw = market(spark, sf)
    flat = clean.project_events(raw, [c for c in raw.columns if c not in ("stime", "category_name")])
    built = history.build_history_structs(flat, clean.pack_event_struct(), ["stime", "o", "l", "p", "s"],
                                           frequent=hot(spark, sf, "b", "user_id"))
    return built.select(
        "user_id", "segment", F.col("uih.name").alias("names"), F.col("uih.stime").alias("times"),
        F.aggregate("uih.price", F.lit(0.0), lambda a, x: a + x).alias("spent"),
    )


@query("build_history_arrays", "user_id:i segment:i object_id:a event_time:a event_id:a", f"""
WITH {LOG_A}, kept AS (
  SELECT * FROM log_a WHERE user_id IN (SELECT user_id FROM log_a GROUP BY user_id HAVING count(*) >= 60)),
coded AS (
  SELECT dense_rank() OVER (ORDER BY user_id) AS user_id, dense_rank() OVER (ORDER BY item_id) AS object_id,
         event_time, event_no, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2
         WHEN 'purchase' THEN 3 ELSE 4 END AS event_id FROM kept)
SELECT user_id, 0 AS segment, list(object_id ORDER BY event_time, event_no) AS object_id,
       list(event_time ORDER BY event_time, event_no) AS event_time,
       list(event_id ORDER BY event_time, event_no) AS event_id FROM coded GROUP BY user_id""")
def _(spark, sf):
    """The whole preparation: events -> users with 60 events or more -> dense ids -> histories."""
    codes = {"view": 0, "click": 1, "signup": 2, "purchase": 3, "error": 4}
    histories, _ = build_dataset(
        log_a(spark, sf), ["event_type"], time="ts", event="event_type", item="item_id", categories=None,
        event_codes=codes, min_events=60, tie=["event_no"],
    )
    return histories


def sessions(spark, sf):
    events = market(spark, sf).withColumn("seq_user_id", composite_key(F.col("user_id"), F.col("sequence_id")))
    # A session is one order: it can only be frequent if its order is.
    frequent = None if hot(spark, sf, "b", "sequence_id") else []
    return history.build_session_arrays(events, SESSION_COLUMNS, ["stime", "o", "l", "p", "s"], frequent=frequent)


@query("build_session_arrays", "seq_user_id:s user_id:i sequence_id:i item_id:a event_id:a total:d", f"""
WITH {MARKET} SELECT user_id || '_' || sequence_id AS seq_user_id, user_id, sequence_id,
  list(item_id ORDER BY stime, o, l, p, s) AS item_id, list(event_id ORDER BY stime, o, l, p, s) AS event_id,
  sum(price) AS total FROM market GROUP BY user_id, sequence_id""")
def _(spark, sf):
    return sessions(spark, sf).withColumn("total", F.aggregate("price", F.lit(0.0), lambda a, x: a + x))


@query("concat_sessions", "user_id:i segment:i item_id:a event_id:a", f"""
WITH {MARKET} SELECT user_id, 0 AS segment, list(item_id ORDER BY sequence_id, stime, o, l, p, s) AS item_id,
  list(event_id ORDER BY sequence_id, stime, o, l, p, s) AS event_id FROM market GROUP BY user_id""")
def _(spark, sf):
    return history.concat_sessions(sessions(spark, sf), SESSION_COLUMNS, frequent=hot(spark, sf, "b", "user_id"))


@query("build_item_table", "object_id:i event_type:s value:d", f"""
WITH {LOG_A}, kept AS (
  SELECT * FROM log_a WHERE user_id IN (SELECT user_id FROM log_a GROUP BY user_id HAVING count(*) >= 60)),
coded AS (
  SELECT dense_rank() OVER (ORDER BY user_id) AS uid, dense_rank() OVER (ORDER BY item_id) AS object_id, * FROM kept)
SELECT object_id, arg_min(event_type, (event_time, uid, event_no)) AS event_type,
       arg_min(value, (event_time, uid, event_no)) AS value FROM coded GROUP BY object_id""")
def _(spark, sf):
    _, items = build_dataset(
        log_a(spark, sf), ["event_type", "value"], time="ts", event="event_type", item="item_id", categories=None,
        min_events=60, tie=["event_no"],
    )
    return items


@query("count_distinct_entities", "stage:s rows:i n_user_id:i n_item_id:i", f"""
WITH {RATED_SQL}, step AS (SELECT * FROM rated WHERE item_count >= 30 AND user_count >= 30),
core AS (SELECT * FROM step WHERE user_id IN (SELECT user_id FROM step GROUP BY user_id HAVING count(*) >= 30))
SELECT 'before' AS stage, count(*) AS rows, count(DISTINCT user_id) AS n_user_id, count(DISTINCT item_id) AS n_item_id FROM log_b
UNION ALL SELECT 'after', count(*), count(DISTINCT user_id), count(DISTINCT item_id) FROM core""")
def _(spark, sf):
    events = log_b(spark, sf).select("user_id", "item_id")
    before = profile.count_distinct_entities(events, ["user_id", "item_id"]).withColumn("stage", F.lit("before"))
    after = profile.count_distinct_entities(clean.filter_core_once(events, 30, hot_b(spark, sf)), ["user_id", "item_id"])
    return before.unionByName(after.withColumn("stage", F.lit("after")))


def _b_histories(spark, sf):
    return history.build_history_arrays(log_b(spark, sf), ["item_id", "event_time"], ORDER_B, frequent=hot(spark, sf, "b", "user_id"))


@query("max_item_id", "max_item_id:i", f"WITH {LOG_B} SELECT max(item_id) AS max_item_id FROM log_b")
def _(spark, sf):
    return profile.max_item_id(_b_histories(spark, sf))


@query("total_interactions", "total_interactions:i", f"WITH {LOG_B} SELECT count(*) AS total_interactions FROM log_b")
def _(spark, sf):
    return profile.total_interactions(_b_histories(spark, sf))


@query("interaction_counters", "entity:s id:i n:i", f"""
WITH {LOG_B} SELECT 'user' AS entity, user_id AS id, count(*) AS n FROM log_b GROUP BY user_id
UNION ALL SELECT 'item', item_id, count(*) FROM log_b GROUP BY item_id""")
def _(spark, sf):
    histories = _b_histories(spark, sf)
    users = profile.user_counter(histories).select(F.lit("user").alias("entity"), F.col("user_id").alias("id"), "n")
    items = profile.item_counter(histories).select(F.lit("item").alias("entity"), F.col("item_id").alias("id"), "n")
    return users.unionByName(items)


@query("dataset_profile", "user_num:i item_num:i inter_num:i avg_actions_of_users:d avg_actions_of_items:d sparsity:d", f"""
WITH {LOG_B}, c AS (SELECT count(DISTINCT user_id) AS user_num, count(DISTINCT item_id) AS item_num, count(*) AS inter_num FROM log_b)
SELECT *, inter_num / user_num AS avg_actions_of_users, inter_num / item_num AS avg_actions_of_items,
       1 - inter_num / user_num / item_num AS sparsity FROM c""")
def _(spark, sf):
    return profile.dataset_profile(log_b(spark, sf))


@query("filter_core_once", "user_id:i item_id:i timestamp:i", f"""
WITH {RATED_SQL}, step AS (SELECT * FROM rated WHERE item_count >= 30 AND user_count >= 30)
SELECT user_id, item_id, timestamp FROM step
WHERE user_id IN (SELECT user_id FROM step GROUP BY user_id HAVING count(*) >= 30)""")
def _(spark, sf):
    events = log_b(spark, sf).select("user_id", "item_id", F.col("event_time").alias("timestamp"))
    return clean.select_interaction_columns(clean.filter_core_once(events, 30, hot_b(spark, sf)))


@query("history_length_by_user", "user_id:i history_len:i",
       f"WITH {LOG_B} SELECT user_id, count(*) AS history_len FROM log_b GROUP BY user_id")
def _(spark, sf):
    return profile.history_length_by_user(sessions(spark, sf), "item_id")


@query("length_survival_histogram", "edge:i users:i", f"""
WITH {LOG_B}, len AS (SELECT user_id, count(*) AS h FROM log_b GROUP BY user_id)
SELECT 1 << i AS edge, count(CASE WHEN h BETWEEN 1 << i AND 4096 THEN 1 END) AS users FROM len CROSS JOIN range(0, 12) AS r(i)
GROUP BY i""")
def _(spark, sf):
    return profile.length_survival_histogram(profile.history_length_by_user(_b_histories(spark, sf), "item_id"))


@query("degree", "node:i n:i", f"WITH {EDGES_SQL} SELECT * FROM deg")
def _(spark, sf):
    return graph.degree(both_edges(spark, sf))


@query("mean_pool", "user_id:i seq_no:i dim:i value:d", f"""
WITH {WINDOWS_A}, spots AS (SELECT user_id, seq_no, unnest(item_seq) AS item_id FROM windows),
x AS (SELECT user_id, seq_no, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim
      FROM spots JOIN embeddings ON vec_id + 1 = item_id)
SELECT user_id, seq_no, dim, avg(v) AS value FROM x GROUP BY user_id, seq_no, dim""")
def _(spark, sf):
    spots = windows_a(spark, sf).select("user_id", "seq_no", F.explode("item_seq").alias("item_id"))
    found = lookup(spots, item_vectors(spark, sf), "item_id", "inner", frequent=hot(spark, sf, "a", "item_id"))
    pooled = vectors.mean_pool(found, ["user_id", "seq_no"])
    return pooled.select("user_id", "seq_no", F.posexplode("vector").alias("dim", "value"))


@query("masked_mean", "user_id:i seq_no:i value:d", f"""
WITH {WINDOWS_A} SELECT user_id, seq_no, list_avg(time_seq) AS value FROM windows""")
def _(spark, sf):
    """Mean event time over the real places of padded windows."""
    padded = windows_a(spark, sf).select(
        "user_id", "seq_no", left_pad(F.col("time_seq"), WINDOW + 4).alias("t"),
        real_item_mask(left_pad(F.col("item_seq"), WINDOW + 4)).alias("m"),
    )
    flat = padded.select("user_id", "seq_no", F.inline(F.arrays_zip("t", "m")))
    return flat.groupBy("user_id", "seq_no").agg(vectors.masked_mean(F.col("t"), F.col("m")).alias("value"))
