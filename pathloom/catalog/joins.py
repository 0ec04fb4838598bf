"""Joins: counts, ids, text, vectors, scoring, suppression, positives, popularity, graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.catalog.clean import RATED_SQL, rated
from pathloom.catalog.registry import query
from pathloom.catalog.tables import (
    HABIT, LOG_A, LOG_B, VECTORS, WINDOWS_A, habit_recs, hot, item_vectors, log_a, log_b, placed_a, table, train_popularity,
    unit_item_vectors, user_vectors, windows_a,
)
from pathloom.operators import clean, graph, ids, items, metrics, ranking, scoring, splits, vectors


@query("join_user_counts", "user_id:i item_id:i event_time:i user_count:i",
       f"WITH {LOG_B} SELECT *, count(*) OVER (PARTITION BY user_id) AS user_count FROM log_b")
def _(spark, sf):
    return clean.join_user_counts(log_b(spark, sf), frequent=hot(spark, sf, "b", "user_id"))


@query("attach_counts", "user_id:i item_id:i timestamp:i item_count:i user_count:i", f"WITH {RATED_SQL} SELECT * FROM rated")
def _(spark, sf):
    return rated(spark, sf)


PART_IDS = """names AS (SELECT DISTINCT p_name AS token FROM part WHERE p_name <> 'blue bolt'),
vocab AS (SELECT token, row_number() OVER (ORDER BY token) AS id FROM names)"""


def _name_vocabulary(spark, sf):
    return ids.dense_vocabulary(table(spark, sf, "part").filter(F.col("p_name") != "blue bolt"), "p_name")


@query("encode_ids", "p_partkey:i p_name:i",
       f"WITH {PART_IDS} SELECT p_partkey, id AS p_name FROM part LEFT JOIN vocab ON token = part.p_name")
def _(spark, sf):
    """One name is missing from the vocabulary: its id stays null."""
    return ids.encode_ids(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", _name_vocabulary(spark, sf))


@query("decode_ids", "p_partkey:i p_name:s",
       f"WITH {PART_IDS} SELECT p_partkey, token AS p_name FROM part LEFT JOIN vocab ON token = part.p_name")
def _(spark, sf):
    vocabulary = _name_vocabulary(spark, sf)
    coded = ids.encode_ids(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", vocabulary)
    return ids.decode_ids(coded, "p_name", vocabulary)


PROMPT = "Describe: "


def part_items(spark, sf):
    return table(spark, sf, "part").select((F.col("p_partkey") + 1).cast("int").alias("item_id"), "p_name", "p_brand", "p_size")


@query("attach_item_text", "user_id:i seq_no:i place:i text:s", f"""
WITH {WINDOWS_A}, spots AS (
  SELECT user_id, seq_no, unnest(item_seq) AS item_id, generate_subscripts(item_seq, 1) - 1 AS place FROM windows)
SELECT user_id, seq_no, place, coalesce('{PROMPT}p_name: ' || p_name || 'p_brand: ' || p_brand, '') AS text
FROM spots LEFT JOIN part ON p_partkey + 1 = item_id""")
def _(spark, sf):
    places = items.window_items(windows_a(spark, sf))
    return items.attach_item_text(places, part_items(spark, sf), ["p_name", "p_brand"], PROMPT, frequent=hot(spark, sf, "a", "item_id"))


@query("lookup_vectors", "user_id:i seq_no:i item_id:a total:d", f"""
WITH {WINDOWS_A}, spots AS (
  SELECT user_id, seq_no, unnest(item_seq) AS item_id, generate_subscripts(item_seq, 1) AS place FROM windows)
SELECT user_id, seq_no, list(item_id ORDER BY place) AS item_id,
       sum(place * list_sum(embedding::DOUBLE[])) AS total
FROM spots JOIN embeddings ON vec_id + 1 = item_id GROUP BY user_id, seq_no""")
def _(spark, sf):
    """The checksum weighs each vector by its place, so a wrong order shows."""
    found = vectors.lookup_vectors(windows_a(spark, sf), item_vectors(spark, sf), frequent=hot(spark, sf, "a", "item_id"))
    sums = F.transform("vector", lambda v, i: (i + 1) * F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")))
    return found.withColumn("total", F.aggregate(sums, F.lit(0.0), lambda a, x: a + x))


@query("full_sort_scores", "user_id:i item_id:i score:d", f"""
WITH {VECTORS} SELECT user_id, item_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS r FROM pairs) AS p WHERE r <= 10""")
def _(spark, sf):
    """Ten best of all items per user; small blocks, so several meet per user."""
    cells = scoring.full_sort_scores(user_vectors(spark, sf), unit_item_vectors(spark, sf), 10, block=128)
    return ranking.top_k_items(cells, 10)


@query("suppress_history", "user_id:i item_id:i score:d", f"""
WITH {HABIT}, old AS (SELECT DISTINCT user_id, item_id FROM placed WHERE event_type = 'view')
SELECT user_id, item_id, score FROM counted ANTI JOIN old USING (user_id, item_id)""")
def _(spark, sf):
    """Items met before, without those the user viewed."""
    placed = placed_a(spark, sf)
    candidates = placed.filter(F.col("pos") <= F.col("n") - 5).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("score"))
    viewed = log_a(spark, sf).filter(F.col("event_type") == "view")
    return ranking.suppress_history(candidates, viewed)


@query("mark_positives", "user_id:i item_id:i rank:i hit:i pos_len:i", f"WITH {HABIT} SELECT * FROM recs")
def _(spark, sf):
    return habit_recs(spark, sf)


@query("attach_popularity", "user_id:i item_id:i rank:i popularity:i", f"""
WITH {HABIT} SELECT r.user_id, r.item_id, r.rank, coalesce(p.n, 0) AS popularity FROM recs r
LEFT JOIN (SELECT item_id, count(*) AS n FROM placed WHERE pos > placed.n - 5 GROUP BY item_id) p USING (item_id)""")
def _(spark, sf):
    """Popularity among the users' last five events: items that none of these holds get the default."""
    late = placed_a(spark, sf).filter(F.col("pos") > F.col("n") - 5)
    return metrics.attach_popularity(habit_recs(spark, sf), late.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")))


@query("semi_tail_items", "user_id:i item_id:i rank:i is_tail:i", f"""
WITH {HABIT}, tail AS (
  SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY n, item_id) AS r, count(*) OVER () AS m FROM popularity)
  WHERE r <= greatest(floor(m * 0.2), 1))
SELECT r.user_id, r.item_id, r.rank, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS is_tail
FROM recs r LEFT JOIN tail t ON t.item_id = r.item_id""")
def _(spark, sf):
    return metrics.flag_tail_items(habit_recs(spark, sf), metrics.tail_items(train_popularity(spark, sf), 0.2))


EDGES_SQL = f"""{LOG_A}, users_n AS (SELECT max(user_id) AS n FROM log_a),
edges AS (
  SELECT user_id AS src, item_id + n AS dst FROM log_a CROSS JOIN users_n
  UNION ALL SELECT item_id + n, user_id FROM log_a CROSS JOIN users_n),
deg AS (SELECT src AS node, count(*) AS n FROM edges GROUP BY src)"""


def user_count(spark, sf):
    return log_a(spark, sf).agg(F.max("user_id")).first()[0]


def hot_nodes(spark, sf):
    """Frequent users and items as graph nodes."""
    shift = user_count(spark, sf)
    return hot(spark, sf, "a", "user_id") + [i + shift for i in hot(spark, sf, "a", "item_id") if i is not None]


def both_edges(spark, sf):
    return graph.bidirectional_edges(graph.interaction_edges(log_a(spark, sf), user_count(spark, sf)))


@query("attach_degrees", "src:i dst:i src_degree:i dst_degree:i", f"""
WITH {EDGES_SQL} SELECT src, dst, a.n AS src_degree, b.n AS dst_degree FROM edges
JOIN deg a ON a.node = src JOIN deg b ON b.node = dst""")
def _(spark, sf):
    edges = both_edges(spark, sf)
    return graph.attach_degrees(edges, graph.degree(edges), hot_nodes(spark, sf))


@query("restrict_users", "user_id:i item_id:i event_time:i", f"""
WITH {LOG_B}, u AS (SELECT DISTINCT user_id FROM log_b),
half AS (SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY (42 + user_id * 7919) % 1000003, user_id) AS r,
         count(*) OVER () AS m FROM u) WHERE r <= floor(m * 0.8))
SELECT log_b.* FROM log_b SEMI JOIN half USING (user_id)""")
def _(spark, sf):
    return splits.restrict_users(splits.split_users(log_b(spark, sf), draw="arithmetic"), 1)
