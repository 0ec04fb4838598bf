"""The input tables as interaction logs, in Spark and as SQL common table expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.times import epoch_seconds_rounded
from pathloom.functions.vectors import l2_normalize
from pathloom.operators.ranking import mark_positives, top_k_items
from pathloom.operators.sequences import (
    chunk_sequences, eval_history, eval_split, leave_last_k_train, place_events,
)
from pathloom.operators.skew import frequent_keys, lookup
from pathloom.operators.vectors import mean_user_vectors
from pathloom.session import save_shared

WINDOW = 20  # window length used by the sequence queries
ORDER_A = ["event_time", "event_no"]
ORDER_B = ["event_time", "o", "l", "p", "s"]


@cache
def _frequent(spark: SparkSession, sf: str, name: str, column: str) -> tuple:
    source = log_a(spark, sf) if name == "log_a" else table(spark, sf, name)
    return tuple(frequent_keys(source, column))


def hot(spark: SparkSession, sf: str, log: str, column: str) -> list:
    """Frequent users or items of a log, looked for once per data folder in the base table.

    Ids of log B are the base keys plus one; customers of log B are counted by
    order, sessions are orders.
    """
    name, key = {
        ("a", "user_id"): ("log_a", "user_id"),
        ("a", "item_id"): ("log_a", "item_id"),
        ("b", "user_id"): ("orders", "o_custkey"),
        ("b", "item_id"): ("lineitem", "l_partkey"),
        ("b", "sequence_id"): ("lineitem", "l_orderkey"),
    }[log, column]
    if column == key or column == "sequence_id":
        return list(_frequent(spark, sf, name, key))
    return [None if v is None else v + 1 for v in _frequent(spark, sf, name, key)]


def hot_b(spark: SparkSession, sf: str) -> dict[str, list]:
    return {c: hot(spark, sf, "b", c) for c in ("user_id", "item_id")}


def forget() -> None:
    """Drop remembered plans and frequent keys (not data; nothing is cached on executors)."""
    for function in (_frequent, table, log_a, log_b, market, placed_a, placed_b):
        function.cache_clear()


@cache
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@cache
def log_a(spark: SparkSession, sf: str) -> DataFrame:
    """Event log A: the events table."""
    return table(spark, sf, "events").select(
        (F.col("user_id") + 1).cast("int").alias("user_id"),
        (F.get_json_object("props", "$.k").cast("int") + 1).alias("item_id"),
        "ts",
        epoch_seconds_rounded(F.col("ts")).alias("event_time"),
        "event_type",
        "value",
        F.col("event_id").alias("event_no"),
    )


@cache
def log_b(spark: SparkSession, sf: str) -> DataFrame:
    """Event log B: order lines; user is the customer, item the part, session the order."""
    lines = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lookup(lines, orders, "l_orderkey", "inner", frequent=_frequent(spark, sf, "lineitem", "l_orderkey")).select(
        (F.col("o_custkey") + 1).cast("int").alias("user_id"),
        (F.col("l_partkey") + 1).cast("int").alias("item_id"),
        epoch_seconds_rounded(F.col("l_shipdate")).alias("event_time"),
        F.col("l_orderkey").alias("sequence_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("l_orderkey").alias("o"),
        F.col("l_linenumber").alias("l"),
        F.col("l_partkey").alias("p"),
        F.col("l_suppkey").alias("s"),
    )


@cache
def market(spark: SparkSession, sf: str) -> DataFrame:
    """Log B with the attributes of a marketplace event."""
    part = table(spark, sf, "part").select(
        (F.col("p_partkey") + 1).cast("int").alias("item_id"), "p_name", "p_brand", "p_type", "p_size"
    )
    return lookup(log_b(spark, sf), part, "item_id", frequent=hot(spark, sf, "b", "item_id")).select(
        "user_id",
        "sequence_id",
        F.timestamp_seconds("event_time").alias("stime"),
        F.col("flag").alias("event_id"),
        "item_id",
        F.concat(F.lit("p"), F.col("p").cast("string")).alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand_name"),
        F.col("p_size").cast("bigint").alias("brand_id"),
        "price",
        F.col("status").alias("item_condition_name"),
        F.col("p_type").alias("size_name"),
        F.col("flag").alias("color"),
        F.concat(F.lit("s"), F.col("s").cast("string")).alias("shipper_name"),
        F.col("p_type").alias("c0_name"),
        F.nullif("p_brand", F.lit("Brand#2")).alias("c1_name"),
        F.nullif("p_name", F.lit("blue bolt")).alias("c2_name"),
        F.lit(1).cast("bigint").alias("c0_id"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("bigint")).alias("c1_id"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("bigint") + 100).alias("c2_id"),
        "o", "l", "p", "s",
    )


@cache
def placed_a(spark: SparkSession, sf: str) -> DataFrame:
    return place_events(log_a(spark, sf), ORDER_A, frequent=hot(spark, sf, "a", "user_id"))


@cache
def placed_b(spark: SparkSession, sf: str) -> DataFrame:
    return place_events(log_b(spark, sf), ORDER_B, frequent=hot(spark, sf, "b", "user_id"))


def windows_a(spark: SparkSession, sf: str) -> DataFrame:
    """Training windows of log A: all but the last two events, cut into windows."""
    return chunk_sequences(leave_last_k_train(placed_a(spark, sf)), WINDOW)


def item_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select((F.col("vec_id") + 1).alias("item_id"), F.col("embedding").alias("vector"))


def unit_item_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return item_vectors(spark, sf).withColumn("vector", l2_normalize(F.col("vector")))


def user_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised mean vector of the ten events before the validation target."""
    windows = eval_split(placed_a(spark, sf), 10)
    pooled = mean_user_vectors(windows, item_vectors(spark, sf), frequent=hot(spark, sf, "a", "item_id"))
    return save_shared(pooled, "user-vectors")  # read several times by every evaluation


def seen_a(spark: SparkSession, sf: str) -> DataFrame:
    return eval_history(placed_a(spark, sf))


def targets_a(spark: SparkSession, sf: str) -> DataFrame:
    """Ground truth with several positives: the last two events of each user."""
    return placed_a(spark, sf).filter(F.col("pos") > F.col("n") - 2).select("user_id", "item_id")


def habit_recs(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    """Recommendations by habit: the items a user met most often before the last five events,
    marked with the items of those five events."""
    placed = placed_a(spark, sf)
    scored = (
        placed.filter(F.col("pos") <= F.col("n") - 5).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("score"))
    )
    targets = placed.filter(F.col("pos") > F.col("n") - 5).select("user_id", "item_id")
    return mark_positives(top_k_items(scored, k), targets)


def train_popularity(spark: SparkSession, sf: str) -> DataFrame:
    return placed_a(spark, sf).filter(F.col("pos") <= F.col("n") - 5).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, pred, label``: a score from the text length against the quality label."""
    docs = table(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 1000).alias("pred"))
    return docs.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


# ---- the same as SQL ------------------------------------------------------------------------

LOG_A = """log_a AS (
  SELECT CAST(user_id + 1 AS INTEGER) AS user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS item_id,
         ts, CAST(epoch(ts) AS INTEGER) AS event_time, event_type, value, event_id AS event_no
  FROM events)"""
LOG_B = """log_b AS (
  SELECT CAST(o_custkey + 1 AS INTEGER) AS user_id, CAST(l_partkey + 1 AS INTEGER) AS item_id,
         CAST(epoch(l_shipdate) AS INTEGER) AS event_time, l_orderkey AS sequence_id, l_quantity AS quantity,
         l_extendedprice AS price, l_returnflag AS flag, l_linestatus AS status,
         l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
MARKET = f"""{LOG_B}, market AS (
  SELECT b.user_id, b.sequence_id, b.event_time AS stime, b.flag AS event_id, b.item_id, 'p' || b.p AS product_id,
         p_name AS name, p_brand AS brand_name, p_size AS brand_id, b.price, b.status AS item_condition_name,
         p_type AS size_name, b.flag AS color, 's' || b.s AS shipper_name,
         coalesce(nullif(p_name, 'blue bolt'), nullif(p_brand, 'Brand#2'), p_type) AS category_name,
         coalesce(CASE WHEN p_size % 3 = 0 THEN p_size + 100 END, CASE WHEN p_size % 2 = 0 THEN p_size END, 1) AS category_id,
         b.o, b.l, b.p, b.s
  FROM log_b b LEFT JOIN part ON p_partkey = b.p)"""
PLACED_A = f"""{LOG_A}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_time, event_no) AS pos,
         count(*) OVER (PARTITION BY user_id) AS n FROM log_a)"""
PLACED_B = f"""{LOG_B}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_time, o, l, p, s) AS pos,
         count(*) OVER (PARTITION BY user_id) AS n FROM log_b)"""
WINDOWS_A = f"""{PLACED_A}, train AS (
  SELECT user_id, item_id, event_time, pos, n - 2 AS n FROM placed WHERE pos <= n - 2),
chunked AS (
  SELECT *, CASE WHEN n > {WINDOW} THEN (pos - 1 - n % {WINDOW}) // {WINDOW} ELSE 0 END AS seq_no FROM train
  WHERE pos > CASE WHEN n > {WINDOW} THEN n % {WINDOW} ELSE 0 END),
windows AS (
  SELECT user_id, seq_no, list(item_id ORDER BY pos) AS item_seq, list(event_time ORDER BY pos) AS time_seq,
         count(*) AS len FROM chunked GROUP BY user_id, seq_no)"""
VECTORS = f"""{PLACED_A}, near AS (
  SELECT user_id, item_id FROM placed WHERE pos <= n - 2 AND pos > n - 12),
dims AS (
  SELECT user_id, d, avg(x) AS x FROM (
    SELECT user_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d
    FROM near JOIN embeddings ON vec_id + 1 = item_id) GROUP BY user_id, d),
raw_users AS (SELECT user_id, list(x ORDER BY d) AS v FROM dims GROUP BY user_id),
users AS (SELECT user_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM raw_users),
items AS (
  SELECT item_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM (
    SELECT vec_id + 1 AS item_id, embedding::DOUBLE[] AS v FROM embeddings)),
seen AS (SELECT DISTINCT user_id, item_id FROM placed WHERE pos <= n - 2),
targets AS (SELECT DISTINCT user_id, item_id FROM placed WHERE pos > n - 2),
pairs AS (
  SELECT user_id, item_id, round(list_inner_product(u, v), 9) AS score FROM users CROSS JOIN items),
candidates AS (SELECT * FROM pairs ANTI JOIN seen USING (user_id, item_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank,
         rank() OVER (PARTITION BY user_id ORDER BY score DESC)
           + (count(*) OVER (PARTITION BY user_id, score) - 1) / 2.0 AS avg_rank FROM candidates)"""
HABIT = f"""{PLACED_A}, counted AS (
  SELECT user_id, item_id, count(*) AS score FROM placed WHERE pos <= n - 5 GROUP BY user_id, item_id),
topped AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM counted
  QUALIFY rank <= 20),
truth AS (SELECT DISTINCT user_id, item_id FROM placed WHERE pos > n - 5),
truth_len AS (SELECT user_id, count(*) AS pos_len FROM truth GROUP BY user_id),
recs AS (
  SELECT t.user_id, t.item_id, t.score, t.rank, CASE WHEN h.user_id IS NULL THEN 0 ELSE 1 END AS hit,
         coalesce(pos_len, 0) AS pos_len
  FROM topped t LEFT JOIN truth h ON h.user_id = t.user_id AND h.item_id = t.item_id
  LEFT JOIN truth_len tl ON tl.user_id = t.user_id),
popularity AS (SELECT item_id, count(*) AS n FROM placed WHERE pos <= n - 5 GROUP BY item_id)"""
SCORED = """scored AS (
  SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS pred, quality AS label FROM documents JOIN labels USING (doc_id))"""
