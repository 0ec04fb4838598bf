"""Scans and sinks: each query writes data derived from the tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.catalog.registry import query
from pathloom.catalog.tables import LOG_A, LOG_B, ORDER_A, PLACED_A, WINDOWS_A, hot, log_a, log_b, table, windows_a
from pathloom.operators.clean import news_articles, news_events, rename_columns
from pathloom.operators.history import build_history_arrays, build_item_table
from pathloom.operators.splits import split_rows
from pathloom.session import scratch_path
from pathloom.sources import readers, schemas, writers


def _histories(spark, sf):
    events = log_a(spark, sf).select(
        "user_id", F.col("item_id").alias("object_id"), "event_time", F.col("event_type").alias("event_id"), "event_no"
    )
    return build_history_arrays(events, ["object_id", "event_time", "event_id"], ORDER_A,
                                frequent=hot(spark, sf, "a", "user_id"))


def _saved(spark, df, ext="parquet", write=None):
    path = scratch_path(spark, "query") + f".{ext}"
    (write or writers.write_by_extension)(df, path)
    return path


HISTORY_SQL = f"""WITH {LOG_A} SELECT user_id, list(item_id ORDER BY event_time, event_no) AS item_id,
  list(event_time ORDER BY event_time, event_no) AS timestamp FROM log_a GROUP BY user_id"""


@query("read_histories", "user_id:i item_id:a timestamp:a", HISTORY_SQL)
def _(spark, sf):
    return readers.read_histories(spark, _saved(spark, _histories(spark, sf)))


@query("read_interactions_csv", "item_id:s user_id:s timestamp:i",
       f"WITH {LOG_A} SELECT item_id, user_id, event_time AS timestamp FROM log_a")
def _(spark, sf):
    rows = log_a(spark, sf).select(F.col("item_id").alias("iid"), F.col("user_id").alias("uid"), "event_time")
    return readers.read_interactions_csv(spark, _saved(spark, rows, "csv"))


@query("read_ratings_csv", "user_id:s item_id:s rating:d timestamp:i",
       f"WITH {LOG_B} SELECT user_id, item_id, quantity AS rating, event_time AS timestamp FROM log_b")
def _(spark, sf):
    rows = log_b(spark, sf).select("user_id", "item_id", "quantity", "event_time")
    path = _saved(spark, rows, "csv", lambda df, p: df.write.option("header", False).csv(p))
    return readers.read_ratings_csv(spark, path)


def _record_lines(spark, sf):
    """Parts as dict literals; one size is written with a missing quote, some titles are None."""
    part = table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    title = F.when(F.col("p_name") == "blue bolt", F.lit("None")).otherwise(
        F.concat(F.lit("'None of "), F.col("p_name"), F.lit("'"))
    )
    about = F.concat(F.lit(', \'description\': "It\'s '), F.col("p_brand"), F.lit('"'))
    line = F.concat(
        F.lit("{'asin': 'P"), key, F.when(F.col("p_size") == 7, F.lit("")).otherwise(F.lit("'")),
        F.lit(", 'title': "), title, F.when(F.col("p_size") % 2 == 0, about).otherwise(F.lit("")), F.lit(", 'rank': 1}"),
    )
    path = scratch_path(spark, "records")
    part.select(line.alias("value")).write.text(path)
    return path


@query("read_item_records", "item_id:s description:s title:s", """
SELECT 'P' || p_partkey AS item_id, CASE WHEN p_size % 2 = 0 THEN 'It''s ' || p_brand ELSE '' END AS description,
       CASE WHEN p_name = 'blue bolt' THEN '' ELSE 'None of ' || p_name END AS title
FROM part WHERE p_size <> 7""")
def _(spark, sf):
    return readers.read_item_records(spark, _record_lines(spark, sf))


@query("item_record_rejects", "asin:s", "SELECT 'P' || p_partkey AS asin FROM part WHERE p_size = 7")
def _(spark, sf):
    rejects = readers.read_item_record_rejects(spark, _record_lines(spark, sf))
    return rejects.select(F.regexp_extract("value", r"P\d+", 0).alias("asin"))


@query("read_event_table", "event_id:i user_id:i event_type:s value:d props:s",
       "SELECT event_id, user_id, event_type, value, props FROM events")
def _(spark, sf):
    return readers.read_event_table(spark, f"{sf}/events.parquet")


@query("read_item_info", "item_id:i p_name:s p_brand:s", "SELECT p_partkey + 1 AS item_id, p_name, p_brand FROM part")
def _(spark, sf):
    items = table(spark, sf, "part").withColumn("object_id", F.col("p_partkey") + 1)
    return readers.read_item_info(spark, _saved(spark, items), ["p_name", "p_brand"])


@query("read_table", "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s", "SELECT * FROM customer")
def _(spark, sf):
    return readers.read_table(spark, f"{sf}/customer.parquet")


@query("resolve_format", "o_orderkey:i format:s", "SELECT o_orderkey, 'csv' AS format FROM orders")
def _(spark, sf):
    base = scratch_path(spark, "resolve")
    writers.write_csv(table(spark, sf, "orders").select("o_orderkey"), f"{base}.csv")
    table(spark, sf, "region").write.parquet(f"{base}.parquet")
    ext, path = readers.resolve_format(spark, base)
    found = spark.read.schema("o_orderkey BIGINT").option("header", True).format(ext).load(path)
    return found.withColumn("format", F.lit(ext))


@query("write_by_extension", "user_id:i object_id:s event_time:s", f"""
SELECT user_id, '[' || array_to_string(item_id, ',') || ']' AS object_id,
       '[' || array_to_string(timestamp, ',') || ']' AS event_time FROM ({HISTORY_SQL})""")
def _(spark, sf):
    path = _saved(spark, _histories(spark, sf), "csv")
    return spark.read.option("header", True).option("escape", "\\").csv(path)


@query("write_parquet_plain", "o_orderkey:i o_custkey:i o_totalprice:d", "SELECT * FROM orders")
def _(spark, sf):
    return spark.read.parquet(_saved(spark, table(spark, sf, "orders"), "parquet", writers.write_parquet_plain))


@query("write_csv", "c_custkey:i c_name:s c_acctbal:d", "SELECT * FROM customer")
def _(spark, sf):
    path = _saved(spark, table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), "csv", writers.write_csv)
    return spark.read.schema("c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE").option("header", True).csv(path)


@query("convert_csv_to_parquet", "item_id:s user_id:s timestamp:i",
       f"WITH {LOG_A} SELECT item_id, user_id, event_time AS timestamp FROM log_a")
def _(spark, sf):
    rows = log_a(spark, sf).select("item_id", "user_id", F.col("event_time").alias("timestamp"))
    source = _saved(spark, rows, "csv")
    target = scratch_path(spark, "converted") + ".parquet"
    return spark.read.parquet(writers.convert_csv_to_parquet(spark, source, target, schemas.INTERACTIONS))


@query("dataset_layout", "object_id:i event_type:s value:d interactions:i", f"""
WITH {LOG_A} SELECT item_id AS object_id, arg_min(event_type, (event_time, event_no)) AS event_type,
       arg_min(value, (event_time, event_no)) AS value, (SELECT count(DISTINCT user_id) FROM log_a) AS interactions
FROM log_a GROUP BY item_id""")
def _(spark, sf):
    events = log_a(spark, sf).withColumnRenamed("item_id", "object_id")
    items = build_item_table(events, ["event_type", "value"], ORDER_A)
    layout = writers.dataset_layout(scratch_path(spark, "dataset"), "events", 1)
    paths = writers.write_dataset(_histories(spark, sf), items, layout)
    users = spark.read.parquet(paths["interaction"]).select("user_id").distinct().count()
    return spark.read.parquet(paths["information"]).withColumn("interactions", F.lit(users))


SPLIT_SQL = """
SELECT o_orderkey, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'valid'
       ELSE 'test' END AS split FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY (42 + o_orderkey * 7919) % 1000003, o_orderkey) AS r,
         count(*) OVER () AS n FROM orders)"""


@query("write_splits", "o_orderkey:i split:s", SPLIT_SQL)
def _(spark, sf):
    rows = split_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", draw="arithmetic")
    path = writers.write_splits(rows, scratch_path(spark, "splits"))
    parts = [readers.read_table(spark, f"{path}/split={s}").withColumn("split", F.lit(s)) for s in ("train", "valid", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("news_tables", "user_id:i object_id:a event_time:a", f"""
WITH {PLACED_A} SELECT user_id, list(item_id ORDER BY pos) AS object_id,
  list(CAST(trunc(epoch(ts)) AS BIGINT) ORDER BY pos) AS event_time FROM placed GROUP BY user_id""")
def _(spark, sf):
    """Nested news histories in, canonical histories out."""
    names = {"item_id": "article_id_fixed", "ts": "impression_time_fixed", "value": "scroll_percentage_fixed",
             "event_no": "read_time_fixed"}
    nested = build_history_arrays(rename_columns(log_a(spark, sf).drop("event_time", "event_type"), names),
                                  list(names.values()), ["impression_time_fixed", "read_time_fixed"], frequent=hot(spark, sf, "a", "user_id"))
    events = news_events(readers.read_table(spark, _saved(spark, nested)))
    histories = build_history_arrays(events, ["object_id", "event_time"], ["event_time", "pos"],
                                     frequent=hot(spark, sf, "a", "user_id"))
    return readers.read_table(spark, _saved(spark, histories))


@query("news_articles", "article_id:i published_time:i last_modified_time:i", f"""
WITH {LOG_A} SELECT item_id AS article_id, CAST(trunc(epoch(min(ts))) AS BIGINT) AS published_time,
  CAST(trunc(epoch(max(ts))) AS BIGINT) AS last_modified_time FROM log_a GROUP BY item_id""")
def _(spark, sf):
    """Articles first and last seen in log A, their times in epoch seconds."""
    times = [F.min("ts").alias("published_time"), F.max("ts").alias("last_modified_time")]
    articles = log_a(spark, sf).groupBy(F.col("item_id").alias("article_id")).agg(*times)
    return news_articles(readers.read_table(spark, _saved(spark, articles)))


@query("read_sessions_csv", "items:a", f"WITH {WINDOWS_A} SELECT item_seq AS items FROM windows")
def _(spark, sf):
    """Windows of log A written as session lists in text, and read again."""
    listed = F.concat(F.lit("['"), F.array_join(F.col("item_seq").cast("array<string>"), "' '"), F.lit("']"))
    path = _saved(spark, windows_a(spark, sf).select(listed.alias("prev_items")), "csv")
    return readers.read_sessions_csv(spark, path).select(readers.session_items(F.col("prev_items")).alias("items"))
