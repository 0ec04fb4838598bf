"""Readers and writers."""

import pytest
from pyspark.sql import functions as F

from pathloom.operators import clean
from pathloom.sources import readers, schemas, writers


@pytest.fixture
def out(tmp_path):
    return lambda name: str(tmp_path / name)


LINES = [
    "{'asin': 'a', 'title': \"It's\"}",
    "{'asin': 'b', 'title': None, 'x': {'y': [None, True]}, 'description': 'None, True, \\'quoted\\' None'}",
    "{}",
    "{'asin': 'c', broken",
    "{'asin': 'd', 'title': 'Nonesuch', 'NoneKey': None, 'tail': False}",
]


def test_item_records(spark, out, rows):
    spark.createDataFrame([(x,) for x in LINES], "value string").coalesce(1).write.text(out("lines"))
    got = rows(readers.read_item_records(spark, out("lines")))
    assert got == [("", "", ""), ("a", "", "It's"), ("b", "None, True, 'quoted' None", ""), ("d", "", "Nonesuch")]
    assert rows(readers.read_item_record_rejects(spark, out("lines"))) == [(LINES[3],)]


def test_long_record(spark, out):
    text = "it says None " * 20_000
    spark.createDataFrame([(f"{{'asin': 'a', 'title': None, 'description': '{text}'}}",)], "value string").write.text(out("long"))
    assert readers.read_item_records(spark, out("long")).first()["description"] == text


def test_csv_sources(spark, out, rows):
    spark.createDataFrame([("u1", "i1", 4.5, 10)], "a string, b string, c double, d long").write.csv(out("ratings"))
    assert rows(readers.read_ratings_csv(spark, out("ratings"))) == [("u1", "i1", 4.5, 10)]
    writers.write_csv(spark.createDataFrame([("007", "u", 3)], "iid string, uid string, t long"), out("log.csv"))
    got = readers.read_interactions_csv(spark, out("log.csv"))
    assert rows(got) == [("007", "u", 3)] and got.columns == ["item_id", "user_id", "timestamp"]
    spark.createDataFrame([("['a' 'b']",), ("[1, 2]",)], "prev_items string").write.option("header", True).csv(out("s.csv"))
    sessions = readers.read_sessions_csv(spark, out("s.csv"))
    assert rows(sessions.select(readers.session_items(F.col("prev_items")))) == [(["1", "2"],), (["a", "b"],)]


def test_write_by_extension(spark, out, rows):
    df = spark.createDataFrame([(1, [2, 3])], "user_id int, object_id array<int>")
    writers.write_by_extension(df, out("h.parquet"))
    assert rows(spark.read.parquet(out("h.parquet"))) == [(1, [2, 3])]
    writers.write_by_extension(df, out("h.csv"))
    assert rows(spark.read.option("header", True).csv(out("h.csv"))) == [("1", "[2,3]")]
    with pytest.raises(ValueError):
        writers.write_by_extension(df, out("h.json"))


def test_resolve_format_prefers_csv(spark, out):
    with pytest.raises(ValueError):
        readers.resolve_format(spark, out("x"))
    spark.range(3).write.parquet(out("x.parquet"))
    assert readers.resolve_format(spark, out("x")) == ("parquet", out("x.parquet"))
    writers.write_csv(spark.range(3), out("x.csv"))
    assert readers.resolve_format(spark, out("x")) == ("csv", out("x.csv"))


def test_layout_and_item_info(spark, out):
    layout = writers.dataset_layout(out("root"), "books", 5)
    assert layout["interaction"].endswith("root/interaction/books_5.parquet")
    assert layout["information"].endswith("root/information/books_5.parquet")
    with pytest.raises(ValueError):
        writers.dataset_layout(out("root"), "books", 5, "orc")
    with pytest.raises(ValueError):
        readers.read_item_info(spark, "items.csv", ["title"])


def test_uncompressed_and_converted(spark, out, tmp_path):
    writers.write_parquet_plain(spark.range(10), out("p.parquet"))
    assert not list((tmp_path / "p.parquet").glob("*.snappy.parquet"))
    writers.write_csv(spark.createDataFrame([("i", "u", 1)], schemas.INTERACTIONS), out("c.csv"))
    writers.convert_csv_to_parquet(spark, out("c.csv"), out("c.parquet"), schemas.INTERACTIONS)
    assert spark.read.parquet(out("c.parquet")).first() == ("i", "u", 1)


def test_splits_and_shards_are_folders(spark, out):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 8, "train").otherwise("test"))
    writers.write_splits(df, out("splits"))
    assert readers.read_split(spark, out("splits"), "train").count() == 8
    assert spark.read.parquet(out("splits") + "/split=test").count() == 2
    writers.write_shards(spark.range(4).withColumn("shard", F.col("id") % 2), out("shards"))
    assert spark.read.parquet(out("shards") + "/shard=1").count() == 2


def test_articles(spark, rows):
    df = spark.sql("select 1 as article_id, timestamp'2024-01-01 00:00:00.9' as last_modified_time, timestamp'2024-01-01' as published_time")
    assert rows(clean.news_articles(df)) == [(1, 1704067200, 1704067200)]


def test_scan_reads_only_the_needed_columns(spark):
    plan = readers.read_table(spark, "/root/testdata/sf0.001/lineitem.parquet").filter("l_quantity > 49").select("l_orderkey")
    text = plan._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
