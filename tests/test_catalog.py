"""Every registered query gives the rows of its SQL."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from pathloom.catalog import load_catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load_catalog()  # the text queries have tests of their own


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def show(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return repr(v)

    return [columns[i] for i in order], sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert len(got[1]) > 0
    result = con.execute(SQL[name])
    assert got == table([d[0] for d in result.description], result.fetchall())


@pytest.fixture
def everything_is_frequent(spark):
    """Any key with more than 20 rows takes the balanced path."""
    from pathloom.catalog import tables

    tables.forget()
    spark.conf.set("spark.pathloom.frequentRows", "20")
    yield
    spark.conf.unset("spark.pathloom.frequentRows")
    tables.forget()


SKEW_SENSITIVE = [
    "build_history_arrays", "build_history_structs", "concat_sessions", "build_item_table", "attach_counts",
    "filter_core_once", "dense_ids", "encode_ids", "decode_ids", "first_seen_ids", "attach_item_text", "lookup_vectors",
    "attach_degrees", "event_positions", "average_rank", "full_ranking", "time_gap_bucket", "order_events", "eval_split",
    "chunk_sequences", "history_pairs", "training_examples", "contrastive_eval", "normalized_adjacency", "split_users",
    "top_k_items", "target_rank", "tail_percentage_at_k", "average_popularity_at_k", "group_apply", "news_tables",
]


@pytest.mark.parametrize("name", SKEW_SENSITIVE)
def test_query_with_frequent_keys(spark, con, name, everything_is_frequent):
    df = QUERIES[name](spark, SF)
    result = con.execute(SQL[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in result.description], result.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert driver.entry(spark).columns == ["user_id", "segment", "object_id", "event_time", "event_id"]
