"""The physical plans hold what the design promises."""

from pyspark.sql import functions as F

from pathloom.catalog import tables
from pathloom.operators import history, ranking, sequences

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_trims_before_the_shuffle(spark):
    scored = spark.range(100).select((F.col("id") % 3).alias("user_id"), F.col("id").alias("item_id"), F.rand(1).alias("score"))
    text = plan(ranking.top_k_items(scored, 5))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_last_n_trims_before_the_shuffle(spark):
    text = plan(history.keep_last_n(tables.log_a(spark, SF), 5, tables.ORDER_A))
    assert text.count("WindowGroupLimit") == 2


def test_histories_need_one_shuffle(spark):
    text = plan(tables.windows_a(spark, SF))
    assert text.count("Exchange hashpartitioning") == 1
    assert "SinglePartition" not in text and "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


def test_windows_prune_columns(spark):
    text = plan(sequences.tail_sequence(tables.placed_b(spark, SF), 5))
    assert "l_extendedprice" not in text and "l_tax" not in text


def test_no_query_plans_a_cross_join(spark):
    from pathloom.catalog import load_catalog

    for name in ("attach_degrees", "target_rank", "top_k_items", "union_results", "roc_points", "dense_ids", "split_rows"):
        text = plan(load_catalog()[0][name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text, name
