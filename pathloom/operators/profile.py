"""Counts and descriptive statistics of a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bin edges of the history-length report.
LENGTH_EDGES = [2**i for i in range(13)]


def count_distinct_entities(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    counter = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(F.count(F.lit(1)).alias("rows"), *[counter(c).alias(f"n_{c}") for c in columns])


def max_item_id(histories: DataFrame, column: str = "item_id") -> DataFrame:
    """Largest id over all arrays, without exploding them."""
    return histories.agg(F.max(F.array_max(column)).alias("max_item_id"))


def total_interactions(histories: DataFrame, column: str = "item_id") -> DataFrame:
    return histories.agg(F.sum(F.size(column)).cast("long").alias("total_interactions"))


def user_counter(histories: DataFrame, column: str = "item_id") -> DataFrame:
    """Events per user; segments of a long history are added up."""
    return histories.groupBy("user_id").agg(F.sum(F.size(column)).cast("long").alias("n"))


def item_counter(histories: DataFrame, column: str = "item_id") -> DataFrame:
    return (
        histories.select(F.explode(column).alias("item_id")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    )


def dataset_profile(events: DataFrame) -> DataFrame:
    """One row: sizes, average actions per user and item, sparsity."""
    base = events.agg(
        F.countDistinct("user_id").alias("user_num"),
        F.countDistinct("item_id").alias("item_num"),
        F.count(F.lit(1)).alias("inter_num"),
    )
    n = F.col("inter_num").cast("double")
    return base.select(
        "*",
        F.try_divide(n, F.col("user_num")).alias("avg_actions_of_users"),
        F.try_divide(n, F.col("item_num")).alias("avg_actions_of_items"),
        (1 - F.try_divide(F.try_divide(n, F.col("user_num")), F.col("item_num"))).alias("sparsity"),
    )


def history_length_by_user(df: DataFrame, column: str, user: str = "user_id") -> DataFrame:
    return df.groupBy(user).agg(F.sum(F.size(column)).cast("long").alias("history_len"))


def length_survival_histogram(lengths: DataFrame, column: str = "history_len") -> DataFrame:
    """``edge, users``: users with a length in [edge, last edge], for every edge but the last."""
    top = LENGTH_EDGES[-1]
    counts = lengths.agg(
        *[
            F.count(F.when(F.col(column).between(edge, top), 1)).alias(str(edge))
            for edge in LENGTH_EDGES[:-1]
        ]
    )
    pairs = [F.struct(F.lit(e).alias("edge"), F.col(str(e)).alias("users")) for e in LENGTH_EDGES[:-1]]
    return counts.select(F.inline(F.array(*pairs)))


def distinct_users(events: DataFrame, user: str = "user_id") -> DataFrame:
    """Each user once; rows of one user are folded before the shuffle."""
    return events.select(user).distinct()
