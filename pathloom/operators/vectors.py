"""Sequences of item vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.vectors import l2_normalize
from pathloom.operators.history import ordered_arrays
from pathloom.operators.skew import lookup


def lookup_vectors(windows: DataFrame, items: DataFrame, keys=("user_id", "seq_no"), **skew) -> DataFrame:
    """Each id of ``item_seq`` replaced by its vector, order kept; padding gets an empty vector."""
    flat = windows.select(*keys, F.posexplode("item_seq").alias("_place", "item_id"))
    found = lookup(flat, items.select("item_id", "vector"), "item_id", **skew)
    filled = found.withColumn("vector", F.coalesce("vector", F.array().cast(items.schema["vector"].dataType)))
    return ordered_arrays(filled.groupBy(*keys), ["item_id", "vector"], ["_place"])


def mean_pool(vectors: DataFrame, keys: list[str], column: str = "vector") -> DataFrame:
    """Element-wise mean of the vectors of each group: one partial sum vector per group and map task."""
    dense = array_to_vector(F.col(column).cast("array<double>"))
    return vectors.groupBy(*keys).agg(vector_to_array(Summarizer.mean(dense)).alias(column))


def masked_mean(value: Column, mask: Column) -> Column:
    """Aggregate: mean of the values whose mask is 1."""
    return F.avg(F.when(mask == 1, value))


def mean_user_vectors(windows: DataFrame, items: DataFrame, **skew) -> DataFrame:
    """Built-in user encoder: normalised mean of the item vectors of each user's window."""
    flat = windows.select("user_id", F.explode("item_seq").alias("item_id")).filter(F.col("item_id") != 0)
    found = lookup(flat, items.select("item_id", "vector"), "item_id", "inner", **skew)
    pooled = mean_pool(found, ["user_id"])
    return pooled.select("user_id", l2_normalize(F.col("vector")).alias("vector"))
