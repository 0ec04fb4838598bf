"""Negative sampling on training windows ``user_id, seq_no, item_seq``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.arrays import drop_out, left_pad, left_pad_with
from pathloom.functions.draws import DRAWS, any_item


def _seen(windows: DataFrame, item_count: int, column: str = "item_seq") -> DataFrame:
    """``_seen``: sorted distinct real items of the window; ``_free``: how many items remain."""
    seen = F.array_sort(F.array_distinct(F.filter(column, lambda x: x > 0)))
    return windows.withColumn("_seen", seen).withColumn("_free", F.lit(item_count) - F.size("_seen"))


def _draw(seed: int, draw: str, place: Column) -> Column:
    rank = DRAWS[draw](F.col("_free"), seed, F.col("user_id"), F.col("seq_no"), place) + 1
    walk = F.aggregate(
        F.col("_seen"), rank, lambda acc, x: F.when(x.cast("long") <= acc, acc + 1).otherwise(acc)
    )
    return walk.cast("int")


def sample_negatives(windows: DataFrame, item_count: int, seed: int = 42, draw: str = "hash") -> DataFrame:
    """``neg_item``: one item outside the window for each of its ``size - 1`` targets.

    One draw among the unseen items, then a walk over the sorted window: no rejection loop.
    A window of one item has no targets and no negatives; one that holds every item gets padding (0).
    """
    rows = _seen(windows, item_count)
    drawn = F.transform(F.sequence(F.lit(1), F.size("item_seq") - 1), lambda p: _draw(seed, draw, p))
    targets = F.greatest(F.size("item_seq") - 1, F.lit(0))
    padding = F.array_repeat(F.lit(0), targets)
    negatives = F.when((targets > 0) & (F.col("_free") > 0), drawn).otherwise(padding)
    return rows.withColumn("neg_item", negatives).drop("_seen", "_free")


def shared_count(num_negatives: int, workers: int, batch: int) -> int:
    """Negatives per sequence when ``num_negatives`` are shared by a global batch."""
    return math.ceil(num_negatives / workers / batch)


def sample_shared_negatives(
    windows: DataFrame,
    item_count: int,
    num_negatives: int,
    workers: int,
    batch: int,
    exclude_history: bool = True,
    seed: int = 42,
    draw: str = "hash",
) -> DataFrame:
    """``neg_item``: a fixed number of items per window; padding (0) where a window holds every item."""
    count = shared_count(num_negatives, workers, batch)
    places = F.sequence(F.lit(1), F.lit(count))
    if exclude_history:
        rows = _seen(windows, item_count)
        drawn = F.transform(places, lambda p: _draw(seed, draw, p))
        padding = F.array_repeat(F.lit(0), count)
        return rows.withColumn("neg_item", F.when(F.col("_free") > 0, drawn).otherwise(padding)).drop("_seen", "_free")
    items = F.transform(
        places, lambda p: any_item(item_count, seed, F.col("user_id"), F.col("seq_no"), p, draw=draw).cast("int")
    )
    return windows.withColumn("neg_item", items)


def sample_per_position(
    windows: DataFrame, item_count: int, per_position: int, seed: int = 42, draw: str = "hash"
) -> DataFrame:
    """``user_id, seq_no, pos, neg_item[]``: items for every position but the last, history not excluded."""
    rows = windows.filter(F.size("item_seq") >= 2).select(
        "user_id", "seq_no", F.explode(F.sequence(F.lit(1), F.size("item_seq") - 1)).alias("pos")
    )
    place = (F.col("seq_no") * 100_000 + F.col("pos")).cast("long")
    items = F.transform(
        F.sequence(F.lit(1), F.lit(per_position)),
        lambda j: any_item(item_count, seed, F.col("user_id"), place, j, draw=draw).cast("int"),
    )
    return rows.withColumn("neg_item", items)


def left_pad_negatives(
    windows: DataFrame, length: int, item_count: int, seed: int = 42, draw: str = "hash", column: str = "item_seq"
) -> DataFrame:
    """``column`` padded on the left with items it does not hold instead of 0."""
    rows = _seen(windows, item_count, column)
    filler = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda p: _draw(seed, draw, p))
    padded = F.when(F.col("_free") > 0, left_pad_with(F.col(column), filler, length)).otherwise(left_pad(F.col(column), length))
    return rows.withColumn(column, padded).drop("_seen", "_free")


def item_dropout(
    windows: DataFrame, mask: Column, first: int, rate: float, seed: int = 42, draw: str = "hash"
) -> DataFrame:
    """``mask`` with places from ``first`` (0-based) on zeroed at random with probability ``rate``."""
    modulus = 1_000_003
    rows = windows.withColumn("mask", mask)
    draws = F.transform(
        "mask", lambda m, i: DRAWS[draw](modulus, seed, F.col("user_id"), F.col("seq_no"), i) / F.lit(float(modulus))
    )
    return rows.withColumn("_draws", draws).withColumn("mask", drop_out(F.col("mask"), F.col("_draws"), first, rate)).drop("_draws")
