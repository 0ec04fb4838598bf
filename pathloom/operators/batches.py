"""Rows -> fixed-size batch records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.history import ordered_arrays
from pathloom.operators.skew import lookup


def pack_batches(
    indexed: DataFrame, size: int, stacked: Sequence[str], ragged: Sequence[str] = (), index: str = "idx"
) -> DataFrame:
    """``size`` consecutive rows -> one record: stacked columns become arrays of values,
    ragged columns are concatenated and their lengths kept in ``<column>_lens``.
    """
    batch = F.floor((F.col(index) - 1) / size).alias("batch_id")
    columns = [*stacked, *ragged]
    packed = ordered_arrays(indexed.groupBy(batch), columns, [index])
    lengths = {f"{c}_lens": F.transform(c, lambda x: F.size(x)) for c in ragged}
    packed = packed.withColumns(lengths) if lengths else packed
    return packed.withColumns({c: F.flatten(c) for c in ragged}) if ragged else packed


def pack_eval_batches(
    indexed: DataFrame, size: int, stacked: Sequence[str], history: DataFrame, index: str = "idx", **skew
) -> tuple[DataFrame, DataFrame]:
    """(batch records, (batch_id, row, item_id) pairs of the histories to suppress).

    Histories are unbounded, so they stay a table of pairs instead of an array in the record.
    """
    batches = pack_batches(indexed, size, stacked, index=index)
    places = indexed.select(
        "user_id",
        F.floor((F.col(index) - 1) / size).alias("batch_id"),
        F.pmod(F.col(index) - 1, F.lit(size)).cast("int").alias("row"),
    )
    return batches, history_pairs(history, places, **skew)


def history_pairs(history: DataFrame, places: DataFrame, **skew) -> DataFrame:
    """(batch_id, row, item_id): every history item with the place of its user in the batches."""
    return lookup(history, places, "user_id", "inner", **skew).select("batch_id", "row", "item_id")


def token_lengths(indexed: DataFrame, size: int, length: str, index: str = "idx") -> DataFrame:
    """``last_token``: place of each row's last token when the batch is packed end to end.

    The window runs inside one batch of ``size`` rows.
    """
    batch = F.floor((F.col(index) - 1) / size)
    inside = Window.partitionBy("batch_id").orderBy(index).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return indexed.withColumn("batch_id", batch).withColumn("last_token", F.sum(length).over(inside) - 1)
