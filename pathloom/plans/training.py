"""Histories -> padded training examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.arrays import left_pad, position_mask
from pathloom.functions.times import decompose_time
from pathloom.operators.negatives import left_pad_negatives, sample_negatives, sample_shared_negatives
from pathloom.operators.sequences import chunk_sequences, leave_last_k_train, place_events


def training_examples(
    events: DataFrame,
    order: list[str],
    length: int,
    item_count: int,
    k: int = 2,
    split: bool = True,
    random_padding: bool = False,
    num_negatives: int | None = None,
    seed: int = 42,
    draw: str = "hash",
    **skew,
) -> DataFrame:
    """``user_id, seq_no, item_seq[L+1], neg_item, masked_index[L], time_ids[L+1][6]``.

    ``neg_item`` holds one negative per target, padded to L+1 places; with ``num_negatives`` it holds that many
    for the whole window instead.  ``random_padding`` pads items and negatives with items that the sequence
    does not hold.
    """
    full = length + 1
    placed = leave_last_k_train(place_events(events, order, **skew), k)
    windows = chunk_sequences(placed, full, split)
    if num_negatives:
        windows = sample_shared_negatives(windows, item_count, num_negatives, 1, 1, seed=seed, draw=draw)
    else:
        windows = sample_negatives(windows, item_count, seed, draw)
    windows = windows.withColumns(
        {
            "masked_index": position_mask(F.size("item_seq"), length),
            "time_ids": decompose_time(left_pad(F.col("time_seq"), full)),
        }
    )
    padded = ["item_seq"] if num_negatives else ["item_seq", "neg_item"]
    for step, column in enumerate(padded, 1):
        if random_padding:
            windows = left_pad_negatives(windows, full, item_count, seed + step, draw, column)
        else:
            windows = windows.withColumn(column, left_pad(F.col(column), full))
    return windows.select("user_id", "seq_no", "item_seq", "neg_item", "masked_index", "time_ids")
