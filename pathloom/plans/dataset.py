"""Raw events -> histories and item table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.times import epoch_seconds_rounded
from pathloom.operators.clean import backfill_category, count_by_key, map_event_code
from pathloom.operators.history import build_history_arrays, build_item_table
from pathloom.operators.ids import dense_vocabulary, encode_ids, frequent_ids
from pathloom.operators.skew import global_index, lookup
from pathloom.session import save_shared


def build_dataset(
    events: DataFrame,
    text_columns: Sequence[str] = ("brand_name", "category_name"),
    user: str = "user_id",
    time: str = "stime",
    event: str = "event_id",
    item: str = "product_id",
    categories: Sequence[str] | None = ("c0_name", "c1_name", "c2_name"),
    event_codes: Mapping[str, int] | None = None,
    min_events: int = 1024,
    tie: Sequence[str] = (),
    share_events: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(histories ``user_id, segment, object_id[], event_time[], event_id[]``, items ``object_id, text``).

    Users with at least ``min_events`` events are kept and numbered in key order, and so are
    the items they touch.  ``tie`` names columns that order events of the same second.
    With ``share_events`` the coded events are written once to the shared folder and both
    results read them there; worth it when both are written.
    """
    text = [
        backfill_category(categories).alias(c) if c == "category_name" and categories else F.col(c) for c in text_columns
    ]
    flat = events.select(
        F.col(user).alias("user_id"),
        F.col(item).alias("object_id"),
        *text,
        epoch_seconds_rounded(F.col(time)).alias("event_time"),
        (map_event_code(F.col(event), event_codes) if event_codes else F.col(event)).alias("event_id"),
        *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)],
    ).filter(F.col("user_id").isNotNull())
    counts = count_by_key(flat, "user_id").filter(F.col("n") >= min_events)
    users = global_index(counts, [F.col("user_id")], "_uid")
    kept = lookup(flat, users.select("user_id", F.col("_uid").cast("int").alias("_uid")), "user_id", "inner",
                  frequent=frequent_ids(users, "user_id"))
    kept = kept.withColumn("user_id", F.col("_uid")).drop("_uid")
    coded = encode_ids(kept, "object_id", dense_vocabulary(kept, "object_id"))
    if share_events:
        coded = save_shared(coded, "coded-events")
    ties = [f"_tie{i}" for i in range(len(tie))]
    histories = build_history_arrays(
        coded, ["object_id", "event_time", "event_id"], ["event_time", *ties], frequent=frequent_ids(users, "_uid")
    )
    items = build_item_table(coded, list(text_columns), ["event_time", "user_id", *ties])
    return histories, items
