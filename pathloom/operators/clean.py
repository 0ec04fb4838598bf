"""Projection, recoding and filtering of raw events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.times import epoch_seconds_rounded, epoch_seconds_truncated
from pathloom.operators.history import explode_history
from pathloom.operators.skew import frequent_keys, lookup, positions
from pathloom.sources.schemas import EVENT_FIELDS


def backfill_category(names: Sequence[str]) -> Column:
    """The most specific category that is set; ``names`` runs from general to specific."""
    return F.coalesce(*reversed([F.col(n) for n in names]))


def map_event_code(event: Column, codes: Mapping[str, int]) -> Column:
    """Integer code of an event name; null where the name is unknown."""
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), event).cast("int")


def split_by_event_code(df: DataFrame, event: str, codes: Mapping[str, int]) -> tuple[DataFrame, DataFrame]:
    """(rows with the event recoded, rejected rows whose event name has no code)."""
    coded = df.withColumn("_code", map_event_code(F.col(event), codes))
    kept = coded.filter(F.col("_code").isNotNull()).withColumn(event, F.col("_code")).drop("_code")
    return kept, coded.filter(F.col("_code").isNull()).drop("_code")


def project_events(
    df: DataFrame,
    columns: Sequence[str],
    time: str = "stime",
    category_names: Sequence[str] = ("c0_name", "c1_name", "c2_name"),
    category_ids: Sequence[str] = ("c0_id", "c1_id", "c2_id"),
) -> DataFrame:
    """The named columns, the backfilled category, and the time in whole epoch seconds."""
    return df.select(
        *columns,
        backfill_category(category_names).alias("category_name"),
        backfill_category(category_ids).alias("category_id"),
        epoch_seconds_rounded(F.col(time)).alias(time),
    )


def pack_event_struct(fields: Mapping[str, str] = EVENT_FIELDS) -> Column:
    """One event as a typed struct."""
    return F.struct(*[F.col(name).cast(kind).alias(name) for name, kind in fields.items()])


def rename_columns(df: DataFrame, names: Mapping[str, str], drop: Sequence[str] = ()) -> DataFrame:
    return df.drop(*drop).withColumnsRenamed(dict(names))


def count_by_key(df: DataFrame, key: str, count: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(count))


def join_user_counts(df: DataFrame, user: str = "user_id", count: str = "user_count", **skew) -> DataFrame:
    """Events with the number of events of their user; events without a user are dropped."""
    known = df.filter(F.col(user).isNotNull())
    return lookup(known, count_by_key(known, user, count), user, "inner", **skew)


def filter_min_events(df: DataFrame, least: int, user: str = "user_id", **skew) -> DataFrame:
    """Events of the users that have at least ``least`` of them."""
    known = df.filter(F.col(user).isNotNull())
    active = count_by_key(known, user, "_n").filter(F.col("_n") >= least).select(user)
    return lookup(known, active, user, "inner", **skew)


def filter_min_history(df: DataFrame, column: str, least: int = 10, user: str = "user_id") -> DataFrame:
    """Histories of at least ``least`` events; the segments of one user count together."""
    if "segment" not in df.columns:
        return df.filter(F.size(column) >= least)
    lengths = df.groupBy(user).agg(F.sum(F.size(column)).alias("_n")).filter(F.col("_n") >= least)
    return df.join(lengths.select(F.col(user).alias("_u")), F.col(user).eqNullSafe(F.col("_u")), "left_semi")


def attach_counts(df: DataFrame, keys: Mapping[str, str], frequent: Mapping[str, list] | None = None) -> DataFrame:
    """Left lookup of a row count per key column: ``{key column: count column}``.

    Counts and frequent keys come from the input itself, not from the joined rows.
    """
    out = df
    for key, name in keys.items():
        hot = (frequent or {}).get(key)
        out = lookup(out, count_by_key(df, key, name), key, frequent=frequent_keys(df, key) if hot is None else hot)
    return out


def filter_rating_counts(df: DataFrame, least: int = 5) -> DataFrame:
    return df.filter((F.col("item_count") >= least) & (F.col("user_count") >= least))


def filter_core_once(df: DataFrame, least: int = 5, frequent: Mapping[str, list] | None = None) -> DataFrame:
    """One pass of count filters on items and users, then users re-checked on what is left.

    A user's events on frequent items are at most all their events, so the re-check implies
    the first user filter: two semi joins do.
    """
    hot = {k: (frequent or {}).get(k) for k in ("item_id", "user_id")}
    hot = {k: frequent_keys(df, k) if v is None else v for k, v in hot.items()}
    left = filter_min_events(df, least, "item_id", frequent=hot["item_id"])
    return filter_min_events(left, least, "user_id", frequent=hot["user_id"])


def select_interaction_columns(df: DataFrame) -> DataFrame:
    return df.select("item_id", "user_id", "timestamp")


def split_by_vocabulary(df: DataFrame, column: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose id is in ``1 .. size``, rejected rows)."""
    known = F.coalesce(F.col(column).between(1, size), F.lit(False))
    return df.filter(known), df.filter(~known)


def order_events(df: DataFrame, order: Sequence[str], **skew) -> DataFrame:
    """Events in a stable order; the order is carried by the position ``pos`` in the user's history."""
    return positions(df, ["user_id"], [F.col(c) for c in order], **skew)


def explode_parallel(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Aligned array columns -> one row per element."""
    others = [c for c in df.columns if c not in arrays]
    return df.select(*others, F.inline(F.arrays_zip(*arrays)))


def news_events(history: DataFrame) -> DataFrame:
    """Nested news histories -> canonical events (time truncated to seconds); ``pos`` keeps their order."""
    arrays = ["article_id_fixed", "impression_time_fixed", "scroll_percentage_fixed", "read_time_fixed"]
    flat = explode_history(history, arrays)
    return flat.select(
        "user_id",
        F.col("article_id_fixed").alias("object_id"),
        epoch_seconds_truncated(F.col("impression_time_fixed")).alias("event_time"),
        F.col("scroll_percentage_fixed").alias("event_id"),
        "read_time_fixed",
        "pos",
    )


def news_articles(articles: DataFrame) -> DataFrame:
    """Article times as epoch seconds."""
    return articles.withColumns(
        {c: epoch_seconds_truncated(F.col(c)) for c in ("last_modified_time", "published_time")}
    )
