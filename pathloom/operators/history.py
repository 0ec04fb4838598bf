"""Per-user histories.

A history is stored in segments of at most ``segment_length`` events, so a user with a
third of all events becomes many rows that many tasks build, not one unbounded array.
Users within the limit have exactly one segment, number 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.skew import frequent_keys, is_frequent, positions, running_sums

SEGMENT_LENGTH = 65_536


def ordered_arrays(group, columns: Sequence[str], order: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Aggregate grouped rows into aligned arrays.  Structs keep null elements in place."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.struct(*columns).alias("_v"))))
    out = group.agg(packed.alias("_rows"), *extra)
    arrays = [F.col("_rows._v")[c].alias(c) for c in columns]
    return out.select(*[c for c in out.columns if c != "_rows"], *arrays)


def build_history_arrays(
    events: DataFrame,
    columns: Sequence[str] = ("object_id", "event_time", "event_id"),
    order: Sequence[str] = ("event_time",),
    user: str = "user_id",
    segment_length: int = SEGMENT_LENGTH,
    **skew,
) -> DataFrame:
    """``user, segment, <one array per column>`` in time order."""
    placed = positions(events, [user], [F.col(c) for c in order], "_pos", **skew)
    segment = F.floor((F.col("_pos") - 1) / segment_length).cast("int").alias("segment")
    return ordered_arrays(placed.groupBy(user, segment), columns, ["_pos"])


def build_history_structs(
    events: DataFrame,
    event: Column,
    order: Sequence[str],
    user: str = "user_id",
    name: str = "uih",
    segment_length: int = SEGMENT_LENGTH,
    **skew,
) -> DataFrame:
    """``user, segment, uih``: one array of event structs in time order."""
    placed = positions(events.withColumn(name, event), [user], [F.col(c) for c in order], "_pos", **skew)
    segment = F.floor((F.col("_pos") - 1) / segment_length).cast("int").alias("segment")
    return ordered_arrays(placed.groupBy(user, segment), [name], ["_pos"])


def build_session_arrays(
    events: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    session: Sequence[str] = ("seq_user_id", "user_id", "sequence_id"),
    segment_length: int = SEGMENT_LENGTH,
    **skew,
) -> DataFrame:
    """One row of aligned arrays per session (and segment), in time order."""
    placed = positions(events, session, [F.col(c) for c in order], "_pos", **skew)
    segment = F.floor((F.col("_pos") - 1) / segment_length).cast("int").alias("segment")
    return ordered_arrays(placed.groupBy(*session, segment), columns, ["_pos"])


def concat_sessions(
    sessions: DataFrame,
    columns: Sequence[str],
    user: str = "user_id",
    sequence: str = "sequence_id",
    segment_length: int = SEGMENT_LENGTH,
    **skew,
) -> DataFrame:
    """Per user, the session arrays joined end to end in session order.

    The lengths of a user's earlier sessions say where a session starts; each session is cut into the slices
    that fall into one segment, and the slices of a (user, segment) are joined.  No event becomes a row of its
    own, and no group outgrows ``segment_length`` events however many sessions a user has.  Sessions without
    events leave no trace; arrays of unequal length are filled up with nulls.
    """
    places = [c for c in ("segment",) if c in sessions.columns]
    held = sessions.select(user, sequence, *places, F.arrays_zip(*columns).alias("_zip")).filter(F.size("_zip") > 0)
    started = _starts(held.withColumn("_size", F.size("_zip").cast("long")), user, [sequence, *places, "_zip"], **skew)
    first = F.floor(F.col("_start") / segment_length)
    last = F.floor((F.col("_start") + F.col("_size") - 1) / segment_length)
    cut = started.select(user, "_start", "_zip", "_size", F.explode(F.sequence(first, last)).alias("_segment"))
    low = F.greatest(F.col("_segment") * segment_length, F.col("_start"))
    high = F.least((F.col("_segment") + 1) * segment_length, F.col("_start") + F.col("_size"))
    piece = F.slice("_zip", (low - F.col("_start") + 1).cast("int"), (high - low).cast("int"))
    packed = F.array_sort(F.collect_list(F.struct(low.alias("_low"), piece.alias("_piece"))))
    joined = cut.groupBy(user, F.col("_segment").cast("int").alias("segment")).agg(F.flatten(packed["_piece"]).alias("_all"))
    return joined.select(user, "segment", *[F.col("_all")[c].alias(c) for c in columns])


def _starts(
    rows: DataFrame, user: str, order: Sequence[str], frequent: Sequence | None = None, min_rows: int | None = None
) -> DataFrame:
    """``_start``: what the ``_size`` of the user's earlier rows adds up to.

    Ordinary users have one window; rows of frequent users are range-sorted together and their running total
    is counted from the user's first row.
    """
    if frequent is None:
        frequent = frequent_keys(rows, [user], min_rows)
    earlier = Window.partitionBy(user).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_size").over(earlier), F.lit(0))
    if not frequent:
        return rows.withColumn("_start", start)
    hot = is_frequent([user], frequent)
    summed = running_sums(rows.filter(hot), [F.col(c) for c in (user, *order)], {"_size": "_end"})
    before = F.col("_end") - F.col("_size")
    base = summed.groupBy(F.col(user).alias("_user")).agg(F.min(before).alias("_base"))  # one row per frequent user
    placed = summed.join(F.broadcast(base), F.col(user).eqNullSafe(F.col("_user"))).withColumn("_start", before - F.col("_base"))
    columns = [*rows.columns, "_start"]
    return rows.filter(~hot).withColumn("_start", start).select(*columns).unionByName(placed.select(*columns))


def build_item_table(
    events: DataFrame, columns: Sequence[str], order: Sequence[str], item: str = "object_id"
) -> DataFrame:
    """One row per item with the attribute values of its earliest event (partial aggregation)."""
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("_f")
    return events.groupBy(item).agg(first).select(item, *[F.col("_f")[c].alias(c) for c in columns])


def explode_history(
    histories: DataFrame, columns: Sequence[str], user: str = "user_id", segment_length: int | None = None
) -> DataFrame:
    """Arrays -> one row per event with its 1-based place; empty histories give no row.

    Places continue across segments.  How long the earlier segments of a history are is read from the table,
    for the histories that have several; a ``segment_length`` says that all but the last are that long.
    """

    def flat(rows: DataFrame, first: Column) -> DataFrame:
        out = rows.select(user, first.alias("_first"), F.posexplode(F.arrays_zip(*columns)).alias("_place", "_e"))
        return out.select(user, (F.col("_first") + F.col("_place") + 1).alias("pos"), *[F.col("_e")[c].alias(c) for c in columns])

    if "segment" not in histories.columns:
        return flat(histories, F.lit(0).cast("long"))
    if segment_length is not None:
        return flat(histories, F.col("segment").cast("long") * segment_length)
    sizes = histories.select(F.col(user).alias("_user"), F.col("segment").alias("_segment"), F.size(columns[0]).cast("long").alias("_size"))
    earlier = Window.partitionBy("_user").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_first", F.sum("_size").over(earlier)).filter(F.col("_segment") > 0).drop("_size")
    same = F.col(user).eqNullSafe(F.col("_user")) & (F.col("segment") == F.col("_segment"))
    later = histories.filter(F.col("segment") > 0).join(starts, same)
    return flat(histories.filter(F.col("segment") == 0), F.lit(0).cast("long")).unionByName(flat(later, F.col("_first")))


def keep_last_n(events: DataFrame, n: int, order: Sequence[str], user: str = "user_id") -> DataFrame:
    """The last ``n`` events of each user.

    Spark trims each map task to ``n`` rows per user before the shuffle (WindowGroupLimit).
    """
    newest_first = Window.partitionBy(user).orderBy(*[F.col(c).desc() for c in order])
    return events.withColumn("_r", F.row_number().over(newest_first)).filter(F.col("_r") <= n).drop("_r")


def gap_to_next(events: DataFrame, time: str, order: Sequence[str], user: str = "user_id", **skew) -> DataFrame:
    """``gap``: seconds to the user's next event, 0 for the last.

    The next event is found by position, so a user with very many events is not read by one task.
    """
    if skew.get("frequent") is None:
        skew["frequent"] = frequent_keys(events, [user], skew.pop("min_rows", None))
    placed = positions(events, [user], [F.col(c) for c in order], **skew)
    if not skew["frequent"]:  # the window that numbers the events has them together already
        following = F.lead(time).over(Window.partitionBy(user).orderBy("pos"))
        return placed.withColumn("gap", F.coalesce(following - F.col(time), F.lit(0)))
    block = 4096  # rows per window group; the first row of a block is copied into the one before
    home = F.floor((F.col("pos") - 1) / block)
    copies = F.when((F.col("pos") % block == 1) & (F.col("pos") > 1), F.array(home, home - 1)).otherwise(F.array(home))
    spread = placed.withColumn("_home", home).withColumn("_block", F.explode(copies))
    following = F.lead(time).over(Window.partitionBy(user, "_block").orderBy("pos"))
    return (
        spread.withColumn("gap", F.coalesce(following - F.col(time), F.lit(0)))
        .filter(F.col("_block") == F.col("_home"))
        .drop("_block", "_home")
    )
