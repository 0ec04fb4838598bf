"""Histories -> training and evaluation windows.

Input is a table of events that already carry their 1-based position ``pos`` and the user's
event count ``n`` (``pathloom.operators.skew.positions``).  Cutting is done on positions, so
arrays are only ever built for one window of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.arrays import left_pad
from pathloom.operators.history import ordered_arrays
from pathloom.operators.skew import positions


def place_events(
    events: DataFrame, order: list[str], user: str = "user_id", item: str = "item_id", time: str = "event_time", **skew
) -> DataFrame:
    """``user_id, item_id, event_time, pos, n``."""
    placed = positions(events, [user], [F.col(c) for c in order], "pos", "n", **skew)
    return placed.select(
        F.col(user).alias("user_id"), F.col(item).alias("item_id"), F.col(time).alias("event_time"), "pos", "n"
    )


def leave_last_k_train(placed: DataFrame, k: int = 2) -> DataFrame:
    """All but each user's last ``k`` events; users with no more than ``k`` events vanish."""
    return placed.withColumn("n", F.col("n") - k).filter(F.col("pos") <= F.col("n"))


def slice_events(placed: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Python's ``history[start:end]`` on whole histories; positions are counted anew."""
    n = F.col("n")
    first = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    if not end:
        last = n
    elif end > 0:
        last = F.least(n, F.lit(end))
    else:
        last = n + end
    kept = placed.withColumn("_first", first.cast("long")).withColumn("_last", last.cast("long"))
    kept = kept.filter((F.col("pos") > F.col("_first")) & (F.col("pos") <= F.col("_last")))
    return kept.withColumn("pos", F.col("pos") - F.col("_first")).withColumn(
        "n", F.col("_last") - F.col("_first")
    ).drop("_first", "_last")


def _windows(rows: DataFrame, seq_no: Column) -> DataFrame:
    named = rows.withColumnsRenamed({"item_id": "item_seq", "event_time": "time_seq"})
    return ordered_arrays(named.groupBy("user_id", seq_no.cast("int").alias("seq_no")), ["item_seq", "time_seq"], ["pos"])


def tail_sequence(placed: DataFrame, length: int) -> DataFrame:
    """The last ``length`` events of each user as one window."""
    return _windows(placed.filter(F.col("pos") > F.col("n") - length), F.lit(0))


def chunk_sequences(placed: DataFrame, length: int, split: bool = True) -> DataFrame:
    """Histories longer than ``length``: the ``n % length`` oldest events are dropped and the
    rest is cut into full windows.  Shorter ones stay whole.  Without ``split``, the tail.
    """
    if not split:
        return tail_sequence(placed, length)
    dropped = F.when(F.col("n") > length, F.col("n") % length).otherwise(F.lit(0))
    rows = placed.withColumn("_dropped", dropped).filter(F.col("pos") > F.col("_dropped"))
    return _windows(rows, F.floor((F.col("pos") - F.col("_dropped") - 1) / length))


def prefix_augment(windows: DataFrame) -> DataFrame:
    """Every prefix of length 2 .. n of each window."""
    sizes = windows.filter(F.size("item_seq") >= 2).withColumn(
        "prefix_len", F.explode(F.sequence(F.lit(2), F.size("item_seq")))
    )
    return sizes.withColumns({c: F.slice(c, F.lit(1), F.col("prefix_len")) for c in ("item_seq", "time_seq")})


def right_aligned_chunks(placed: DataFrame, length: int) -> DataFrame:
    """Full windows of ``length`` cut from the newest end; ``seq_no`` 1 is the newest."""
    number = F.floor((F.col("n") - F.col("pos")) / length) + 1
    rows = placed.filter((F.col("n") >= length) & (number <= F.floor(F.col("n") / length)))
    return _windows(rows, number)


def _held_out(phase: str, k: int) -> int:
    if phase not in ("valid", "test"):
        raise ValueError(f"phase must be valid or test, got {phase!r}")
    last = k if phase == "valid" else k // 2
    if last < 1:
        raise ValueError(f"k={k} leaves no target for phase {phase}")
    return last


def eval_split(placed: DataFrame, length: int, phase: str = "valid", k: int = 2) -> DataFrame:
    """One row per user: the target, and the ``length`` events before it, left-padded with 0.

    The target is the k-th last event (``k // 2``-th last for the test phase).  Users with too
    few events are left out.  The history to suppress is given by ``eval_history``.
    """
    target = F.col("n") - _held_out(phase, k) + 1
    near = placed.withColumn("_target", target).filter(
        (F.col("_target") >= 1) & F.col("pos").between(F.col("_target") - length, F.col("_target"))
    )
    packed = F.array_sort(F.collect_list(F.when(F.col("pos") < F.col("_target"), F.struct("pos", "item_id", "event_time"))))
    rows = near.groupBy("user_id").agg(
        packed.alias("_h"),
        F.max(F.when(F.col("pos") == F.col("_target"), F.col("item_id"))).alias("target"),
        F.max(F.col("_target") - 1).alias("history_len"),
    )
    return rows.select(
        "user_id",
        left_pad(F.col("_h.item_id"), length).alias("item_seq"),
        "target",
        left_pad(F.col("_h.event_time"), length).alias("time_seq"),
        "history_len",
    )


def eval_history(placed: DataFrame, phase: str = "valid", k: int = 2) -> DataFrame:
    """The whole history before the target, one row per event."""
    return placed.filter(F.col("pos") <= F.col("n") - _held_out(phase, k)).select("user_id", "item_id", "pos")


def short_histories(placed: DataFrame, phase: str = "valid", k: int = 2) -> DataFrame:
    """Report: users that cannot give a target."""
    return placed.filter((F.col("n") < _held_out(phase, k)) & (F.col("pos") == 1)).select("user_id", "n")
