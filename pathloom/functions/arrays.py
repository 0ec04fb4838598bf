"""Column functions on bounded item sequences (one training or evaluation window)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate, pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero_like(column: Column, count: Column | int, fill: int | float) -> Column:
    return F.array_repeat(F.lit(fill), F.greatest(F.lit(count) if isinstance(count, int) else count, F.lit(0)))


def position_slice(column: Column, start: int = 0, end: int | None = None) -> Column:
    """Python's ``column[start:end]``; an ``end`` of 0 or None means the end of the sequence."""
    size = F.size(column)
    first = F.lit(start) if start >= 0 else F.greatest(size + start, F.lit(0))
    if not end:
        last = size
    elif end > 0:
        last = F.least(size, F.lit(end))
    else:
        last = size + end
    return F.slice(column, first + 1, F.greatest(last - first, F.lit(0)))


def last_items(column: Column, length: int) -> Column:
    size = F.size(column)
    return F.slice(column, F.greatest(size - length, F.lit(0)) + 1, F.least(size, F.lit(length)))


def left_pad(column: Column, length: int, fill: int = 0) -> Column:
    """The last ``length`` elements, filled on the left."""
    return F.concat(_zero_like(column, length - F.size(column), fill), last_items(column, length))


def left_pad_with(column: Column, padding: Column, length: int) -> Column:
    """The last ``length`` elements, filled on the left from the end of ``padding``."""
    missing = F.greatest(length - F.size(column), F.lit(0))
    return F.concat(F.slice(padding, 1, missing), last_items(column, length))


def position_mask(size: Column, length: int) -> Column:
    """1 for each of the ``size - 1`` predictable positions, left-padded with 0 to ``length``."""
    ones = F.least(F.greatest(size - 1, F.lit(0)), F.lit(length))
    return F.concat(F.array_repeat(F.lit(0), length - ones), F.array_repeat(F.lit(1), ones))


def real_item_mask(column: Column) -> Column:
    """1 where the sequence holds an item, 0 where it holds padding."""
    return F.transform(column, lambda x: (x != 0).cast("int"))


def input_items(column: Column) -> Column:
    return F.slice(column, 1, F.greatest(F.size(column) - 1, F.lit(0)))


def target_items(column: Column) -> Column:
    return F.slice(column, 2, F.greatest(F.size(column) - 1, F.lit(0)))


def split_long_recent(column: Column, long_count: int, recent_count: int) -> tuple[Column, Column]:
    """First ``long_count`` and last ``recent_count`` items; too short a sequence is an error."""
    enough = F.size(column) >= long_count + recent_count
    message = f"sequence must have at least {long_count + recent_count} items"

    def checked(part: Column) -> Column:
        return F.when(enough, part).otherwise(F.raise_error(F.lit(message)).cast("array<int>"))

    return checked(F.slice(column, 1, long_count)), checked(F.slice(column, -recent_count, recent_count))


def _cuts(plan: Sequence[tuple[int, int]], marker_count: int) -> tuple[list[int], list[int]]:
    """Places where a window is cut, and how many markers stand before each of the pieces."""
    before = [0, *accumulate(k for _, k in plan)]
    if before[-1] != marker_count:
        raise ValueError(f"insert plan {list(plan)} does not add up to {marker_count} markers")
    return [0, *(at for at, _ in plan)], before


def insert_placeholders(
    column: Column, plan: Sequence[tuple[int, int]], marker_count: int, marker: int = -1
) -> Column:
    """Put ``k`` markers in front of the element at each 0-based offset of ``plan``; an offset beyond the window is an error."""
    cuts, _ = _cuts(plan, marker_count)
    size = F.size(column)
    pieces = [F.slice(column, a + 1, b - a) for a, b in pairwise(cuts)] + [F.slice(column, cuts[-1] + 1, F.greatest(size - cuts[-1], F.lit(0)))]
    markers = [F.array_repeat(F.lit(marker), k) for _, k in plan]
    whole = F.concat(pieces[0], *[c for pair in zip(markers, pieces[1:], strict=True) for c in pair])
    beyond = F.raise_error(F.concat(F.lit(f"insert plan reaches {max(cuts)}, window holds "), size.cast("string")))
    return F.when(size < max(cuts), beyond.cast("array<int>")).otherwise(whole)


def segment_bounds(length: Column, plan: Sequence[tuple[int, int]], marker_count: int) -> Column:
    """Inclusive 0-based (first, last) of every stretch of items between the markers."""
    cuts, before = _cuts(plan, marker_count)
    ends = [*(F.lit(c) for c in cuts[1:]), length]
    bounds = [(F.lit(c + m), end + (m - 1)) for c, end, m in zip(cuts, ends, before, strict=True)]
    return F.array(*[F.struct(a.cast("int").alias("first"), b.cast("int").alias("last")) for a, b in bounds])


def loss_mask(mask: Column, bounds: Column, recent_only: bool = False) -> Column:
    """``mask`` kept inside item segments; with ``recent_only`` just inside the last one."""
    used = F.slice(bounds, -1, 1) if recent_only else bounds
    return F.transform(
        mask, lambda m, i: F.when(F.exists(used, lambda s: i.between(s["first"], s["last"])), m).otherwise(F.lit(0))
    )


def drop_out(mask: Column, draws: Column, first: int, rate: float) -> Column:
    """Zero the mask from position ``first`` (0-based) on, where the draw in [0, 1) is under ``rate``."""
    if not 0 <= rate <= 1:
        raise ValueError(f"rate must be in [0, 1], got {rate}")
    return F.transform(
        mask, lambda m, i: F.when((i >= first) & (F.get(draws, i) < rate), F.lit(0)).otherwise(m)
    )


def pad_scores(column: Column, width: int) -> Column:
    """Fill a ragged score list on the right with minus infinity."""
    missing = F.greatest(width - F.size(column), F.lit(0))
    return F.concat(column, F.array_repeat(F.lit(float("-inf")), missing))


def truncate_tokens(column: Column, limit: int) -> Column:
    return F.slice(column, 1, limit)


def token_layout(tokens: Column, limit: int, slots: int) -> Column:
    """Struct of ids with ``slots`` trailing zeros, their count, and right-aligned position ids."""
    kept = truncate_tokens(tokens, limit)
    count = F.size(kept)
    places = F.when(
        count + slots > 0, F.sequence(limit - count, F.lit(limit - 1 + slots))
    ).otherwise(F.array().cast("array<int>"))
    return F.struct(
        F.concat(kept, F.array_repeat(F.lit(0), slots)).alias("input_ids"),
        (count + slots).alias("input_len"),
        places.alias("position_ids"),
    )
