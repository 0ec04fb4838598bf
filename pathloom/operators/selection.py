"""Cutting a table at exact ranks of an order without sorting or moving its rows.

The rank is found by counting: rows are counted by leading bits of a numeric key, then only those of the
bucket that holds the rank by the next bits, until a bucket is small.  Each pass reads the key columns
alone and exchanges counts.  Rows are then labelled by comparing them with the cut.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.skew import row_index

_BITS = 12  # a pass tells 2**12 buckets apart
_SMALL = 10_000  # rows of a bucket whose distinct keys are looked at one by one


def _cuts(rows: DataFrame, ranks: Sequence[int], n: int, low: int, high: int) -> list[tuple]:
    """For each rank the (key, tie) found there, the rows before that pair and the rows equal to it."""
    at = {r: (0, n, None, 0) for r in ranks}  # rank -> rows before its bucket, rows in it, bucket, shift
    bits = (high - low).bit_length()
    while bits and any(size > _SMALL for _, size, _, _ in at.values()):
        bits = max(0, bits - _BITS)
        inside = F.lit(False)
        for _, _, bucket, shift in at.values():
            inside = inside | (F.lit(True) if bucket is None else F.shiftright("_key", shift) == bucket)
        counted = rows.filter(inside).groupBy(F.shiftright("_key", bits).alias("b")).count().collect()  # a few thousand rows
        counted = sorted((r["b"], r["count"]) for r in counted)
        for rank, (before, _, bucket, shift) in list(at.items()):
            for b, c in counted:
                if bucket is not None and b >> (shift - bits) != bucket:
                    continue
                if before + c >= rank:
                    at[rank] = (before, c, b, bits)
                    break
                before += c
    out = []
    for rank, (before, _, bucket, shift) in at.items():
        near = rows if bucket is None else rows.filter(F.shiftright("_key", shift) == bucket)
        # Few rows, or the rows of one key value.
        for r in near.groupBy("_key", "_tie").count().orderBy("_key", "_tie").toLocalIterator():
            if before + r["count"] >= rank:
                out.append((r["_key"], r["_tie"], before, r["count"]))
                break
            before += r["count"]
    return out


def selected(df: DataFrame, key: Column, tie: Column, rank: Callable[[int], int]) -> tuple | None:
    """The (key, tie) of the row at ``rank(number of rows)``, None where there is no such row."""
    rows = df.select(key.alias("_key"), tie.alias("_tie"))
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("_key"), F.max("_key")).first()
    r = min(rank(n), n)
    return _cuts(rows, [r], n, low, high)[0][:2] if r > 0 else None


def parts_at(df: DataFrame, key: Column, tie: Column, ranks: Callable[[int], Sequence[int]], part: str) -> DataFrame:
    """``part``: how many of the ``ranks(number of rows)`` lie before the row, rows ordered by ``key`` (a long)
    and ``tie``.  Rows equal in both that a rank divides are told apart by their place in the table."""
    rows = df.select(key.alias("_key"), tie.alias("_tie"))
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("_key"), F.max("_key")).first()
    asked = list(ranks(n))
    inner = sorted({r for r in asked if 0 < r < n})
    found = dict(zip(inner, _cuts(rows, inner, n, low or 0, high or 0) if inner else [], strict=True))
    kind = rows.schema["_tie"].dataType
    here = F.struct(key.alias("_key"), tie.alias("_tie"))

    def pair(cut: tuple) -> Column:
        return F.struct(F.lit(cut[0]).cast("long").alias("_key"), F.lit(cut[1]).cast(kind).alias("_tie"))

    beyond = F.lit(sum(r <= 0 for r in asked))
    for r in asked:
        if r in found:
            beyond = beyond + (here > pair(found[r])).cast("int")
    out = df.withColumn(part, beyond)
    divided = {c[:2]: c for r, c in found.items() if r < c[2] + c[3]}
    for cut in divided.values():
        equal = (here >= pair(cut)) & (here <= pair(cut))
        tied = row_index(out.filter(equal), "_place")
        place = F.col("_place") + cut[2]
        again = F.lit(sum(r <= 0 for r in asked))
        for r in asked:
            if 0 < r < n:
                again = again + (place > r).cast("int")
        out = out.filter(~equal).unionByName(tied.withColumn(part, again).drop("_place"))
    return out
