"""Seeded pseudo-random draws that depend on data values only.

A draw never depends on how rows are partitioned, so a recomputed task repeats it.  Keys may have any
type that casts to text; equal numbers of different integer types draw alike.
``arithmetic_draw`` is plain integer arithmetic (any SQL engine can repeat it);
``hash_draw`` uses xxhash64 and is the better choice for real sampling.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers of the arithmetic draw for its successive arguments.
STEPS = (7919, 104729, 1299709)


def key_number(part: Column) -> Column:
    """A whole number as itself, any other key as the first 32 bits of the MD5 of its text, null as 0."""
    text = part.cast("string")
    return F.coalesce(text.try_cast("long"), F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(0))


def arithmetic_draw(modulus: Column | int, seed: int, *parts: Column) -> Column:
    """Integer in ``0 .. modulus - 1``; null where the modulus is not positive."""
    m = F.lit(modulus) if isinstance(modulus, int) else modulus
    mixed = F.lit(seed).cast("long")
    for step, part in zip(STEPS, parts):
        mixed = mixed + key_number(part) * F.lit(step)
    return F.when(m > 0, F.pmod(mixed, F.greatest(m.cast("long"), F.lit(1)))).cast("long")


def hash_draw(modulus: Column | int, seed: int, *parts: Column) -> Column:
    """As ``arithmetic_draw``, from a 64-bit hash."""
    m = F.lit(modulus) if isinstance(modulus, int) else modulus
    mixed = F.xxhash64(F.lit(seed), *[p.cast("string") for p in parts])
    return F.when(m > 0, F.pmod(mixed, F.greatest(m.cast("long"), F.lit(1)))).cast("long")


DRAWS = {"arithmetic": arithmetic_draw, "hash": hash_draw}


def skip_seen(rank: Column, seen: Column) -> Column:
    """The ``rank``-th (1-based) positive integer that is not in ``seen`` (a bounded sequence)."""
    ordered = F.array_sort(F.array_distinct(F.filter(seen, lambda x: x > 0)))
    return F.aggregate(ordered, rank.cast("long"), lambda acc, x: F.when(x.cast("long") <= acc, acc + 1).otherwise(acc))


def unseen_item(item_count: int, seen: Column, seed: int, *parts: Column, draw: str = "arithmetic") -> Column:
    """One item from ``1 .. item_count`` outside ``seen``; null if ``seen`` covers all of them."""
    left = F.lit(item_count) - F.size(F.array_distinct(F.filter(seen, lambda x: x > 0)))
    return skip_seen(DRAWS[draw](left, seed, *parts) + 1, seen)


def any_item(item_count: int, seed: int, *parts: Column, draw: str = "arithmetic") -> Column:
    """One item from ``1 .. item_count``."""
    return DRAWS[draw](item_count, seed, *parts) + 1


def shuffle_key(identity: Column, seed: int, epoch: int = 0, draw: str = "hash") -> Column:
    """Sort key of a seeded permutation; ties are broken by ``identity`` itself."""
    if draw == "hash":
        return F.xxhash64(F.lit(seed), F.lit(epoch), identity.cast("string"))
    return arithmetic_draw(1_000_003, seed + epoch, identity)
