"""A keyed bijection of 0 .. n - 1, so a table with one dense index is shuffled anew without a sort.

A number is written with two digits of radices ``a`` and ``b``, both near the root of n.  Four Feistel
rounds add a keyed function of one digit to the other, which permutes 0 .. a * b - 1; a result of n or more is
sent through again (cycle walking).  How often at most, the driver finds exactly from the fewer than ``a``
numbers beyond n.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIME = 2_147_483_647
FACTOR = 1_103_515_245


def radices(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def round_keys(seed: int, epoch: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}/{epoch}/{i}".encode()).digest()[:4]) % PRIME for i in range(4)]


def _mixed(digit, key: int):
    """A number below PRIME from a digit below 2**31; works on ints, arrays and columns."""
    x = (digit + key) % PRIME
    x = (x * x + key) % PRIME
    return (x * FACTOR + digit) % PRIME


def permuted(x: np.ndarray, a: int, b: int, keys: list[int]) -> np.ndarray:
    left, right = x // b, x % b
    for i, key in enumerate(keys):
        if i % 2:
            right = (right + _mixed(left, key)) % b
        else:
            left = (left + _mixed(right, key)) % a
    return left * b + right


def walks(n: int, keys: list[int]) -> int:
    """The most often a number below n goes through the rounds until it is below n again."""
    a, b = radices(n)
    beyond = np.arange(n, a * b, dtype=np.int64)
    onward = permuted(beyond, a, b, keys)
    now, times = np.setdiff1d(beyond, onward), 1  # those that a number below n is sent to
    while len(now):
        now, times = permuted(now, a, b, keys), times + 1
        now = now[now >= n]
    return times


def permute(df: DataFrame, n: int, seed: int, epoch: int, index: str, place: str) -> DataFrame:
    """``place`` (1-based) of the rows with the dense 1-based ``index``; one map step."""
    a, b = radices(n)
    keys = round_keys(seed, epoch)
    out = df.withColumns({"_at": F.col(index).cast("long") - 1, "_done": F.lit(False)})
    for _ in range(walks(n, keys)):
        out = out.withColumns({"_left": F.expr(f"_at DIV {b}"), "_right": F.col("_at") % b})
        for i, key in enumerate(keys):
            one, other, radix = ("_right", "_left", b) if i % 2 else ("_left", "_right", a)
            out = out.withColumn(one, (F.col(one) + _mixed(F.col(other), key)) % radix)
        walked = F.col("_left") * b + F.col("_right")
        out = out.withColumn("_at", F.when(F.col("_done"), F.col("_at")).otherwise(walked))
        out = out.withColumn("_done", F.col("_at") < n)
    return out.withColumn(place, F.col("_at") + 1).drop("_at", "_left", "_right", "_done")
