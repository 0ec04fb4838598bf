"""Exact random splits, shuffles and shards.  No step orders the whole table in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.draws import shuffle_key
from pathloom.functions.permutation import permute
from pathloom.operators.selection import parts_at, selected
from pathloom.operators.skew import global_index


def _size(indexed: DataFrame, index: str = "idx") -> int:
    return indexed.agg(F.max(index)).first()[0] or 0


def shuffle_rows(df: DataFrame, identity: str, seed: int = 42, epoch: int = 0, draw: str = "hash") -> DataFrame:
    """A seeded permutation: ``idx`` is the 1-based place of each row, new for each epoch."""
    keyed = df.withColumn("_key", shuffle_key(F.col(identity), seed, epoch, draw))
    return global_index(keyed, [F.col("_key"), F.col(identity)], "idx").drop("_key")


def shuffle_epoch(indexed: DataFrame, rows: int, seed: int = 42, epoch: int = 0, index: str = "idx", place: str = "place") -> DataFrame:
    """``place``: the rows of one dense index (``row_index``, ``global_index``) in a new order for each epoch.

    A keyed bijection of the index, so an epoch costs one map step; nothing is sorted or exchanged.
    """
    return permute(indexed, rows, seed, epoch, index, place)


def split_rows(
    df: DataFrame, identity: str, train: float = 0.8, valid: float = 0.1, seed: int = 42, draw: str = "hash"
) -> DataFrame:
    """``split``: exactly ``int(n * train)`` train rows, ``int(n * valid)`` valid rows, the rest test.

    The two cuts of the seeded order are selected by counting; rows are labelled where they stand.
    """
    def ends(n: int) -> list[int]:
        return [int(n * train), int(n * train) + int(n * valid)]

    cut = parts_at(df, shuffle_key(F.col(identity), seed, 0, draw), F.col(identity), ends, "_part")
    label = F.when(F.col("_part") == 0, "train").when(F.col("_part") == 1, "valid").otherwise("test")
    return cut.withColumn("split", label).drop("_part")


def complement_split(rows: DataFrame, split: str = "test") -> DataFrame:
    """The rows of ``split_rows`` that no other split took."""
    return rows.filter(F.col("split") == split)


def split_rows_approximately(df: DataFrame, identity: str, train: float = 0.8, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """As ``split_rows`` without a shuffle: each row is assigned by its own hash, sizes are near the shares."""
    share = F.pmod(F.xxhash64(F.lit(seed), F.col(identity)), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("split", F.when(share < train, "train").when(share < train + valid, "valid").otherwise("test"))


def split_users(
    df: DataFrame, ratio: float = 0.8, user: str = "user_id", seed: int = 42, draw: str = "hash"
) -> DataFrame:
    """``half``: 1 for exactly ``int(users * ratio)`` users' rows, else 2; rows without a user are left out."""
    known = df.filter(F.col(user).isNotNull())
    key = shuffle_key(F.col(user), seed, 0, draw)
    users = known.select(user).distinct()
    kind = df.schema[user].dataType
    # The user at the cut is selected among distinct users; rows are then compared with it, not joined.
    cut = selected(users, key, F.col(user), lambda n: int(n * ratio))
    if cut is None:  # a ratio too small for one user
        return known.withColumn("half", F.lit(2))
    here = F.struct(key.alias("_key"), F.col(user).alias("_tie"))
    there = F.struct(F.lit(cut[0]).cast("long").alias("_key"), F.lit(cut[1]).cast(kind).alias("_tie"))
    return known.withColumn("half", F.when(here <= there, 1).otherwise(2))


def restrict_users(df: DataFrame, half: int) -> DataFrame:
    return df.filter(F.col("half") == half).drop("half")


def shard_strided(indexed: DataFrame, shards: int, index: str = "idx") -> DataFrame:
    """``shard``: row i (0-based) goes to shard ``i % shards``."""
    return indexed.withColumn("shard", F.pmod(F.col(index) - 1, F.lit(shards)).cast("int"))


def shard_contiguous(indexed: DataFrame, shards: int, batch: int, index: str = "idx") -> DataFrame:
    """``shard, filler``: equal contiguous shards of whole batches.

    The last row is repeated (at most ``shards * batch`` times) to fill the last shards.
    """
    n = _size(indexed, index)
    per_shard = math.ceil(n / batch / shards) * batch
    missing = per_shard * shards - n
    real = indexed.withColumn("filler", F.lit(False))
    if missing:
        places = F.sequence(F.lit(n + 1).cast("long"), F.lit(n + missing).cast("long"))
        copies = indexed.filter(F.col(index) == n).withColumn(index, F.explode(places))
        real = real.unionByName(copies.withColumn("filler", F.lit(True)))
    return real.withColumn("shard", F.floor((F.col(index) - 1) / max(per_shard, 1)).cast("int"))


def without_fillers(sharded: DataFrame) -> DataFrame:
    return sharded.filter(~F.col("filler")).drop("filler")
