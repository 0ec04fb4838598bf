"""Scoring every user against every item without a user x item table.

Items are numbered by falling length of their vectors and cut into blocks of consecutive numbers, sized by
bytes; users fall into shards.  By Cauchy-Schwarz no item of a block scores more than the user's length times
the block's largest, and blocks come in falling order of it: a user visits only the first blocks, up to the
last one that can still reach the score in question (the k-th best of the first block, or the user's lowest
target).  Each (block, shard) cell receives its item vectors, then user by user the seen items (as bitmaps),
targets and the vector; one pass over the sorted cell multiplies small matrices and emits either the best
``k`` items or, for given targets, how many items beat them.  Shuffled rows are the blocks that users visit
and ``items * shards``; both factors are bounded (at most BLOCKS blocks, unless BLOCK_BYTES makes it more), so
the shuffle grows with the tables and not with their product.  A task holds one item block, scores of a few
users and the bits of one user.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.vectors import dot
from pathloom.operators.skew import frequent_keys, global_index, lookup, row_index
from pathloom.session import save_shared, slots

BLOCK_BYTES = 32 << 20  # of item vectors in one block
BLOCKS = 24  # that items are cut into, while they hold no more than that
LEAST_BLOCK = 1024  # items, where the caller names no number
SCORE_BYTES = 8 << 20  # of the scores of the users taken together
USER_CHUNK = 256  # of them at most
# Scores are compared after rounding to this many places, so copies of a vector tie.
SCORE_PLACES = 9
_BITS = 32_768  # of one bitmap

_ITEM, _SEEN, _TARGET, _USER = 0, 1, 2, 3


def _length(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


class ItemBlocks:
    """The item table numbered by falling vector length, its blocks and their bounds.

    ``items(item_id, vector)``; ids are positive, however far apart.  ``block`` is the least number of items in
    a block; more of them share one where there would be more than BLOCKS blocks that BLOCK_BYTES can hold.
    """

    def __init__(self, items: DataFrame, block: int | None = None):
        known = row_index(items.filter((F.col("item_id") > 0) & F.col("vector").isNotNull()).select("item_id", "vector"), "_number")
        length = _length("vector")
        count, width, least, most = known.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.min(length), F.max(length)).first()
        fit = max(1, BLOCK_BYTES // (8 * max(width or 1, 1)))
        self.count, self.block = count, max(block or min(LEAST_BLOCK, fit), min(fit, -(-count // BLOCKS)))
        #: All vectors are about equally long: no bound can skip a block, and any order does.
        self.even = not count or count <= self.block or least >= 0.9 * most
        if self.even:
            self.table, self.bounds = known, [most] * -(-count // self.block)
        else:
            measured = known.select("item_id", "vector", length.alias("_length"))
            self.table = global_index(measured, [F.col("_length").desc(), F.col("item_id")], "_number")
            bounds = self.table.groupBy(self.home(F.col("_number")).alias("b")).agg(F.max("_length").alias("m")).collect()  # one row a block
            self.bounds = [r["m"] for r in sorted(bounds)]

    def home(self, number: Column) -> Column:
        return F.floor((number - 1) / self.block).cast("int")

    def reached(self, length: Column, score: Column) -> Column:
        """How many blocks hold items that may score ``score`` or more for a user vector of this length."""
        slack = 2 * 10.0**-SCORE_PLACES
        bounds = F.lit(self.bounds).cast("array<double>")
        return F.size(F.filter(bounds, lambda m: m * length * (1 + 1e-12) + slack >= score))


def seen_bits(seen: DataFrame, users: DataFrame, items: ItemBlocks) -> DataFrame:
    """``user_id, block, first, bits, n``: the ``n`` seen items of the given users as bitmaps over item numbers.

    A bitmap has a fixed size, however many items a user has seen; ``first`` is the place in the block of its
    first bit.  Few items are a list of 16-bit places instead, shorter than a bitmap.
    """
    pairs = seen.select("user_id", "item_id").join(users.select("user_id"), "user_id", "left_semi")
    # Spark splits the partition of an item that very many users have seen (its skew join).
    placed = pairs.join(items.table.select("item_id", "_number"), "item_id")
    place = F.pmod(F.col("_number") - 1, F.lit(items.block))
    first = (F.floor(place / _BITS) * _BITS).cast("int")
    cut = placed.select("user_id", items.home(F.col("_number")).alias("block"), first.alias("first"), (place - first).cast("int").alias("bit"))
    # Places are gathered, not bitmaps: a map task meets a user with few items of each.
    sets = cut.groupBy("user_id", "block", "first").agg(F.collect_set("bit").alias("places"))
    kind = sets.schema["user_id"].dataType.simpleString()
    return sets.mapInArrow(_packed_bits, f"user_id {kind}, block int, first int, bits binary, n long")


def _packed_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places 0 .. _BITS - 1 as a bitmap, or as a list where that is shorter."""
    for rows in batches:
        size = rows.column("places").value_lengths().to_numpy()
        ends = np.concatenate(([0], np.cumsum(size)))
        flat = rows.column("places").flatten().to_numpy().astype(np.uint16)
        bits = [flat[a:b].tobytes() if 2 * (b - a) < _BITS // 8 else _bitmap(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(bits, pa.binary()), pa.array(size.astype(np.int64))], names=["user_id", "block", "first", "bits", "n"])


def _bitmap(places: np.ndarray) -> bytes:
    marks = np.zeros(_BITS, bool)
    marks[places] = True
    return np.packbits(marks, bitorder="little").tobytes()


def _cells(items: ItemBlocks, users: DataFrame, bits: DataFrame | None, targets: DataFrame | None, first: int = 0, blocks: int | None = None) -> DataFrame:
    """Rows of the cells of ``blocks`` blocks from ``first`` on, sorted so that a cell reads: items, then per user
    seen, targets, vector.  ``users(user_id, vector, _last)`` and ``targets`` visit the blocks before ``_last``.
    """
    spark = users.sparkSession
    blocks = len(items.bounds) - first if blocks is None else blocks
    parts = slots(spark)
    shards = max(1, -(-2 * parts // max(blocks, 1)))
    kind = users.schema["user_id"].dataType
    shard = F.pmod(F.xxhash64("user_id"), F.lit(shards)).cast("int")
    end = F.least(F.col("_last"), F.lit(first + blocks))
    visited = F.explode(F.when(end > first, F.sequence(F.lit(first), end - 1)))
    none = F.lit(None)

    def row(df: DataFrame, what: int, block, at, user, number, item, vector, score, mask) -> DataFrame:
        return df.select(
            block.cast("int").alias("block"), at.cast("int").alias("shard"), user.cast(kind).alias("user_id"), F.lit(what).alias("kind"),
            number.cast("int").alias("place"), item.cast("long").alias("item"), vector.cast("array<double>").alias("vector"),
            score.cast("double").alias("score"), mask.cast("binary").alias("bits"),
        )

    home = items.home(F.col("_number"))
    own = items.table.filter((home >= first) & (home < first + blocks)).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    place = F.pmod(F.col("_number") - 1, F.lit(items.block))
    rows = row(own, _ITEM, home, F.col("_s"), none, place, F.col("item_id"), F.col("vector"), none, none)
    rows = rows.unionByName(row(users.withColumn("_b", visited), _USER, F.col("_b"), shard, F.col("user_id"), none, none, F.col("vector"), none, none))
    if bits is not None:
        near = bits.filter((F.col("block") >= first) & (F.col("block") < first + blocks))
        rows = rows.unionByName(row(near, _SEEN, F.col("block"), shard, F.col("user_id"), F.col("first"), none, none, none, F.col("bits")))
    if targets is not None:
        rows = rows.unionByName(
            row(targets.withColumn("_b", visited), _TARGET, F.col("_b"), shard, F.col("user_id"), none, F.col("item_id"), none, F.col("target_score"), none)
        )
    return rows.repartition(max(1, min(blocks * shards, 4 * parts)), "block", "shard").sortWithinPartitions(
        "block", "shard", F.col("user_id").asc_nulls_first(), "kind"
    )


def _matrix(column: pa.ListArray, rows: np.ndarray) -> np.ndarray:
    """The vectors at ``rows`` as one matrix."""
    return column.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1)


class _Cell:
    """The state of one (block, shard) cell while its rows stream by."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids = self.matrix = None
        self.seen: dict = {}
        self.targets: dict = {}

    def add(self, rows: pa.RecordBatch) -> np.ndarray:
        """Take in items, seen bits and targets; return the places of the user rows."""
        kinds = rows.column("kind").to_numpy()
        fresh, known, wanted, ready = (np.flatnonzero(kinds == k) for k in (_ITEM, _SEEN, _TARGET, _USER))

        def at(name: str, which: np.ndarray) -> pa.Array:
            return rows.column(name).take(pa.array(which))

        if len(fresh):
            self.parts.append((at("place", fresh).to_numpy(), at("item", fresh).to_numpy(), _matrix(rows.column("vector"), fresh)))
        for user, place, bits in zip(at("user_id", known).to_pylist(), at("place", known).to_pylist(), at("bits", known).to_pylist(), strict=True):
            self.seen.setdefault(user, []).append((place, bits))
        for user, item, score in zip(at("user_id", wanted).to_pylist(), at("item", wanted).to_pylist(), at("score", wanted).to_pylist(), strict=True):
            self.targets.setdefault(user, []).append((item, score))
        return ready

    def forget(self, rows: pa.RecordBatch) -> None:
        """Users come in order: what is kept of those before the last one is not needed again."""
        last = rows.column("user_id")[rows.num_rows - 1].as_py()
        self.seen = {u: v for u, v in self.seen.items() if u == last}
        self.targets = {u: v for u, v in self.targets.items() if u == last}

    def _free(self, user) -> np.ndarray | None:
        known = self.seen.pop(user, None)
        if known is None:
            return None
        free = np.ones(len(self.ids), bool)
        for place, bits in known:
            if len(bits) < _BITS // 8:
                free[place + np.frombuffer(bits, np.uint16).astype(np.int64)] = False
                continue
            mask = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)[: len(free) - place]
            free[place : place + len(mask)] = ~mask
        return free

    def scored(self, rows: pa.RecordBatch, ready: np.ndarray) -> Iterator[tuple]:
        """(user, candidate ids, their scores) for each user row."""
        if not len(ready) or not self.parts and self.matrix is None:
            return
        if self.matrix is None:  # all items of a cell come before its first user
            places = np.concatenate([p for p, _, _ in self.parts])
            where = np.empty(len(places), np.int64)
            where[np.argsort(places)] = np.arange(len(places))
            self.ids = np.empty(len(places), np.int64)
            vectors, done = np.empty((len(places), self.parts[0][2].shape[1])), 0
            while self.parts:  # each part is given up as it is copied
                _, ids, part = self.parts.pop()
                spot = where[len(where) - done - len(ids) : len(where) - done]
                self.ids[spot], vectors[spot] = ids, part
                done += len(ids)
            self.matrix = vectors.T
        together = max(1, min(USER_CHUNK, SCORE_BYTES // (8 * len(self.ids))))
        for start in range(0, len(ready), together):
            chunk = ready[start : start + together]
            scores = _matrix(rows.column("vector"), chunk) @ self.matrix
            np.round(scores, SCORE_PLACES, out=scores)
            for user, line in zip(rows.column("user_id").take(pa.array(chunk)).to_pylist(), scores, strict=True):
                free = self._free(user)
                yield (user, self.ids, line) if free is None else (user, self.ids[free], line[free])


# One user's result in one cell: equally long columns.
Emit = Callable[[_Cell, object, np.ndarray, np.ndarray], list]


def _sweep(emit: Emit, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, at = _Cell(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.stack([batch.column(c).to_numpy() for c in ("block", "shard")], axis=1)
            starts = np.flatnonzero(np.any(places[1:] != places[:-1], axis=1)) + 1
            users, out = [], []
            for first, end in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                if tuple(places[first]) != at:
                    cell, at = _Cell(), tuple(places[first])
                rows = batch.slice(first, end - first)
                for found in cell.scored(rows, cell.add(rows)):
                    out.append(emit(cell, *found))
                    users.append(found[0])
                cell.forget(rows)
            if out:
                owner = pa.array(users, batch.schema.field("user_id").type).take(pa.array(np.repeat(np.arange(len(users)), [len(o[0]) for o in out])))
                yield pa.RecordBatch.from_arrays([owner, *[pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]], names=columns)

    return run


def _best(k: int) -> Emit:
    def emit(cell: _Cell, user, ids: np.ndarray, scores: np.ndarray) -> list:
        if len(scores) > k:
            limit = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = scores >= limit  # keeps ties at the limit, so the id order can decide
            ids, scores = ids[near], scores[near]
        order = np.lexsort((ids, -scores))[:k]
        return [ids[order], scores[order]]

    return emit


def _beaten(cell: _Cell, user, ids: np.ndarray, scores: np.ndarray) -> list:
    targets = cell.targets.pop(user, [])
    counts = np.zeros((4, len(targets)), "int64")
    for n, (item, score) in enumerate(targets):
        other = ids != item
        same = (scores == score) & other
        counts[:, n] = (item, ((scores > score) & other).sum(), (same & (ids < item)).sum(), same.sum())
    return list(counts)


def full_sort_scores(
    users: DataFrame, items: DataFrame | ItemBlocks, k: int, seen: DataFrame | None = None, block: int | None = None,
    bits: DataFrame | None = None,
) -> DataFrame:
    """``user_id, item_id, score``: at most ``k`` items of each item block for every user, the overall ``k``
    best among them (see ``top_k_items``).

    ``users(user_id, vector)``, ``seen(user_id, item_id)`` to leave out, or its ``seen_bits``.
    """
    known = items if isinstance(items, ItemBlocks) else ItemBlocks(items, block)
    kind = users.schema["user_id"].dataType.simpleString()
    sweep = _sweep(_best(k), ["user_id", "item_id", "score"])
    schema = f"user_id {kind}, item_id long, score double"
    everyone = users.select("user_id", "vector").withColumn("_last", F.lit(len(known.bounds)))
    if bits is None and seen is not None:
        bits = seen_bits(seen, users, known)
        bits = bits if known.even else save_shared(bits, "seen-bits")
    if known.even:
        return _cells(known, everyone, bits, None).mapInArrow(sweep, schema)
    # The block of the longest vectors comes first; its k-th best score bounds what other blocks may add.
    first = save_shared(_cells(known, everyone, bits, None, blocks=1).mapInArrow(sweep, schema), "first-block")
    worst = first.groupBy("user_id").agg(F.min("score").alias("_worst"), F.count(F.lit(1)).alias("_n"))
    score = F.when(F.col("_n") >= k, F.col("_worst")).otherwise(F.lit(float("-inf")))
    wanting = users.select("user_id", "vector").join(worst, "user_id", "left").withColumn("_last", known.reached(_length("vector"), score))
    rest = _cells(known, wanting.select("user_id", "vector", "_last"), bits, None, first=1)
    return first.unionByName(rest.mapInArrow(sweep, schema))


def target_scores(users: DataFrame, items: DataFrame, targets: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """``target_score`` of each distinct (user, target), minus infinity if it is suppressed or has no vector, and ``user_length``."""
    pairs = targets.select("user_id", "item_id").distinct()
    # A popular item may be the target of a large share of all users, so both joins are skew-aware.
    hot_users, hot_items = frequent_keys(pairs, "user_id"), frequent_keys(pairs, "item_id")
    scored = lookup(pairs, items.select("item_id", F.col("vector").alias("_i")), "item_id", "left", frequent=hot_items)
    scored = lookup(scored, users.select("user_id", F.col("vector").alias("_u")), "user_id", "inner", frequent=hot_users)
    # A target without a vector ranks behind all candidates, as a suppressed one does.
    score = F.when(F.col("_i").isNull(), F.lit(float("-inf"))).otherwise(F.round(dot(F.col("_u"), F.col("_i")), SCORE_PLACES))
    length = _length("_u").alias("user_length")
    if seen is None:
        return scored.select("user_id", "item_id", score.alias("target_score"), length)
    known = seen.select("user_id", "item_id").distinct().withColumn("_seen", F.lit(True))
    score = F.when(F.col("_seen"), F.lit(float("-inf"))).otherwise(score)
    return scored.join(known, ["user_id", "item_id"], "left").select("user_id", "item_id", score.alias("target_score"), length)


def target_rank(
    users: DataFrame, items: DataFrame | ItemBlocks, targets: DataFrame, seen: DataFrame | None = None, block: int | None = None,
    bits: DataFrame | None = None,
) -> DataFrame:
    """Rank of each target among the user's candidates, by counting the items that beat it.

    ``rank`` breaks ties by item id, ``avg_rank`` averages them, ``candidates`` is the number
    of items not suppressed.  Nothing is sorted and no candidate is shuffled; a user and a target visit only
    blocks that hold items long enough to reach the target's score.
    """
    known = items if isinstance(items, ItemBlocks) else ItemBlocks(items, block)
    kind = users.schema["user_id"].dataType.simpleString()
    if seen is not None and bits is None:  # read twice below
        seen = seen.select("user_id", "item_id").join(users.select("user_id"), "user_id", "left_semi")
        seen = save_shared(seen.distinct(), "seen")
    scored = target_scores(users, known.table, targets, seen)
    behind = F.col("target_score") == float("-inf")  # behind every candidate, without a look at them
    last = F.when(behind, 0).otherwise(known.reached(F.col("user_length"), F.col("target_score"))).cast("int")
    scored = save_shared(scored.withColumn("_last", last).drop("user_length"), "target-scores")
    visiting = users.select("user_id", "vector").join(scored.groupBy("user_id").agg(F.max("_last").alias("_last")), "user_id")
    if bits is None and seen is not None:
        bits = save_shared(seen_bits(seen, visiting, known), "seen-bits")
    cells = _cells(known, visiting, bits, scored)
    names = ["better", "before", "equal"]
    counts = cells.mapInArrow(
        _sweep(_beaten, ["user_id", "item_id", *names]), f"user_id {kind}, item_id long, " + ", ".join(f"{n} long" for n in names)
    )
    zeros = [F.lit(0).cast("long").alias(n) for n in names]
    asked = scored.select("user_id", F.col("item_id").cast("long").alias("item_id"), *zeros, behind.alias("behind"))
    totals = counts.withColumn("behind", F.lit(False)).unionByName(asked).groupBy("user_id", "item_id")
    totals = totals.agg(*[F.sum(n).alias(n) for n in names], F.max("behind").alias("behind"))
    if bits is None:
        free = totals.withColumn("candidates", F.lit(known.count).cast("long"))
    else:
        met = bits.groupBy("user_id").agg(F.sum("n").alias("_met"))
        free = totals.join(met, "user_id", "left").withColumn("candidates", F.lit(known.count) - F.coalesce("_met", F.lit(0)))
    better = F.when(F.col("behind"), F.col("candidates")).otherwise(F.col("better"))
    return free.select(
        "user_id", "item_id", (better + F.col("before") + 1).alias("rank"), (better + 1 + F.col("equal") / 2).alias("avg_rank"), "candidates"
    )


def mean_rank(ranked_targets: DataFrame) -> DataFrame:
    """Per user: sum of the targets' average ranks, candidate count, number of targets."""
    return ranked_targets.groupBy("user_id").agg(
        F.sum("avg_rank").alias("pos_rank_sum"),
        F.max("candidates").alias("candidates"),
        F.count(F.lit(1)).alias("positives"),
    )
