"""Contrastive evaluation against the pool of negatives of each batch, however large the batch.

Input: one row per example, ``batch_id, example_id, output, positive`` (vectors) and ``negative`` (one vector) or
``negatives`` (any number of them).  Every example meets all negatives of its batch; examples and negatives of a
batch fall into tiles, a task multiplies one tile of each as a small matrix product, and per example and tile
only mergeable sums leave it: kept and better negatives, the best similarity, the sum of exponentials.  Rows
that a mask takes out of the loss keep their negatives in the pool.

Vectors that several examples share may stand in a table of their own, ``id, vector``, and the examples name them by
id: rows then travel as ids, and a vector goes once to each part of the batches that names it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType

from pathloom.operators.skew import lookup
from pathloom.session import slots

# Logit scale, similarity above which a negative is dropped, reported ranks.
LOGIT_SCALE = 20.0
SAME_ITEM_COSINE = 0.99
ACCURACY_RANKS = (1, 5, 10, 50, 100)

TILE = 2048  # examples or negatives in one product
TASK_ROWS = 1 << 17  # rows of cells, copies included, that one task sorts
VECTOR_BYTES = 1 << 26  # vectors that the rows of one part name, counted once for each row
OUT_ROWS = 4096  # examples that leave a task together
_VECTOR, _NEGATIVE, _EXAMPLE = -1, 0, 1
_PARTIAL = "batch_id long, example_id long, negatives long, kept long, best double, mass double, pos double, better long"


def _matrix(column: pa.Array) -> np.ndarray:
    if column.null_count:
        raise ValueError("a vector is null or not in the table")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix.astype(np.float64, copy=False)
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _cells(examples: DataFrame, pool: DataFrame, tile: int) -> tuple[DataFrame, int, int]:
    """Rows of all (batch, example tile, negative tile) cells, how many there are, and how many vectors they hold.

    A batch of up to ``tile`` rows, or a 64th of a task's, is one cell; the others are cut by a hash, each example
    copied once for each tile of negatives and the other way round.
    """
    sizes = examples.groupBy("batch_id").count().withColumn("_kind", F.lit(_EXAMPLE))
    sizes = sizes.unionByName(pool.groupBy("batch_id").count().withColumn("_kind", F.lit(_NEGATIVE)))
    own = {k: F.coalesce(F.sum(F.when(F.col("_kind") == k, F.col("count"))), F.lit(0)) for k in (_EXAMPLE, _NEGATIVE)}
    sizes = sizes.groupBy("batch_id").agg(own[_EXAMPLE].alias("_e"), own[_NEGATIVE].alias("_n"))
    whole = F.greatest("_e", "_n") <= max(tile, TASK_ROWS // 64)
    cut = {c: F.greatest(F.ceil(F.col(n) / tile), F.lit(1)) for c, n in (("_et", "_e"), ("_nt", "_n"))}
    sizes = sizes.withColumns({c: F.when(whole, 1).otherwise(n).cast("int") for c, n in cut.items()})
    left, right = F.col("_e") * F.col("_nt"), F.col("_n") * F.col("_et")
    rows, held, some = sizes.agg(F.sum(left + right), F.sum(2 * left + right), F.max((F.col("_et") + F.col("_nt") > 2).cast("int"))).first()
    counts = sizes.filter("_et + _nt > 2").select("batch_id", "_et", "_nt") if some else None

    def placed(rows: DataFrame, kind: int, key) -> DataFrame:
        zero = F.lit(0)
        if counts is None:
            return rows.select("batch_id", zero.alias("et"), zero.alias("nt"), F.lit(kind).alias("kind"), "example_id", "a", "b")
        own, other = ("_et", "_nt") if kind == _EXAMPLE else ("_nt", "_et")
        spread = rows.join(counts, "batch_id", "left")
        mine = F.pmod(key, F.coalesce(F.col(own), F.lit(1)))
        copies = F.explode(F.sequence(zero, F.coalesce(F.col(other), F.lit(1)) - 1))
        spread = spread.withColumn("_mine", mine.cast("int")).withColumn("_copy", copies)
        et, nt = ("_mine", "_copy") if kind == _EXAMPLE else ("_copy", "_mine")
        return spread.select("batch_id", F.col(et).alias("et"), F.col(nt).alias("nt"), F.lit(kind).alias("kind"), "example_id", "a", "b")

    none = F.lit(None).cast(examples.schema["positive"].dataType)
    left = placed(examples.select("batch_id", "example_id", F.col("output").alias("a"), F.col("positive").alias("b")), _EXAMPLE, F.xxhash64("example_id"))
    right = pool.select("batch_id", "example_id", F.col("negative").alias("a"), none.alias("b"), "_no")
    right = placed(right, _NEGATIVE, F.xxhash64("example_id", "_no"))
    return left.unionByName(right), rows or 0, held or 0


def _tiles(examples: DataFrame, pool: DataFrame, tile: int) -> DataFrame:
    """The cells with their vectors, each cell in one task, negatives before examples."""
    cells, rows, _ = _cells(examples, pool, tile)
    # The number is set so that Spark does not merge small but compute-heavy partitions; it follows the rows.
    parts = max(2 * slots(examples.sparkSession), -(-rows // TASK_ROWS))
    return cells.repartition(parts, "batch_id", "et", "nt").sortWithinPartitions("batch_id", "et", "nt", "kind")


def _named_tiles(examples: DataFrame, pool: DataFrame, tile: int, vectors: DataFrame) -> DataFrame:
    """The cells with ids, dealt to parts of one task each; before the cells of a part come the vectors it names.

    Each vector comes once, however many rows of the part name it; so a frequent one has at most one row for each part.
    """
    cells, rows, held = _cells(examples, pool, tile)
    kind = vectors.schema["vector"].dataType
    width = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    size = max(width, 1) * (4 if kind == ArrayType(FloatType()) else 8)
    parts = max(slots(examples.sparkSession), -(-rows // TASK_ROWS), -(-held * size // VECTOR_BYTES))
    cells = cells.withColumn("part", F.pmod(F.xxhash64("batch_id", "et", "nt"), F.lit(parts)).cast("int"))
    named = cells.select("part", F.explode(F.array("a", "b")).alias("id")).filter(F.col("id").isNotNull()).distinct()
    named = lookup(named, vectors, "id", frequent=[])  # an id without a vector stays and fails in the task
    zero, none = F.lit(0), F.lit(None).cast("long")
    named = named.select(
        zero.cast("long").alias("batch_id"), zero.alias("et"), zero.alias("nt"), F.lit(_VECTOR).alias("kind"),
        F.col("id").alias("example_id"), none.alias("a"), none.alias("b"), "part", "vector",
    )
    placed = cells.withColumn("vector", F.lit(None).cast(kind)).unionByName(named).repartitionById(parts, "part")
    return placed.sortWithinPartitions("part", F.col("kind") > _VECTOR, "batch_id", "et", "nt", "kind").drop("part")


class _Vectors:
    """Vectors of one part by id."""

    def __init__(self, chunks: list[tuple[np.ndarray, np.ndarray]]):
        ids = np.concatenate([c[0] for c in chunks])
        self.order = np.argsort(ids)
        self.ids, self.rows = ids[self.order], np.concatenate([c[1] for c in chunks])

    def of(self, column: pa.Array) -> np.ndarray:
        wanted = column.to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(self.ids, wanted), len(self.ids) - 1)
        if not np.array_equal(self.ids[at], wanted):
            raise ValueError("an example names no vector")
        return self.rows[self.order[at]]


def _products(scale: float, threshold: float, tile: int):
    def summed(rows: pa.RecordBatch, output: np.ndarray, positive: np.ndarray, pool: np.ndarray) -> pa.RecordBatch:
        pos = (output * positive).sum(axis=1)
        kept, better = np.zeros((2, len(pos)), dtype=np.int64)
        best, mass = np.full(len(pos), -np.inf), np.zeros(len(pos))
        for some in (slice(i, i + tile) for i in range(0, len(pos), tile)):
            for part in (pool[i : i + tile] for i in range(0, len(pool), tile)):
                keep = ~(positive[some] @ part.T > threshold)
                sims = np.where(keep, output[some] @ part.T, -np.inf)
                kept[some] += keep.sum(axis=1)
                best[some] = np.maximum(best[some], sims.max(axis=1))
                mass[some] += np.exp(scale * (sims - 1)).sum(axis=1)
                better[some] += (sims > pos[some, None]).sum(axis=1)
        return pa.RecordBatch.from_arrays(
            [rows.column("batch_id"), rows.column("example_id"), pa.array(np.full(len(pos), len(pool))), pa.array(kept),
             pa.array(best, mask=np.isinf(best)), pa.array(mass), pa.array(pos), pa.array(better)],
            names=["batch_id", "example_id", "negatives", "kept", "best", "mass", "pos", "better"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, pool, chunks, held, done = None, [], (), [], None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("batch_id", "et", "nt", "kind")], axis=1)
            starts = np.flatnonzero(np.any(places[1:] != places[:-1], axis=1)) + 1
            for first, end in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                cell, kind = tuple(places[first, :3]), places[first, 3]
                rows = batch.slice(first, end - first)
                if kind == _VECTOR:  # all vectors of a part come before its first cell
                    at, held = None, None
                    chunks.append((rows.column("example_id").to_numpy(), _matrix(rows.column("vector"))))
                    continue
                if chunks:
                    held, chunks = _Vectors(chunks), []
                if cell != at:
                    at, parts, pool = cell, [], ()
                read = _matrix if held is None else held.of
                if kind == _NEGATIVE:
                    parts.append(_unit(read(rows.column("a"))))
                    continue
                if parts:  # all negatives of a cell come before its first example
                    pool, parts = np.concatenate(parts), []
                done.append(summed(rows, _unit(read(rows.column("a"))), _unit(read(rows.column("b"))), pool))
                if sum(d.num_rows for d in done) >= OUT_ROWS:
                    yield pa.concat_batches(done)
                    done = []
        if done:
            yield pa.concat_batches(done)

    return run


def _entry_type(examples: DataFrame) -> DataType:
    """The type of the negatives' entries."""
    many = "negatives" in examples.columns
    kind = examples.schema["negatives" if many else "negative"].dataType.elementType
    return kind.elementType if many else kind


def batch_negatives(
    examples: DataFrame, scale: float = LOGIT_SCALE, threshold: float = SAME_ITEM_COSINE, mask: str | None = None, tile: int = TILE,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Per example: negatives in the batch, negatives kept after dropping those too similar to the
    positive, best kept similarity, scaled positive logit, cross-entropy, rank of the positive.

    ``mask`` names a column that is true (or 1) for examples with a loss; the others only give negatives.
    ``vectors`` is the table of ``id, vector``, unique by id, if the examples hold ids; both are read several times.
    """
    if not 0 < scale <= 300:
        raise ValueError(f"scale must be in (0, 300], got {scale}")  # beyond, exponentials of whole similarities vanish
    ids = [F.col(c).cast("long").alias(c) for c in ("batch_id", "example_id")]
    given = F.col("negatives") if "negatives" in examples.columns else F.array("negative")
    # Vectors of floats travel as they are and become doubles in the task.
    if vectors is None:
        narrow = all(examples.schema[c].dataType == ArrayType(FloatType()) for c in ("output", "positive")) and _entry_type(examples) == FloatType()
        kind = "array<float>" if narrow else "array<double>"
    else:
        kind = "long"
        if vectors.schema["vector"].dataType != ArrayType(FloatType()):
            vectors = vectors.withColumn("vector", F.col("vector").cast("array<double>"))
        vectors = vectors.select(F.col("id").cast("long").alias("id"), "vector")
    pool = examples.select(*ids, F.posexplode(given.cast(f"array<{kind}>")).alias("_no", "negative"))
    scored = examples.filter(F.col(mask).cast("boolean")) if mask else examples
    scored = scored.select(*ids, *[F.col(c).cast(kind).alias(c) for c in ("output", "positive")])
    tiles = _tiles(scored, pool, tile) if vectors is None else _named_tiles(scored, pool, tile, vectors)
    parts = tiles.mapInArrow(_products(scale, threshold, tile), _PARTIAL)
    total = parts.groupBy("batch_id", "example_id").agg(
        *[F.sum(c).alias(c) for c in ("negatives", "kept", "mass", "better")], F.max("best").alias("best_negative"), F.max("pos").alias("pos")
    )
    loss = F.log(F.exp(scale * (F.col("pos") - 1)) + F.col("mass")) + scale - scale * F.col("pos")
    return total.select(
        "batch_id", "example_id", "negatives", "kept", "best_negative", (scale * F.col("pos")).alias("pos_logit"), loss.alias("loss"),
        (F.col("better") + 1).alias("pos_rank"),
    )


def contrastive_eval(
    examples: DataFrame, scale: float = LOGIT_SCALE, threshold: float = SAME_ITEM_COSINE, mask: str | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """``metric, value``: loss, mean candidate count, and top-k accuracy over batches wide enough for k."""
    summary = batch_negatives(examples, scale, threshold, mask, vectors=vectors)
    wide = {k: F.col("negatives") + 1 >= k for k in ACCURACY_RANKS}
    totals = summary.agg(
        F.avg("loss").alias("loss"),
        F.avg(F.col("kept") + 1).alias("nce_samples"),
        *[F.avg(F.when(wide[k], (F.col("pos_rank") <= k).cast("int"))).alias(f"nce_top{k}_acc") for k in ACCURACY_RANKS],
    )
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in totals.columns]
    return totals.select(F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())
