"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become integers ``floor(scale * c)``; each distinct integer vector counts once.  The distinct
vectors are packed into blocks and written; every product of the covariance with a thin matrix is one pass
over them, ``sum(Xc' (Xc Q)) / n`` with ``Xc`` the centred rows, of which only a matrix of the size of Q
leaves each task.  A polynomial of such products, by the three-term recurrence of Chebyshev polynomials,
damps the part of the spectrum that is not wanted; QR and Rayleigh-Ritz follow, until the residuals of the
wanted pairs certify them.  The block has spare directions and is doubled where it does not settle (at the
latest it holds all dimensions, and Rayleigh-Ritz alone is exact).

Cases: null vectors and vectors with null or non-finite entries are dropped; vectors of another length
than the most frequent one (of two equally frequent ones the longer) keep their rows, with null
``deviation`` and ``whitened``, and are not fitted; a component whose eigenvalue is below ``FLAT`` of the
largest has null ``whitened``; vectors without any variance have null ``explained``, and
``identity_error`` is 0 where no component is left; a ``deviation`` beyond 64 bits is null; repeated rows
each get their rows; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.text import batch
from pathloom.session import save_shared

SCALE = 256
SPARE = 12  # directions beyond the wanted ones
DEGREE = 10
LANCZOS = 8  # steps that find the lower end of the spectrum
CERTIFIED = 5e-14  # residual over the largest eigenvalue
ACCEPTED = 1e-11  # the same, where rounding stops it from falling further
ROUNDS = 6  # filters before the block is doubled
FLAT = 1e-13
BLOCK_BYTES = 4 << 20

Product = Callable[[np.ndarray], np.ndarray]


def integers(vector: str, scale: int = SCALE) -> Column:
    """``floor(scale * c)`` of each entry; null for a vector that is null or holds a null or non-finite entry."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(whole, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        if not rows.num_rows:
            continue
        x = _matrix(rows.column("x"))
        step = max(1, BLOCK_BYTES // (8 * x.shape[1]))
        parts = [x[i : i + step] for i in range(0, len(x), step)]
        small = [bool(np.abs(p).max() < 2**31) and bool(p.min() > -(2**31)) for p in parts]
        data = [(p.astype(np.int32) if s else p).tobytes() for p, s in zip(parts, small, strict=True)]
        yield batch(small=pa.array(small), data=pa.array(data, pa.binary()))


class Vectors:
    """The distinct integer vectors of a table, packed and written once."""

    def __init__(self, distinct: DataFrame, dimension: int):
        self.dimension = dimension
        self.blocks = save_shared(distinct.mapInArrow(_packed, "small boolean, data binary"), "whitening-vectors")
        low = (1 << 32) - 1
        # Halves of the integers are summed apart, so no sum leaves 64 bits.
        sums = self.total(lambda x: np.concatenate(([len(x)], (x >> 32).sum(axis=0), (x & low).sum(axis=0))), "long")
        sums = sums if len(sums) else [0] * (2 * dimension + 1)
        self.n = int(sums[0])
        self.sums = [(int(h) << 32) + int(v) for h, v in zip(sums[1 : dimension + 1], sums[dimension + 1 :], strict=True)]
        self.mean = np.array([s / max(self.n, 1) for s in self.sums])

    def total(self, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
        """The sum over all blocks of ``part`` of the block's rows (a vector of fixed length)."""
        dimension = self.dimension

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for rows in batches:
                for small, data in zip(rows.column("small").to_pylist(), rows.column("data"), strict=True):
                    x = np.frombuffer(data.as_buffer(), np.int32 if small else np.int64).reshape(-1, dimension).astype(np.int64)
                    own = part(x)
                    total = own if total is None else total + own
            if total is not None:
                yield batch(part=pa.array([total]))

        parts = self.blocks.mapInArrow(add, f"part array<{kind}>")
        rows = parts.select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()  # a fixed number of rows
        return np.array([r["v"] for r in sorted(rows)])

    def covariance_times(self, q: np.ndarray) -> np.ndarray:
        mean, n = self.mean, self.n

        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return (centred.T @ (centred @ q)).ravel()

        return self.total(part).reshape(q.shape) / n

    def trace(self) -> float:
        mean = self.mean
        return float(self.total(lambda x: np.array([np.square(x - mean).sum()]))[0]) / self.n


def lower_end(times: Product, dimension: int, steps: int = LANCZOS) -> float:
    """A bound near the smallest eigenvalue, from a few Lanczos steps."""
    rng = np.random.default_rng(20_12)
    basis = [rng.normal(size=dimension)]
    basis[0] /= np.linalg.norm(basis[0])
    alpha, beta = [], []
    for _ in range(min(steps, dimension)):
        w = times(basis[-1][:, None])[:, 0]
        alpha.append(basis[-1] @ w)
        for _ in range(2):  # orthogonal to all earlier ones, twice is enough
            w -= np.array(basis).T @ (np.array(basis) @ w)
        beta.append(np.linalg.norm(w))
        if beta[-1] <= 1e-12 * max(abs(a) for a in alpha):
            beta[-1] = 0.0
            break
        basis.append(w / beta[-1])
    line = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1)
    return max(0.0, float(np.linalg.eigvalsh(line)[0]) - float(beta[-1]))


def chebyshev(times: Product, q: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """A polynomial of the matrix times ``q``: at most 1 in [low, high], growing above, 1 at ``top``."""
    half, centre = (high - low) / 2, (high + low) / 2
    first = sigma = half / (top - centre)
    before, now = q, (times(q) - centre * q) * (sigma / half)
    for _ in range(1, degree):
        following = 1 / (2 / first - sigma)
        before, now = now, (times(now) - centre * now) * (2 * following / half) - (sigma * following) * before
        sigma = following
    return now


def leading_pairs(times: Product, dimension: int, wanted: int, spare: int = SPARE, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues (falling), their unit eigenvectors and the largest residual."""
    rng = np.random.default_rng(20_13)
    width = min(dimension, wanted + spare)
    low = lower_end(times, dimension) if width < dimension else 0.0
    q = np.linalg.qr(rng.normal(size=(dimension, width)))[0]
    best, since = np.inf, 0
    while True:
        image = times(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = q @ turn
        residual = np.linalg.norm(image @ turn - vectors * values, axis=0)[:wanted].max()
        top = max(values[0], 0.0)
        stalled = residual <= ACCEPTED * top and residual > best / 4
        if width == dimension or residual <= CERTIFIED * top or stalled:
            return values[:wanted], vectors[:, :wanted], residual
        best, since = min(best, residual), since + 1
        if since > ROUNDS:  # the cluster of close eigenvalues is wider than the block
            more = rng.normal(size=(dimension, min(dimension, 2 * width) - width))
            q, width, since, best = np.linalg.qr(np.concatenate((vectors, more), axis=1))[0], min(dimension, 2 * width), 0, np.inf
            continue
        high = min(max(values[-1], low + 1e-3 * (top - low)), top * (1 - 1e-9))
        q = np.linalg.qr(chebyshev(times, vectors, degree, min(low, high * (1 - 1e-9)), high, top))[0]


def whiten(table: DataFrame, components: int = 4, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), integers(vector, scale).alias("x")).filter("x IS NOT NULL")
    size = F.size("x")
    usual = rows.groupBy(size.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None or usual["d"] == 0:
        return rows.limit(0).selectExpr(*[f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in schema.split(", ")])
    dimension = usual["d"]
    vectors = Vectors(rows.filter(size == dimension).select("x").distinct(), dimension)
    wanted = min(components, dimension)
    values, axes, _ = leading_pairs(vectors.covariance_times, dimension, wanted)
    trace = vectors.trace()
    good = values > FLAT * max(trace, 0.0)
    n, sums, mean = vectors.n, vectors.sums, vectors.mean
    project = axes[:, good] / np.sqrt(values[good])
    kept = int(good.sum())

    def moments(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ project
        return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

    error = 0.0
    if kept:
        both = vectors.total(moments) / n
        error = float(np.abs(both[kept:].reshape(kept, kept) - np.outer(both[:kept], both[:kept]) - np.eye(kept)).max())
    explained = [float(v / trace) if trace > 0 else None for v in values]
    far = max(abs(s) for s in sums)

    def deviations(x: np.ndarray) -> list[int | None]:
        most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + far
        if dimension * most**2 < 2**63:
            return np.square(n * x - np.array(sums, np.int64)).sum(axis=1).tolist()
        exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
        return [e if e < 2**63 else None for e in exact]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            column, m = rows.column("x"), rows.num_rows
            usual_rows = np.flatnonzero(column.value_lengths().to_numpy(zero_copy_only=False) == dimension)
            x = _matrix(column.take(pa.array(usual_rows))) if len(usual_rows) else np.zeros((0, dimension), np.int64)
            whitened = np.full((m, wanted), np.nan)
            whitened[np.ix_(usual_rows, np.flatnonzero(good))] = (x - mean) @ project
            deviation = np.full(m, None, object)
            deviation[usual_rows] = deviations(x)
            yield batch(
                vec_id=rows.column("vec_id").take(pa.array(np.repeat(np.arange(m), wanted))),
                component=pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), m)),
                n=np.full(m * wanted, n, np.int64),
                deviation=pa.array(np.repeat(deviation, wanted), pa.int64()),
                whitened=pa.array(whitened.ravel(), mask=np.isnan(whitened.ravel())),
                explained=pa.array(explained * m, pa.float64()),
                identity_error=np.full(m * wanted, error),
            )

    return rows.mapInArrow(place, schema)
