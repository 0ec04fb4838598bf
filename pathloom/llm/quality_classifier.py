"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of every whole text (never labels, language, source or id) are standardised over all documents
and mapped to ``features`` random cosines, which approximate a Gaussian kernel.  Each task adds its
labelled rows to the normal equations; only their sum, a matrix of fixed size, reaches the driver.  Raw
scores of the labelled rows are counted in ``BINS`` fixed bins, made monotone by pooling adjacent
violators, and the curve maps every document's raw score to [0, 1].

Cases: null text is empty and is scored like any other; several labels of a document each count, null
labels do not; without labels every score is 0.5; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.tables import texts
from pathloom.llm.text import Slice, batch, byte_class, groups_of, mix, slices
from pathloom.session import save_shared

FEATURES = 256
GAMMA = 0.15  # width of the kernel on standardised statistics
RIDGE = 1e-3  # times the number of labelled rows
BINS = 2000
LOW, HIGH = -0.5, 1.5  # raw scores are counted in this range, both ends open
SHARDS = 64
CLASSES = {
    "symbols": b"#*$%&|<>", "bangs": b"!?", "digits": b"0123456789", "capitals": bytes(range(0x41, 0x5B)),
    "small": bytes(range(0x61, 0x7B)), "stops": b".,;:", "bars": b"|", "breaks": b"\n", "brackets": b"()[]{}", "slashes": b"/\\=_@",
    "foreign": bytes(range(0x80, 0x100)),
}
NAMES = (
    "log_words", "log_bytes", "word_bytes", "word_spread", "long_words", "short_words", "distinct", "repeated", "top_word",
    "line_words", "repeated_lines", "capital_words", *CLASSES,
)


def statistics(docs: Slice) -> np.ndarray:
    """One row of NAMES per document."""
    words, n = docs.words(), docs.n
    size = (words.end - words.start).astype(float)
    count = np.maximum(words.per_doc, 1)
    n_bytes = np.diff(docs.offsets)

    def per_word(values):
        return np.bincount(words.doc, weights=values, minlength=n) / count

    mean = per_word(size)
    spread = np.sqrt(np.maximum(per_word(size**2) - mean**2, 0))
    # Distinct words and the most frequent one, from sorted (document, word) hashes.
    lowered = docs.words(lower=True).hash
    key = lowered ^ mix(words.doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    at, runs = groups_of(key[order])
    owner = words.doc[order[at]] if len(at) else np.zeros(0, np.int64)
    distinct = np.bincount(owner, minlength=n) / count
    top = np.zeros(n)
    np.maximum.at(top, owner, runs)
    first, found = words.windows(4)
    key = found ^ mix(words.doc[first].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    _, runs = groups_of(key[order])
    again = words.cover(first[order[np.repeat(runs > 1, runs)]], 4) if len(first) else np.zeros(len(words), bool)
    totals = {}
    for name, chars in CLASSES.items():
        marks = np.concatenate(([0], np.cumsum(byte_class(chars)[docs.bytes])))
        totals[name] = marks[docs.offsets[1:]] - marks[docs.offsets[:-1]]
    lines = totals["breaks"] + 1
    breaks = docs.bytes == 10
    starts_line = np.concatenate(([True], breaks[:-1])) if len(breaks) else np.zeros(0, bool)
    opening = np.zeros(len(breaks), bool)
    opening[words.start] = True
    capital = byte_class(CLASSES["capitals"])
    capitals = np.concatenate(([0], np.cumsum(capital[docs.bytes])))
    loud = (capitals[words.end] - capitals[words.start]) >= 2
    same_line = np.zeros(n)
    line_start = np.flatnonzero(starts_line & opening)
    if len(line_start):
        of = np.searchsorted(words.start, line_start)
        key = words.hash[of] ^ mix(words.doc[of].astype(np.uint64) + np.uint64(1))
        _, inverse, seen = np.unique(key, return_inverse=True, return_counts=True)
        same_line = np.bincount(words.doc[of], weights=seen[inverse] > 1, minlength=n) / lines
    columns = [
        np.log1p(words.per_doc), np.log1p(n_bytes), mean, spread, per_word(size > 12), per_word(size <= 2), distinct,
        per_word(again), top / count, np.log1p(words.per_doc / lines), same_line, per_word(loud),
        *[np.sqrt(t / np.maximum(n_bytes, 1)) for t in totals.values()],
    ]
    return np.stack(columns, axis=1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for docs in slices(batches):
        table = statistics(docs)
        yield batch(doc_id=docs.rows.column("doc_id"), **{name: table[:, i] for i, name in enumerate(NAMES)})


class _Kernel:
    """Standardised statistics -> random cosines, the last one constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int):
        rng = np.random.default_rng(20_01)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.turn = rng.normal(0, np.sqrt(2 * GAMMA), (len(mean), features))
        self.shift = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, rows: pa.RecordBatch) -> np.ndarray:
        x = np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in NAMES], axis=1)
        x = np.clip((x - self.mean) / self.spread, -6, 6)
        z = np.sqrt(2 / len(self.shift)) * np.cos(x @ self.turn + self.shift)
        return np.concatenate((z, np.ones((len(z), 1))), axis=1)


def _normal_equations(labelled: DataFrame, kernel: _Kernel) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum over tasks of Z'Z, Z'y and the number of labels; matrix rows are summed apart, in two steps."""
    size = FEATURES + 1

    def add(batches):
        total = np.zeros((size, size + 1))
        for rows in batches:
            if rows.num_rows:
                z = kernel(rows)
                n, y = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("labels", "positives"))
                total += z.T @ np.concatenate((z * n[:, None], y[:, None]), axis=1)
                last = rows
        if total.any():
            shard = int(last.column("doc_id")[0].as_py() or 0) % SHARDS
            yield batch(row=np.arange(size, dtype=np.int32), shard=np.full(size, shard, np.int32), sums=pa.array([r.tobytes() for r in total], pa.binary()))

    def merge(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in rows.column("sums"))
        return pa.table({"row": rows.column("row").slice(0, 1), "shard": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "row int, shard int, sums binary"
    sums = labelled.mapInArrow(add, schema)
    for keys in (["row", "shard"], ["row"]):
        sums = sums.groupBy(*keys).applyInArrow(lambda rows: merge(rows), schema)
    total = np.zeros((size, size + 1))
    for r in sums.select("row", "sums").collect():  # FEATURES + 1 rows
        total[r["row"]] = np.frombuffer(r["sums"])
    return total[:, :size], total[:, size], total[size - 1, size - 1]


def isotonic(position: np.ndarray, positives: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of the blocks of the best non-decreasing fit (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for x, p, w in zip(position, positives, weight, strict=True):
        blocks.append([x * w, p, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def held_out(modulus: int, name: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by ``modulus``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % modulus == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, threshold: float = 0.3) -> DataFrame:
    """Per document: held_out, raw score, calibrated score, predicted class."""
    schema = "doc_id long, " + ", ".join(f"{n} double" for n in NAMES)
    table = save_shared(texts(docs).mapInArrow(_measure, schema), "quality-statistics")
    row = table.agg(*[F.avg(n).alias(f"m_{n}") for n in NAMES], *[F.stddev_pop(n).alias(f"s_{n}") for n in NAMES]).first()
    kernel = _Kernel(np.array([row[f"m_{n}"] or 0.0 for n in NAMES]), np.array([row[f"s_{n}"] or 0.0 for n in NAMES]), FEATURES)

    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").cast("double").alias("labels"), F.sum("quality").cast("double").alias("positives"))
    training = table.filter(~held_out(modulus)).join(known, "doc_id")
    left, right, n = _normal_equations(training, kernel)
    weights = np.linalg.solve(left + RIDGE * max(n, 1.0) / FEATURES * np.eye(len(left)), right)

    def score(batches):
        for rows in batches:
            raw = kernel(rows) @ weights if rows.num_rows else np.zeros(0)
            yield batch(doc_id=rows.column("doc_id"), raw=raw)

    raw = save_shared(table.mapInArrow(score, "doc_id long, raw double"), "quality-raw")
    place = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("raw") - LOW) / (HIGH - LOW) * BINS)))
    seen = raw.filter(~held_out(modulus)).join(known, "doc_id").groupBy(place.alias("bin"))
    bins = sorted(seen.agg(F.sum("labels").alias("n"), F.sum("positives").alias("p"), F.sum(F.col("raw") * F.col("labels")).alias("x")).collect())  # at most BINS rows
    if bins:
        centre, value = isotonic(np.array([b["x"] / b["n"] for b in bins]), np.array([b["p"] for b in bins]), np.array([b["n"] for b in bins]))
    else:
        centre, value = np.array([0.0]), np.array([0.5])

    def calibrate(batches):
        for rows in batches:
            x = rows.column("raw").to_numpy(zero_copy_only=False)
            yield batch(doc_id=rows.column("doc_id"), raw=x, score=np.clip(np.interp(x, centre, value), 0, 1))

    out = raw.mapInArrow(calibrate, "doc_id long, raw double, score double")
    return out.select("doc_id", held_out(modulus).alias("held_out"), "raw", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
