"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals make document scores.

1. **Training texts**: at most ``SAMPLE`` labelled documents, the first in the order of a hash of their ids
   (a documented bound; the labels are joined to the documents by id, so no other text moves).
2. **Labelled tokens**: labels mark whole documents, so tokens get theirs from counts: a word or word prefix
   that at least ``LEAST`` toxic documents hold, ``LIFT`` times as often as the others do, marks its tokens
   in toxic documents; frequent marks are found first, rarer ones in what those leave unexplained.  A toxic
   document without any marked token is left out of the training.
3. **Field**: two states; weights of hashed token features (word, prefixes, suffix, neighbours), transitions
   and starts.  Each round is one pass over the written features: every task adds forward-backward marginals
   minus labels of its documents into one gradient of fixed size, and weights move by sign-based steps.
4. **Scores**: all whole texts are tagged.  A document's raw score is the log odds that one of its tokens is
   toxic (tokens below ``FLOOR`` count only as the largest one), made a probability by isotonic
   calibration on all labelled training documents.  Runs of tokens above ``SPAN`` are its offending spans.

The recursions run over all documents of a slice as one chain that is reset where a text starts, in rows
that step together, so a long text costs no more than many short ones.

Cases: a null text is empty; a text without words gets the score of the lowest raw score; a null id is not
held out and has no label; of several texts of an id one is trained on, equal texts once, and several labels
of an id are averaged (0.5 is toxic); null labels do not count; without labels every score is 0.5; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.quality_classifier import isotonic
from pathloom.llm.tables import texts
from pathloom.llm.text import ALNUM_BYTES, BYTE_CODES, LOWER, Slice, Words, batch, groups_of, mix, prefix_sums, range_hash, slices
from pathloom.session import save_shared

SAMPLE = 6_000  # labelled documents the field is trained on
TASKS = 8  # that share them; each returns one gradient a round
SLICE_BYTES = 1 << 20
BUCKETS = 1 << 18  # weights of token features
LEAST, LIFT = 3, 20.0
SHARES = (0.2, 0.1, 0.05, 0.02, 0.005, 0.0)  # of the toxic documents that hold a mark, one round of counts each
MARKS = 5_000  # words and prefixes that mark tokens, the most frequent ones of each round
ROUNDS = 24
PENALTY = 0.02
FLOOR, SPAN = 0.02, 0.5
EDGE = 14.0  # raw scores beyond it count as this
BINS = 560
PREFIXES = (3, 4, 5)
_SALTS = np.array([0x51ED, 0x9E37, 0x7F4A, 0xC2B2, 0x1656, 0x85EB, 0x27D4], np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def token_keys(docs: Slice) -> tuple[Words, np.ndarray]:
    """Words of a slice, and per word the keys of (word, its prefixes, its last bytes, word before, word after)."""
    words = docs.words(ALNUM_BYTES, lower=True)
    sums = prefix_sums(BYTE_CODES[LOWER[docs.bytes]])
    own = [words.hash, *[range_hash(sums, words.start, np.minimum(words.start + k, words.end)) for k in PREFIXES]]
    own.append(range_hash(sums, np.maximum(words.end - 4, words.start), words.end))
    before, after = np.zeros_like(words.hash), np.zeros_like(words.hash)
    inner = words.doc[1:] == words.doc[:-1]
    before[1:][inner], after[:-1][inner] = words.hash[:-1][inner], words.hash[1:][inner]
    keys = np.stack([*own, before, after], axis=1)
    return words, mix(keys ^ _SALTS)


def slots_of(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(BUCKETS - 1)).astype(np.int32)


def chain(start: np.ndarray, emission: np.ndarray, transition: np.ndarray, opening: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised forward vectors of two states over chains laid end to end, and the logarithm each step took out.

    ``a[t, j] ~ emission[t, j] * sum_i a[t-1, i] * transition[i, j]``, or ``emission[t, j] * opening[j]`` where
    ``start[t]``.  The steps are cut in rows of equal length: matrix products of all rows in step, then the
    state before each row, then all rows again from there.
    """
    n = len(start)
    width = max(1, int(np.sqrt(n / 4)))
    rows = -(-n // width)
    shape = (rows, width)
    reset = np.zeros(rows * width, bool)
    reset[:n] = start
    reset[0] = True
    weight = np.ones((rows * width, 2))
    weight[:n] = emission
    reset, weight = reset.reshape(shape), weight.reshape(*shape, 2)
    whole = np.broadcast_to(np.eye(2), (rows, 2, 2)).copy()
    for t in range(width):
        step = np.where(reset[:, t, None, None], whole.sum(axis=2, keepdims=True) * opening, whole @ transition)
        whole = step * weight[:, t, None, :]
        whole /= whole.max(axis=(1, 2), keepdims=True)
    before = np.empty((rows, 2))
    state = np.array([0.5, 0.5])
    for r in range(rows):
        before[r] = state
        state = state @ whole[r]
        state /= state.sum()
    out, scale = np.empty((rows, width, 2)), np.empty(shape)
    state = before
    for t in range(width):
        state = np.where(reset[:, t, None], opening, state @ transition) * weight[:, t]
        total = state.sum(axis=1)
        state = state / total[:, None]
        out[:, t], scale[:, t] = state, total
    return out.reshape(-1, 2)[:n], np.log(scale.reshape(-1)[:n])


class Field:
    """Weights of a two-state linear-chain field (state 1 is toxic)."""

    def __init__(self, slots: np.ndarray, bias: float = 0.0, transition: np.ndarray | None = None, opening: np.ndarray | None = None):
        self.slots, self.bias = slots, bias
        self.transition = np.zeros((2, 2)) if transition is None else transition
        self.opening = np.zeros(2) if opening is None else opening

    @classmethod
    def of(cls, vector: np.ndarray) -> Field:
        return cls(vector[:-7], float(vector[-7]), vector[-6:-2].reshape(2, 2), vector[-2:])

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return np.clip(self.slots[features].sum(axis=1) + self.bias, -30, 30)

    def tag(self, features: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Per token the marginals of both states, per step the pair marginals from the one before, log Z."""
        n = len(start)
        if not n:
            return np.zeros((0, 2)), np.zeros((0, 2, 2)), 0.0
        e = self.emissions(features)
        emission = np.exp(np.stack((-e / 2, e / 2), axis=1))
        turn, opening = np.exp(self.transition), np.exp(self.opening)
        forward, scale = chain(start, emission, turn, opening)
        last = np.append(start[1:], True)
        back = chain(last[::-1], emission[::-1], turn.T, np.ones(2))[0][::-1]
        marginal = forward * back / emission
        marginal /= marginal.sum(axis=1, keepdims=True)
        pair = np.zeros((n, 2, 2))
        pair[1:] = forward[:-1, :, None] * turn * back[1:, None, :]
        pair[start] = 0
        total = pair.sum(axis=(1, 2), keepdims=True)
        return marginal, np.divide(pair, total, out=pair, where=total > 0), float(scale.sum())

    def gradient(self, features: np.ndarray, start: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Expected minus observed counts, in the order of the weights in one vector."""
        marginal, pair, _ = self.tag(features, start)
        wrong = marginal[:, 1] - label
        slots = np.bincount(features.ravel(), np.repeat(wrong, features.shape[1]), len(self.slots))
        follows = np.flatnonzero(~start)
        turned = np.zeros((2, 2))
        np.add.at(turned, (label[follows - 1], label[follows]), 1.0)
        opened = marginal[start].sum(axis=0) - np.bincount(label[start], minlength=2)
        return np.concatenate((slots, [wrong.sum()], (pair.sum(axis=0) - turned).ravel(), opened))


def held_out(name: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _marks(sample: DataFrame, toxic: int, other: int) -> np.ndarray:
    """Sorted keys of words and prefixes that stand out in toxic documents.

    Those of a large share of the toxic documents come first; documents that they explain no longer count
    when rarer ones are looked for.  Else the copies of a toxic text would make all its words stand out.
    """
    marks = np.zeros(0, np.uint64)
    if not toxic:
        return marks
    columns = 1 + len(PREFIXES)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per slice the keys, in order, and the document of each; one entry per key and document."""
        for docs in slices(batches, limit=SLICE_BYTES):
            words, keys = token_keys(docs)
            keys, owner = keys[:, :columns].ravel(), np.repeat(words.doc, columns)
            order = np.lexsort((owner, keys))
            keys, owner = keys[order], owner[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            label = docs.rows.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            parts = keys[new], owner[new].astype(np.int32), label
            yield batch(**{name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("keys", "owners", "labels"), parts, strict=True)})

    held = save_shared(sample.select("text", "toxic").mapInArrow(distinct, "keys binary, owners binary, labels binary"), "toxicity-words")

    def count(known: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for row in zip(*(rows.column(c) for c in ("keys", "owners", "labels")), strict=True):
                    keys, owner, label = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, (np.uint64, np.int32, bool), strict=True))
                    explained = np.zeros(len(label), bool)
                    if len(known):
                        explained[owner[known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys]] = True
                    at, _ = groups_of(keys)
                    if len(at):
                        with_toxic = np.add.reduceat((label & ~explained)[owner].astype(np.int64), at)
                        yield batch(key=keys[at].view(np.int64), toxic=with_toxic, other=np.add.reduceat((~label)[owner].astype(np.int64), at))

        return run

    lift = (F.col("t") / toxic) / ((F.col("o") + 0.5) / (other + 1))
    for share in SHARES:
        counts = held.mapInArrow(count(marks), "key long, toxic long, other long")
        counts = counts.groupBy("key").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
        strong = (F.col("t") >= max(LEAST, share * toxic)) & (lift >= LIFT)
        best = counts.filter(strong).orderBy(F.desc("t"), "key").limit(MARKS).select("key").collect()
        marks = np.union1d(marks, np.array([r["key"] for r in best], np.int64).view(np.uint64))
    return marks


def _trained(sample: DataFrame, marks: np.ndarray) -> Field:
    """The field after ROUNDS passes over the features of the sample."""
    columns = 1 + len(PREFIXES)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in slices(batches, limit=SLICE_BYTES):
            words, keys = token_keys(docs)
            toxic = docs.rows.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            marked = np.isin(keys[:, :columns], marks).any(axis=1) & toxic[words.doc]
            known = ~toxic
            known[words.doc[marked]] = True
            use = known[words.doc]
            first = np.zeros(len(words), bool)
            first[words.first[:-1][words.per_doc > 0]] = True
            if use.any():
                yield batch(
                    features=pa.array([slots_of(keys[use]).tobytes()], pa.binary()),
                    first=pa.array([first[use].tobytes()], pa.binary()),
                    label=pa.array([marked[use].astype(np.int8).tobytes()], pa.binary()),
                )

    table = save_shared(sample.select("text", "toxic").mapInArrow(prepare, "features binary, first binary, label binary"), "toxicity-features")
    # The written features are bounded by the sample, so is the number of tasks; each returns one gradient.
    width = len(_SALTS)

    def gradients(weights: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            field, total = Field.of(weights), 0.0
            for rows in batches:
                for features, first, label in zip(*(rows.column(c) for c in ("features", "first", "label")), strict=True):
                    total = total + field.gradient(
                        np.frombuffer(features.as_buffer(), np.int32).reshape(-1, width),
                        np.frombuffer(first.as_buffer(), bool), np.frombuffer(label.as_buffer(), np.int8).astype(np.int64),
                    )
            if not np.isscalar(total):
                yield batch(gradient=pa.array([total.astype(np.float32).tobytes()], pa.binary()))

        return run

    weights = np.zeros(BUCKETS + 7)
    step, before = np.full(len(weights), 0.1), np.zeros(len(weights))
    for _ in range(ROUNDS):
        parts = table.coalesce(TASKS).mapInArrow(gradients(weights), "gradient binary").collect()  # one row a task
        if not parts:
            break
        now = sum(np.frombuffer(p["gradient"], np.float32).astype(np.float64) for p in parts) + PENALTY * weights
        same = np.sign(now) * np.sign(before)
        step = np.clip(np.where(same > 0, step * 1.3, np.where(same < 0, step * 0.5, step)), 1e-4, 1.0)
        now[same < 0] = 0
        weights -= np.sign(now) * step
        before = now
    return Field.of(weights.astype(np.float32))


def _raw(words: Words, toxic: np.ndarray) -> np.ndarray:
    """Log odds per document that at least one token is toxic."""
    p = np.clip(toxic, 1e-9, 1 - 1e-9)
    n = words.docs.n
    most = np.full(n, 1e-9)
    np.maximum.at(most, words.doc, p)
    clear = np.bincount(words.doc, np.where(p >= FLOOR, -np.log1p(-p), 0.0), n)
    clear = np.maximum(clear, -np.log1p(-most))
    return np.clip(np.log(np.expm1(np.minimum(clear, 700))), -EDGE, EDGE)


def _spans(words: Words, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and last word of each run of tokens above SPAN."""
    hot = toxic >= SPAN
    inner = np.zeros(len(words), bool)
    inner[1:] = hot[1:] & hot[:-1] & (words.doc[1:] == words.doc[:-1])
    at = np.flatnonzero(hot & ~inner)
    follows = np.append(inner[1:], False)
    return words.doc[at], at, np.flatnonzero(hot & ~follows)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per document ``doc_id, held_out, raw, score, predicted, spans``; a span is ``start, end`` (code points, end
    exclusive) and ``score``, the largest marginal in it."""
    table = texts(docs)
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"), F.count("*").cast("double").alias("labels"), F.sum("toxic").cast("double").alias("positives"))
    known = save_shared(known.filter(~held_out()), "toxicity-labels")
    chosen = F.broadcast(known.orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id").limit(SAMPLE).select("doc_id", "toxic"))
    one = table.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    one = one.groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = save_shared(one.repartition(TASKS, F.xxhash64("text")), "toxicity-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    field = _trained(sample, _marks(sample, sizes.get(1, 0), sizes.get(0, 0)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE_BYTES):
            words, keys = token_keys(part)
            first = np.zeros(len(words), bool)
            first[words.first[:-1][words.per_doc > 0]] = True
            toxic = field.tag(slots_of(keys), first)[0][:, 1]
            chars = np.concatenate(([0], np.cumsum((part.bytes & 0xC0) != 0x80)))
            owner, start, end = _spans(words, toxic)
            most = np.maximum.reduceat(toxic, start) if len(start) else np.zeros(0)
            base = chars[part.offsets[owner]]
            items = pa.StructArray.from_arrays(
                [pa.array(chars[words.start[start]] - base), pa.array(chars[words.end[end]] - base), pa.array(most)], ["start", "end", "score"]
            )
            offsets = np.searchsorted(owner, np.arange(part.n + 1)).astype(np.int32)
            yield batch(doc_id=part.rows.column("doc_id"), raw=_raw(words, toxic), spans=pa.ListArray.from_arrays(pa.array(offsets), items))

    raw = save_shared(table.mapInArrow(score, "doc_id long, raw double, spans array<struct<start:long,end:long,score:double>>"), "toxicity-raw")
    place = F.least(F.lit(BINS - 1), F.floor((F.col("raw") + EDGE) / (2 * EDGE) * BINS))
    seen = raw.select("doc_id", "raw").join(known, "doc_id").groupBy(place.alias("bin"))
    bins = sorted(seen.agg(F.sum("labels").alias("n"), F.sum("positives").alias("p"), F.sum(F.col("raw") * F.col("labels")).alias("x")).collect())  # at most BINS rows
    if bins:
        centre, value = isotonic(np.array([b["x"] / b["n"] for b in bins]), np.array([b["p"] for b in bins]), np.array([b["n"] for b in bins]))
    else:
        centre, value = np.array([0.0]), np.array([0.5])

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x = rows.column("raw").to_numpy(zero_copy_only=False)
            yield rows.append_column("score", pa.array(np.clip(np.interp(x, centre, value), 0, 1)))

    out = raw.mapInArrow(calibrate, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in raw.schema)}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "raw", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
