"""Language-model scores: a gated recurrent network with a class-factored output, over exact corpus counts.

Word counts cover all training documents.  The most frequent ``VOCABULARY`` words, "another word" and
"end" are the network's symbols; another word costs the network's probability of that symbol times the
word's share, by smoothed corpus counts, of what lies outside the vocabulary, so the probabilities of all
words sum to one.  Words outside the vocabulary are counted and priced in hash buckets, which send back
one partial sum per document; no table of words is broadcast or collected.

The network is trained on all training documents by truncated backpropagation on shards of about
``SHARD_TOKENS`` tokens (row keys decide which), so their number follows the tokens.  Their weights are
averaged over a tree after each of ``ROUNDS`` rounds; a shard sends one set of fixed size.  Texts become
symbols once, in a shared table that all rounds and the scoring read.  Scoring runs up to ``LANES`` documents
in step, a window at a time, and carries the state from window to window, so a score is the log-likelihood
of the complete document.

Cases: null or empty text is one end token; rows with equal id and text score alike; a null id is never
held out; without training text the network keeps its initial weights; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from pathloom.llm.quality_classifier import held_out
from pathloom.llm.tables import blocks, text_bytes
from pathloom.llm.text import PACKED, Words, batch, groups_of, mix, pack, slices, unpack
from pathloom.session import save_shared

VOCABULARY = 1022
CLASSES = 32
HIDDEN = 24
WINDOW = 24  # steps of one truncated backpropagation, and of one scoring window
SHARD_TOKENS = 8_000_000  # tokens that one task trains on
LANES = 512  # streams, or documents, that advance in step
LEAST_LANES = 64
OFTEN = 32  # rows of one symbol in a window above which they are added by a product
UPDATES = 640  # of a shard in a round, where its lanes allow
REPLICAS = 6  # shards at least
FAN_IN = 16  # sets of weights that one task, or the driver, averages
ROUNDS = 2
TASK_TOKENS = 4_000_000  # tokens scored in step
ALPHA = 0.1
BLOCK = 32 << 20


class Network:
    """GRU with input tables in place of an input matrix, and a softmax over classes, then words of a class."""

    def __init__(self, classes: np.ndarray, seed: int = 7):
        """``classes`` is the class of each symbol, non-decreasing."""
        rng = np.random.default_rng(seed)
        n, h = len(classes), HIDDEN
        self.classes = classes
        self.first = np.searchsorted(classes, np.arange(classes[-1] + 2))
        k = int(classes[-1]) + 1
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.weights = {
            "x": draw(n, 3 * h), "u": draw(h, 3 * h), "b": np.zeros(3 * h, np.float32),
            "c": draw(h, k), "cb": np.zeros(k, np.float32), "w": draw(h, n), "wb": np.zeros(n, np.float32),
        }

    def start_from(self, counts: np.ndarray) -> None:
        """Output biases of the symbols' frequencies."""
        p = (counts + 1.0) / (counts + 1.0).sum()
        self.weights["wb"] = np.log(p).astype(np.float32)
        self.weights["cb"] = np.log(np.add.reduceat(p, self.first[:-1])).astype(np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of the three gates, biases included, one under another, and their recurrent matrices."""
        w, h = self.weights, HIDDEN
        return (w["x"] + w["b"]).reshape(-1, h), np.ascontiguousarray(w["u"].reshape(h, 3, h).swapaxes(0, 1))

    def step(self, state: np.ndarray, symbol: np.ndarray, tables: tuple | None = None, room: np.ndarray | None = None, out: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Next state and what its gradients need; each gate is an array of its own (``room``, ``out``: filled if given)."""
        x, u = tables or self.tables()
        room = np.empty((4, *state.shape), state.dtype) if room is None else room
        gates, (z, r, new, a) = room[:2], room
        np.take(x, symbol * 3 + np.arange(3)[:, None], axis=0, out=room[:3], mode="clip")
        gates += state @ u[:2]
        gates *= 0.5
        np.tanh(gates, out=gates)  # 1 / (1 + exp(-v)) = tanh(v / 2) / 2 + 1 / 2
        gates *= 0.5
        gates += 0.5
        np.matmul(state, u[2], out=a)
        new += r * a
        np.tanh(new, out=new)
        out = np.subtract(new, state, out=out)
        out *= z
        out += state
        return out, z, r, new, a

    def log_probability(self, states: np.ndarray, target: np.ndarray, gradients: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln P(target | state) per row; with ``gradients`` also adds those of -sum and returns the states'."""
        w = self.weights
        order = np.argsort(self.classes[target].astype(np.uint8), kind="stable")
        states, target = np.take(states, order, axis=0), target[order]
        cls = self.classes[target]
        found, e = self._softmax(w["c"], w["cb"], states, cls, gradients is not None)
        back = None
        if gradients is not None:
            gradients["c"] += states.T @ e.T
            gradients["cb"] += e.sum(axis=1)
            back = e.T @ w["c"].T
        for s, n in zip(*groups_of(cls), strict=True):
            lo, hi = self.first[cls[s]], self.first[cls[s] + 1]
            if hi - lo == 1:
                continue
            some = slice(s, s + n)
            own, e = self._softmax(w["w"][:, lo:hi], w["wb"][lo:hi], states[some], target[some] - lo, gradients is not None)
            found[some] += own
            if gradients is not None:
                gradients["w"][:, lo:hi] += states[some].T @ e.T
                gradients["wb"][lo:hi] += e.sum(axis=1)
                back[some] += e.T @ w["w"][:, lo:hi].T
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return found[place], back if back is None else np.take(back, place, axis=0)

    @staticmethod
    def _softmax(matrix: np.ndarray, bias: np.ndarray, states: np.ndarray, place: np.ndarray, slope: bool) -> tuple[np.ndarray, np.ndarray]:
        """ln P of the places, and with ``slope`` the gradient of -sum by logit; a column for each state, so numpy adds whole rows."""
        e = matrix.T @ states.T
        e += bias[:, None]
        e -= e.max(axis=0)
        at = np.arange(len(place))
        found = e[place, at]
        np.exp(e, out=e)
        total = e.sum(axis=0)
        found -= np.log(total)
        if slope:
            e /= total
            e[place, at] -= 1
        return found, e

    def train(self, stream: np.ndarray, end: int, rate: float = 0.01) -> None:
        """One pass over a symbol stream, cut into lanes that advance in step; Adam on each window.

        A longer stream has more lanes, not more updates: numpy's cost of a window hardly grows below ``LANES``.
        Less than ``LEAST_LANES`` symbols at the end belong to no lane.
        """
        lanes = max(1, min(LEAST_LANES, len(stream) // (2 * WINDOW)))
        most = min(LANES, len(stream) // (UPDATES * WINDOW))
        if most > lanes:
            lanes = next(n for n in range(most, 0, -1) if len(stream) % n < LEAST_LANES)
        length = len(stream) // lanes
        if length < 2:
            return
        table = np.ascontiguousarray(stream[: lanes * length].reshape(lanes, length).T)
        state = np.zeros((lanes, HIDDEN), np.float32)
        before = np.full(lanes, end)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        gates, olds, states, slopes = (np.empty((WINDOW, n, lanes, HIDDEN), np.float32) for n in (4, 1, 1, 3))
        olds, states = olds[:, 0], states[:, 0]
        for t, at in enumerate(range(0, length, WINDOW), 1):
            window = table[at : at + WINDOW].astype(np.int64)
            gradients = {k: np.zeros_like(v) for k, v in self.weights.items()}
            trace, tables = [], self.tables()
            for i, row in enumerate(window):
                old = olds[i]
                old[:] = state
                old[np.flatnonzero(before == end)] = 0  # a document starts
                state, *rest = self.step(old, before, tables, gates[i], states[i])
                trace.append((old, before, *rest))
                before = row
            state = state.copy()
            _, back = self.log_probability(states[: len(window)].reshape(-1, HIDDEN), window.ravel(), gradients)
            self._backward(trace, back.reshape(len(window), lanes, HIDDEN), gradients, end, slopes)
            for k, g in gradients.items():
                g *= 0.1 / window.size
                mean[k] *= 0.9
                mean[k] += g
                g *= g
                square[k] *= 0.99
                square[k] += g
                np.divide(square[k], 1 - 0.99**t, out=g)
                np.sqrt(g, out=g)
                g += 1e-6
                np.divide(mean[k], g, out=g)
                g *= rate / (1 - 0.9**t)
                self.weights[k] -= g

    def _backward(self, trace: list, back: np.ndarray, gradients: dict, end: int, room: np.ndarray | None = None) -> None:
        h = HIDDEN
        n, lanes, _ = back.shape
        d_x = (np.empty(3 * back.size, back.dtype) if room is None else room.reshape(-1)[: 3 * back.size]).reshape(3, n, lanes, h)
        d_a = np.empty((lanes, 3, h), back.dtype)
        d_all = d_a.reshape(lanes, 3 * h)
        u = self.weights["u"].T
        d = np.zeros_like(back[0])
        for i, (old, symbol, z, r, new, a) in zip(range(n)[::-1], reversed(trace), strict=True):
            d += back[i]
            d_z, d_r, d_new = d_x[:, i]
            stay = 1 - z
            np.multiply(new, new, out=d_new)
            np.subtract(1, d_new, out=d_new)
            d_new *= z
            d_new *= d
            np.subtract(1, r, out=d_r)
            d_r *= r
            d_r *= a
            d_r *= d_new
            np.subtract(new, old, out=d_z)
            d *= stay
            d_z *= z
            d_z *= d
            d_a[:, 0] = d_z
            d_a[:, 1] = d_r
            np.multiply(d_new, r, out=d_a[:, 2])
            gradients["u"] += old.T @ d_all
            d += d_all @ u
            d[np.flatnonzero(symbol == end)] = 0  # the state was reset there
        d_x = d_x.reshape(3, -1, h)
        gradients["b"] += (np.ones(n * lanes, back.dtype) @ d_x).ravel()
        _add_rows(gradients["x"].reshape(-1, 3, h), np.concatenate([symbol for _, symbol, *_ in trace]), d_x)

    def score(self, symbols: np.ndarray, size: np.ndarray, end: int) -> np.ndarray:
        """ln P of each document; ``symbols`` holds them one after another, end tokens included.

        Documents of about equal length go in step, at most ``LANES`` at once, so a window stays in the processor's cache.
        """
        out = np.zeros(len(size))
        order = np.argsort(-size, kind="stable")
        start = np.concatenate(([0], np.cumsum(size)))[:-1]
        for lane in range(0, len(order), LANES):
            some = order[lane : lane + LANES]
            out[some] = self._score(symbols, start[some], size[some], end)
        return out

    def _score(self, symbols: np.ndarray, at: np.ndarray, length: np.ndarray, end: int) -> np.ndarray:
        """``score`` of documents that start ``at`` places, longest first."""
        tables = self.tables()
        room = np.empty(4 * len(at) * HIDDEN, np.float32)
        state = np.zeros((len(at), HIDDEN), np.float32)
        before = np.full(len(at), end)
        total = np.zeros(len(at))
        lives = np.searchsorted(-length, -np.arange(int(length[0])), side="left")  # documents longer than t
        for t0 in range(0, int(length[0]), WINDOW):
            rows = lives[t0 : t0 + WINDOW]
            stops = np.cumsum(rows)
            states, targets = np.empty((stops[-1], HIDDEN), np.float32), np.empty(stops[-1], np.int64)
            for t, (live, stop) in enumerate(zip(rows, stops, strict=True), t0):
                state = self.step(state[:live], before[:live], tables, room[: 4 * live * HIDDEN].reshape(4, live, HIDDEN), states[stop - live : stop])[0]
                before = targets[stop - live : stop]
                before[:] = symbols[at[:live] + t]
            found, _ = self.log_probability(states, targets)
            for live, part in zip(rows, np.split(found, stops[:-1]), strict=True):
                total[:live] += part
        return total


def _add_rows(total: np.ndarray, place: np.ndarray, rows: np.ndarray) -> None:
    """``total[place] += rows`` where places repeat; ``rows`` has one matrix for each of the second axis of ``total``."""
    order = np.argsort(place.astype(np.uint16) if len(total) < 65536 else place, kind="stable")
    at, size = groups_of(place[order])
    by_size = np.argsort(-size, kind="stable")
    at, size = at[by_size], size[by_size]
    long = int(np.searchsorted(-size, -OFTEN, side="left"))
    sums = np.zeros((len(rows), len(at), rows.shape[-1]), rows.dtype)
    for k, s, n in zip(range(long), at, size):  # noqa: B905  the others follow
        sums[:, k] = np.ones(n, rows.dtype) @ np.take(rows, order[s : s + n], axis=1)
    for i in range(size[long] if long < len(size) else 0):  # the i-th row of every place that has one
        stop = np.searchsorted(-size, -i, side="left")
        sums[:, long:stop] += np.take(rows, order[at[long:stop] + i], axis=1)
    total[place[order[at]]] += sums.swapaxes(0, 1)


def _tokens(words: Words, known: np.ndarray, symbol: np.ndarray, end: int, other: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with ends, tokens per document, symbol of each word)."""
    spot = np.minimum(np.searchsorted(known, words.hash), max(len(known) - 1, 0))
    of = np.where(known[spot] == words.hash, symbol[spot], other) if len(known) else np.full(len(words), other)
    size = words.per_doc + 1
    out = np.full(int(size.sum()), end, np.int16)
    out[np.arange(len(of)) + words.doc] = of
    return out, size, of


def _encoded(source: DataFrame, known: np.ndarray, symbol: np.ndarray, end: int, other: int) -> DataFrame:
    """``source`` with symbols of two bytes in place of its text, and ``learn``: a training document with text."""
    source = source.withColumn("learn", F.col("train") & (F.octet_length("text") > 0))
    kept = [c for c in source.columns if c != "text"]

    def encode(batches):
        for part in slices(batches):
            symbols, size, _ = _tokens(part.words(lower=True), known, symbol, end, other)
            ends = np.concatenate(([0], np.cumsum(size * symbols.itemsize))).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), part.n, [None, pa.py_buffer(ends), pa.py_buffer(symbols)])
            yield batch(**{c: part.rows.column(c) for c in kept}, symbols=column)

    return source.mapInArrow(encode, StructType([*(source.schema[c] for c in kept), StructField("symbols", BinaryType())]))


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all documents, tokens per document) of a column that ``_encoded`` made."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.int16), np.diff(at) // 2


def _count_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of the words of training documents, merged inside the task before they are dealt."""
    waiting: list[np.ndarray] = []
    held = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merged():
        fresh = np.sort(np.concatenate((held[0][:0], *waiting)))
        at, n = groups_of(fresh)
        keys, counts = np.concatenate((held[0], fresh[at])), np.concatenate((held[1], n))
        order = np.argsort(keys)
        at, _ = groups_of(keys[order])
        return keys[order][at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]

    for docs in slices(batches):
        words = docs.words(lower=True)
        train = docs.rows.column("train").to_numpy(zero_copy_only=False)
        waiting.append(words.hash[train[words.doc]])
        if sum(map(len, waiting)) > 2_000_000:
            held, waiting = merged(), []
            if len(held[0]) > 2_000_000:
                yield pack(held[0] % np.uint64(buckets), np.zeros(len(held[0]), np.int64), *held)
                held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held = merged()
    yield pack(held[0] % np.uint64(buckets), np.zeros(len(held[0]), np.int64), *held)


def _bucket_counts(rows: pa.Table, most: int) -> pa.Table:
    """Distinct words and tokens of a bucket, and its most frequent words."""
    _, key, n = unpack(rows, np.int64, np.int64)
    order = np.argsort(key)
    at, _ = groups_of(key[order])
    key, n = key[order][at], np.add.reduceat(n[order], at) if len(at) else n[:0]
    top = np.argsort(-n, kind="stable")[:most]
    pairs = pa.StructArray.from_arrays([pa.array(key[top].view(np.int64)), pa.array(n[top])], ["word", "n"])
    lists = pa.ListArray.from_arrays(pa.array([0, len(top)], pa.int32()), pairs)
    return pa.Table.from_batches([batch(distinct=pa.array([len(key)], pa.int64()), tokens=pa.array([int(n.sum())], pa.int64()), top=lists)])


def _scatter_rare(batches: Iterator[pa.RecordBatch], buckets: int, known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each document's distinct words outside the vocabulary, with how often they occur there."""
    for docs in slices(batches):
        words = docs.words(lower=True)
        spot = np.minimum(np.searchsorted(known, words.hash), max(len(known) - 1, 0))
        rare = known[spot] != words.hash if len(known) else np.ones(len(words), bool)
        row = docs.rows.column("row").to_numpy(zero_copy_only=False)
        train = docs.rows.column("train").to_numpy(zero_copy_only=False)
        doc, key = words.doc[rare], words.hash[rare]
        order = np.argsort(key)
        order = order[np.argsort(doc[order].astype(np.uint16) if docs.n < 65536 else doc[order], kind="stable")]
        doc, key = doc[order], key[order]
        at, n = groups_of(key ^ mix(doc.astype(np.uint64) + np.uint64(1)))
        doc, key = doc[at], key[at]
        yield pack(key % np.uint64(buckets), row[doc], key, (n << 1 | train[doc]).astype(np.uint32))


def _price(rows: pa.Table, n_blocks: int) -> pa.Table:
    """Per document: sums of log10 of smoothed counts over its words of this bucket, and known tokens; dealt by document."""
    owner, key, more = unpack(rows, np.int64, np.uint32)
    n, train = (more >> 1).astype(np.int64), (more & 1).astype(bool)
    order = np.argsort(key, kind="stable")
    owner, key, n, train = owner[order], key[order], n[order], train[order]
    at, size = groups_of(key)
    count = np.repeat(np.add.reduceat(n * train, at), size) if len(at) else n
    owners, logs, known = _summed(owner, n * np.log10(count + ALPHA), n * (count > 0))
    return pa.Table.from_batches([pack(owners % n_blocks, owners, logs.view(np.uint64), known)])


def _summed(owner: np.ndarray, logs: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owners, index = np.unique(owner, return_inverse=True)
    return owners, np.bincount(index, weights=logs, minlength=len(owners)), np.bincount(index, weights=known, minlength=len(owners)).astype(np.uint32)


def _total(rows: pa.Table) -> pa.Table:
    owner, logs, known = unpack(rows, np.int64, np.uint32)
    owners, logs, known = _summed(owner, logs.view(np.float64), known)
    return pa.table({"row": owners, "rare_log": logs, "rare_known": known.astype(np.int64)})


def score_documents(docs: DataFrame, modulus: int = 10) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (~held_out(modulus)).alias("train"))
    source = source.withColumn("row", F.xxhash64("doc_id", "text"))
    buckets = blocks(text_bytes(source), BLOCK)

    counted = source.select("text", "train").mapInArrow(partial(_count_words, buckets=buckets), PACKED)
    counted = counted.groupBy("bucket").applyInArrow(lambda rows: _bucket_counts(rows, VOCABULARY), "distinct long, tokens long, top array<struct<word:bigint,n:bigint>>")
    counted = save_shared(counted, "lm-counts")
    sums = counted.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    train_docs = source.filter("train").count()
    top = counted.select(F.explode("top").alias("t")).orderBy(F.desc("t.n"), "t.word").limit(VOCABULARY).select("t.*").collect()
    tokens, distinct = sums[1] + train_docs, sums[0] + (train_docs > 0)
    scale = np.log10(tokens + ALPHA * (distinct + 1))

    # Symbols: the vocabulary by frequency, then "another word" and "end"; classes of about equal mass.
    frequency = np.array([r["n"] for r in top] + [max(sums[1] - sum(r["n"] for r in top), 0), train_docs], float)
    by_count = np.argsort(-frequency, kind="stable")
    mass = np.cumsum(np.sqrt(frequency[by_count] + 1))
    n_classes = min(CLASSES, len(by_count))
    classes = np.minimum((mass - mass[0]) / mass[-1] * n_classes, n_classes - 1).astype(np.int64)
    classes = np.unique(classes, return_inverse=True)[1]
    symbol_of = np.empty(len(by_count), np.int64)
    symbol_of[by_count] = np.arange(len(by_count))
    other, end = int(symbol_of[-2]), int(symbol_of[-1])
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    known, symbol = words[order], symbol_of[:-2][order]
    logs = np.zeros(len(by_count))  # log10 of smoothed counts by symbol; another word is priced elsewhere
    logs[symbol_of] = np.log10(frequency + ALPHA)
    logs[other] = 0.0
    inside = (np.delete(frequency, -2) + ALPHA).sum()
    outside = np.log10(max(tokens + ALPHA * (distinct + 1) - inside, ALPHA))  # smoothed count of all other words

    network = Network(classes)
    network.start_from(frequency[by_count])
    encoded = save_shared(_encoded(source, known, symbol, end, other), "lm-symbols")
    weights = _trained(source, network, tokens, known, symbol, end, other, encoded)

    rare = source.mapInArrow(partial(_scatter_rare, buckets=buckets, known=known), PACKED)
    priced = rare.groupBy("bucket").applyInArrow(lambda rows: _price(rows, buckets), PACKED)
    priced = priced.groupBy("bucket").applyInArrow(lambda rows: _total(rows), "row long, rare_log double, rare_known long")

    def score(batches):
        net = Network(classes)
        net.weights = weights

        def run(parts):
            rows = pa.Table.from_batches(parts).combine_chunks()
            doc_id, train, row, text = (rows.column(c).combine_chunks() for c in ("doc_id", "train", "row", "symbols"))
            symbols, size = _symbols(text)
            start = np.cumsum(size) - size
            found = net.score(symbols, size, end) / np.log(10)
            common, n_rare = np.add.reduceat(logs[symbols], start), np.add.reduceat((symbols == other).astype(np.int64), start)
            return batch(doc_id=doc_id, train=train, row=row, n_tokens=size, network_log=found, common_log=common, n_rare=n_rare)

        parts, total = [], 0
        for part in batches:
            if part.num_rows:
                parts.append(part)
                total += part.column("symbols").nbytes // 2
            if total >= TASK_TOKENS:
                yield run(parts)
                parts, total = [], 0
        if parts:
            yield run(parts)

    schema = "doc_id long, train boolean, row long, n_tokens long, network_log double, common_log double, n_rare long"
    scored = encoded.select("doc_id", "train", "row", "symbols").mapInArrow(score, schema)
    equal = scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("train").alias("train"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n_tokens", "network_log", "common_log", "n_rare")])
    both = equal.join(priced, "row", "left").withColumn("rare_log", F.coalesce("rare_log", F.lit(0.0)) / F.col("copies")).withColumn("rare_known", F.coalesce("rare_known", F.lit(0)) / F.col("copies"))
    both = both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    end_known = 1 if train_docs else 0
    return both.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens",
        (F.col("n_tokens") - 1 - F.col("n_rare") + F.col("rare_known") + end_known).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("common_log") + F.col("rare_log") - F.col("n_tokens") * float(scale)).alias("base_score"),
        (F.col("network_log") + F.col("rare_log") - F.col("n_rare") * float(outside)).alias("score"),
    )


def _mean(rows: pa.Table) -> pa.Table:
    """One set of weights for several, weighted by their tokens; shards are taken in order."""
    rows = rows.sort_by("shard")
    n = rows.column("n").to_numpy()
    total = np.zeros(len(rows.column("weights")[0].as_py()) // 4)
    for share, weights in zip(n / n.sum(), rows.column("weights"), strict=True):
        total += share * np.frombuffer(weights.as_py(), np.float32)
    of = rows.column("shard")[0].as_py() // FAN_IN
    return pa.table({"shard": pa.array([of], pa.int64()), "n": pa.array([int(n.sum())], pa.int64()), "weights": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _trained(source: DataFrame, network: Network, tokens: int, known: np.ndarray, symbol: np.ndarray, end: int, other: int, encoded: DataFrame | None = None) -> dict:
    """Weights averaged over shards of all training text; FAN_IN sets at most reach the driver in each round.

    ``encoded`` is ``_encoded`` of the same source, if it is kept.
    """
    encoded = _encoded(source, known, symbol, end, other) if encoded is None else encoded
    shards = max(REPLICAS, math.ceil(tokens / SHARD_TOKENS))
    shard = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(shards)).cast("long")
    chosen = encoded.filter("learn").select("row", "symbols", shard.alias("shard"))
    names = list(network.weights)
    schema = "shard long, n long, weights binary"
    for _ in range(ROUNDS):
        weights = network.weights

        def train(rows):
            net = Network(network.classes)
            net.weights = {k: v.copy() for k, v in weights.items()}  # noqa: B023  used before the next round
            rows = rows.sort_by("row")
            stream = np.concatenate([_symbols(x)[0] for x in rows.column("symbols").chunks])
            net.train(stream, end)
            return pa.table({"shard": rows.column("shard").slice(0, 1), "n": pa.array([len(stream)], pa.int64()), "weights": pa.array([b"".join(net.weights[k].tobytes() for k in names)], pa.binary())})

        # Spark would merge shards into tasks by their bytes, but not with a set number; of 8 tasks a shard few get two.
        found, left = chosen.repartition(8 * shards, "shard").groupBy("shard").applyInArrow(train, schema), shards
        while left > FAN_IN:
            found, left = found.groupBy(F.expr(f"shard div {FAN_IN}")).applyInArrow(lambda rows: _mean(rows), schema), math.ceil(left / FAN_IN)
        replicas = sorted((r["shard"], r["n"], bytes(r["weights"])) for r in found.collect())
        if not replicas:
            break
        total = sum(n for _, n, _ in replicas)
        flat = sum(np.frombuffer(w, np.float32) * (n / total) for _, n, w in replicas).astype(np.float32)
        at = 0
        for k in names:
            shape = network.weights[k].shape
            network.weights = {**network.weights, k: flat[at : at + int(np.prod(shape))].reshape(shape).copy()}
            at += int(np.prod(shape))
    return network.weights
