"""Removes every byte inside a long string that also starts elsewhere: two-stage suffix sorting.

Equal strings of ``length`` bytes must meet in one task.  Each such window is named by its smallest
``K``-byte hash (a minimizer): equal windows have equal names, and a run of windows with one name is a
piece of text.  Pieces whose name occurs once cannot repeat and are dropped; the others are dealt by name.

In a task the distinct pieces form one text whose suffixes are sorted in two stages.  Suffixes smaller
than their successor are sorted directly, to ``length`` bytes.  All others follow by a scan over the first
bytes in ascending order: a suffix larger than its successor stands, within its first byte, in the order
of its successors.  Neighbours with a common prefix of ``length`` bytes are repeats.

A slice of documents sends a name, and later a piece, once however often it holds it.

Cases: null text is empty; a text shorter than ``length`` loses nothing; a string that repeats only inside
its own document counts; rows with equal id and text are two places; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.substring_dedup import SPANS, spans_of
from pathloom.llm.tables import BLOCK_BYTES, blocks, text_bytes, texts
from pathloom.llm.text import BASE_INVERSE, BYTE_CODES, PACKED, Slice, batch, covered, groups_of, mix, pack, powers, prefix_sums, range_hash, slices, unpack

LENGTH = 200
K = 64
SLICE = 1 << 19  # text bytes whose hashes a task holds at once, some ten arrays of eight times as many
_PLACE = np.uint64((1 << 28) - 1)  # a place in a stretch, below the hash that orders minimizers
_STRETCH = 1 << 18  # windows whose minimizers are found at once
_TIED = 1 << 16  # places that one sort of whole strings takes
PIECES = "bucket int, owners binary, keys binary, sizes binary, size long, text binary"


class Pieces:
    """Runs of windows of a slice with one minimizer: windows start[i]..last[i], ``name`` and content ``key``."""

    def __init__(self, docs: Slice, length: int, k: int):
        data = docs.bytes
        self.docs, n = docs, len(data)
        self.start = self.last = self.doc = np.zeros(0, np.int64)
        self.name = self.key = np.zeros(0, np.uint64)
        width = length - k + 1
        if n < length:
            return
        sums = prefix_sums(BYTE_CODES[data])
        grams = mix((sums[k:] - sums[:-k]) * powers(BASE_INVERSE, n - k + 1))
        # Windows inside one document.
        inside = covered(n - length + 1, docs.offsets[:-1][(size := np.diff(docs.offsets)) >= length], (docs.offsets[1:] - length + 1)[size >= length])
        first = np.flatnonzero(inside)
        if not len(first):
            return
        at = _minimizers(grams, width)[first]
        new = np.ones(len(first), bool)
        new[1:] = (at[1:] != at[:-1]) | (first[1:] != first[:-1] + 1)
        runs = np.flatnonzero(new)
        self.start = first[runs]
        self.last = first[np.concatenate((runs[1:], [len(first)])) - 1]
        self.name = grams[at[runs]]
        self.key = range_hash(sums, self.start, self.last + length)
        self.doc = np.searchsorted(docs.offsets, self.start, side="right") - 1
        self.owner = docs.ids("owner")[self.doc]


def _minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest hash (the first of equal ones) in every ``width`` hashes, stretch by stretch."""
    n = len(grams) - width + 1
    out = np.empty(n, np.int64)
    for s in range(0, n, _STRETCH):
        part = grams[s : min(s + _STRETCH, n) + width - 1] & ~_PLACE
        part |= np.arange(len(part), dtype=np.uint64)
        out[s : s + _STRETCH] = (_sliding_min(part, width) & _PLACE).astype(np.int64) + s
    return out


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row, from running minima of blocks in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def _send(owner: np.ndarray, key: np.ndarray, buckets: int, n_blocks: int) -> Iterator[pa.RecordBatch]:
    """Each key once to its bucket; keys a slice holds twice or more are hits and pass to their owners' blocks."""
    order = np.lexsort((owner, key))
    owner, key = owner[order], key[order]
    at, size = groups_of(key)
    once = np.zeros(len(key), bool)
    once[at] = True
    again = np.repeat(size > 1, size)
    for pick, bucket in ((once, lambda o, x: x % np.uint64(buckets)), (again, lambda o, x: buckets + o % n_blocks)):
        o, x = owner[pick], key[pick]
        by = np.argsort(o, kind="stable")
        yield pack(bucket(o[by], x[by]).astype(np.int64), o[by], x[by])


def _scatter_names(batches: Iterator[pa.RecordBatch], length: int, k: int, buckets: int):
    for docs in slices(batches, limit=SLICE):
        pieces = Pieces(docs, length, k)
        if len(pieces.start):
            yield from _send(pieces.owner, pieces.name, buckets, buckets)


def _repeated_names(key: tuple, rows: pa.Table, buckets: int) -> pa.Table:
    bucket = key[0].as_py()
    if bucket >= buckets:
        return rows.set_column(0, "bucket", pa.array(np.full(rows.num_rows, bucket - buckets, np.int32)))
    owner, name, _ = unpack(rows)
    order = np.lexsort((owner, name))
    owner, name = owner[order], name[order]
    _, size = groups_of(name)
    again = np.repeat(size > 1, size)
    owner, name = owner[again], name[again]
    order = np.argsort(owner, kind="stable")
    return pa.Table.from_batches([pack(owner[order] % buckets, owner[order], name[order])])


def _pair(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    return (owner.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ key


_PIECES_ARROW = pa.schema([("bucket", pa.int32()), ("owners", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary()), ("size", pa.int64()), ("text", pa.binary())])


def _scatter_pieces(rows: pa.Table, hits: pa.Table, length: int, k: int, buckets: int) -> pa.Table:
    """Pieces with a repeated name.  A slice's equal pieces are sent once, with ``size`` -1 rows for all their owners."""
    owner, name, _ = unpack(hits)
    known = np.unique(_pair(owner, name))
    out: list[tuple] = []
    for docs in slices(rows.to_batches(), limit=SLICE):
        pieces = Pieces(docs, length, k)
        if not len(pieces.start):
            continue
        pick = np.flatnonzero(np.isin(_pair(pieces.owner, pieces.name), known))
        order = np.lexsort((pieces.owner[pick], pieces.key[pick], pieces.name[pick]))
        pick = pick[order]
        at, size = groups_of(pieces.key[pick])
        n_windows = (pieces.last - pieces.start + 1)[pick]
        # Equal pieces of a slice repeat each other: all their windows are hits, passed on to their owners.
        again = np.repeat(size > 1, size)
        own, key, count = pieces.owner[pick][again], pieces.key[pick][again], n_windows[again].astype(np.uint32)
        bucket = own % buckets
        for s, n in zip(*groups_of(np.sort(bucket)), strict=True):
            chosen = np.flatnonzero(bucket == np.sort(bucket)[s])
            out.append((buckets + int(bucket[chosen[0]]), own[chosen].tobytes(), key[chosen].tobytes(), count[chosen].tobytes(), -1, b""))
        one = pick[at]
        bucket = (pieces.name[one] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        one, bucket = one[order], bucket[order]
        size = pieces.last[one] + length - pieces.start[one]
        raw = docs.bytes
        for s, n in zip(*groups_of(bucket), strict=True):
            own = one[s : s + n]
            text = b"".join(raw[a:b].tobytes() for a, b in zip(pieces.start[own].tolist(), (pieces.last[own] + length).tolist(), strict=True))
            packed = pa.compress(text, "zstd", asbytes=True)
            out.append((int(bucket[s]), pieces.owner[own].tobytes(), pieces.key[own].tobytes(), size[s : s + n].astype(np.uint32).tobytes(), len(text), packed))
    columns = list(zip(*out, strict=True)) if out else [[]] * 6
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES_ARROW, strict=True)], schema=_PIECES_ARROW)


def _marked(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges, which ascend and do not overlap."""
    sizes = np.diff(np.concatenate(([0], np.column_stack((start, end)).ravel(), [n])))
    return np.repeat(np.arange(len(sizes)) % 2 == 1, sizes)


def _eights(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, read as one number (little end first, zeros after the last)."""
    padded = np.concatenate((t, np.zeros(8, np.uint8)))
    return np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(t) + 1,), (1,))


def _by_bytes(text: bytes, eight: np.ndarray, places: np.ndarray, limit: np.ndarray, at: int, length: int) -> np.ndarray:
    """``places`` in the order of text[place:limit], all equal in their first ``at`` bytes.

    Sorted by the next eight bytes; ties by whole strings, a bounded number at a time, large groups of ties by
    eight more bytes.
    """
    if at >= length:  # equal but for zeros at the end: the shorter first
        return places[np.argsort(limit - places, kind="stable")]
    left = np.clip(limit - places - at, 0, 8).astype(np.uint64)
    key = eight[np.minimum(places + at, len(eight) - 1)].byteswap()
    # Bytes past the limit count as zeros.
    key = np.where(left > 0, key & ~((np.uint64(1) << (np.uint64(64) - np.uint64(8) * np.maximum(left, 1))) - np.uint64(1)), 0)
    by = np.argsort(key, kind="stable")
    places, limit, key = places[by], limit[by], key[by]
    first, size = groups_of(key)
    del key, by, left
    for s, n in zip(first[size > _TIED].tolist(), size[size > _TIED].tolist(), strict=True):
        places[s : s + n] = _by_bytes(text, eight, places[s : s + n], limit[s : s + n], at + 8, length)
    few = (size > 1) & (size <= _TIED)
    tied = np.flatnonzero(np.repeat(few, size))
    part = np.repeat((np.cumsum(size[few]) - size[few]) // _TIED, size[few])
    for s, n in zip(*groups_of(part), strict=True):
        spot = tied[s : s + n]
        own = places[spot]
        strings = [text[i:e] for i, e in zip(own.tolist(), limit[spot].tolist(), strict=True)]
        places[spot] = own[sorted(range(n), key=strings.__getitem__)]
    return places


def two_stage_order(text: bytes, start: np.ndarray, last: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Places start[i]..last[i] of the pieces text[start[i]:end[i]], ordered by their next ``length`` bytes.

    Pieces follow one another; an end of a piece sorts before any byte.
    """
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    edge = np.zeros(n, bool)
    edge[end - 1] = True  # the last byte of a piece
    # Where a byte differs from its successor (or a piece ends), and whether the suffix is smaller there.
    differs = edge.copy()
    differs[:-1] |= t[:-1] != t[1:]
    turn = np.flatnonzero(differs)
    following = np.concatenate((t[1:], [0]))
    # directly sorted; a place has the kind of the next turn
    small = np.repeat((t[turn] < following[turn]) & ~edge[turn], np.diff(turn, prepend=-1))
    del differs, turn, following
    # Each piece is sorted to the first directly sorted place at or after its last window.
    stops = np.flatnonzero(small | edge)
    stop = stops[np.searchsorted(stops, last)]
    wanted = _marked(n, start, stop + 1)
    direct = np.flatnonzero(wanted & small)
    limit = np.minimum(direct + length, end[np.searchsorted(end, direct, side="right")])
    direct = _by_bytes(text, _eights(t), direct, limit, 0, length).astype(np.int32)
    del limit
    by_byte = np.searchsorted(t[direct], np.arange(257))
    seeds = np.flatnonzero(wanted & edge & ~small).astype(np.int32)  # a piece's last byte is the smallest suffix of its kind
    induced: list[list[np.ndarray]] = [[seeds[t[seeds] == c]] if len(seeds) else [] for c in range(256)]
    follows = wanted & ~small & ~edge  # ordered by their successor
    ordered = []
    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int32)
        parts = [wave]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[follows[before] & (t[before] == c)]
            parts.append(wave)
        parts.append(direct[by_byte[c] : by_byte[c + 1]])
        induced[c] = []
        done = np.concatenate(parts)
        if not len(done):
            continue
        ordered.append(done)
        before = done[done > 0] - 1
        before = before[follows[before] & (t[before] > c)]
        head = t[before]
        by = np.argsort(head, kind="stable")
        before, head = before[by], head[by]
        for s, m in zip(*groups_of(head), strict=True):
            induced[int(head[s])].append(before[s : s + m])
    return np.concatenate(ordered) if ordered else np.zeros(0, np.int32)


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Bytes in common at places a and b, up to ``length``, counted in steps of eight."""
    eight = _eights(text)
    found = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    for at in steps:
        live = live[eight[a[live] + at] == eight[b[live] + at]]
        if not len(live):
            break
        found[live] = at + 8
    return found


def _repeats(key: tuple, rows: pa.Table, length: int, buckets: int) -> pa.Table:
    """Hit windows (first and one past the last, in the piece) of each piece, dealt by its owner's block."""
    bucket = key[0].as_py()

    def column(name, kind):
        return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in rows.column(name)])

    owner, piece, size = column("owners", np.int64), column("keys", np.uint64), column("sizes", np.uint32).astype(np.int64)
    if bucket >= buckets:
        order = np.lexsort((piece, owner))
        return pa.Table.from_batches([pack(np.full(len(owner), bucket - buckets), owner[order], piece[order], size[order].astype(np.uint32))])
    text = b"".join(pa.decompress(t.as_buffer(), n, "zstd", asbytes=True) for t, n in zip(rows.column("text"), rows.column("size").to_pylist(), strict=True))
    raw_end = np.cumsum(size)
    distinct, pick, index, count = np.unique(piece, return_index=True, return_inverse=True, return_counts=True)
    text = b"".join(text[e - n : e] for e, n in zip(raw_end[pick].tolist(), size[pick].tolist(), strict=True))
    end = np.cumsum(size[pick])
    start = end - size[pick]
    last = end - length
    order = two_stage_order(text, start, last, end, length)
    is_window = _marked(len(text), start, last + 1)
    order = order[is_window[order]]
    same = common_prefix(np.frombuffer(text, np.uint8), order[:-1], order[1:], length) >= length
    hit = np.zeros(len(text) + 1, bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    hit[:-1] |= _marked(len(text), start[count > 1], last[count > 1] + 1)
    # Runs of hit windows inside each piece.
    before = np.concatenate(([False], hit[:-1]))
    before[start] = False
    run = np.flatnonzero(hit & ~before)
    closes = np.ones(len(hit), bool)
    closes[:-1] = ~hit[:-1]
    closes[start] = True
    ends = np.flatnonzero(closes)
    stop = ends[np.searchsorted(ends, run, side="right")]
    of = np.searchsorted(start, run, side="right") - 1
    ranges = ((run - start[of]) << 16 | (stop - start[of])).astype(np.uint32)
    # Every owner of a piece gets the piece's runs.
    first = np.searchsorted(of, np.arange(len(distinct) + 1))
    n_runs = np.diff(first)[index]
    take = np.repeat(first[:-1][index] - np.concatenate(([0], np.cumsum(n_runs)[:-1])), n_runs) + np.arange(n_runs.sum())
    owner, piece, ranges = np.repeat(owner, n_runs), np.repeat(piece, n_runs), ranges[take]
    order = np.argsort(owner, kind="stable")
    owner, piece, ranges = owner[order], piece[order], ranges[order]
    return pa.Table.from_batches([pack(owner % buckets, owner, piece, ranges)])


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()),
                  ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _cut(rows: pa.Table, found: pa.Table, length: int, k: int) -> pa.Table:
    owner, piece, ranges = unpack(found, np.int64, np.uint32)
    key = _pair(owner, piece)
    order = np.argsort(key)
    key, ranges = key[order], ranges[order]
    out = []
    for docs in slices(rows.to_batches(), limit=SLICE):
        pieces = Pieces(docs, length, k)
        n = len(docs.bytes)
        removed = np.zeros(n, bool)
        if len(pieces.start) and len(key):
            own = _pair(pieces.owner, pieces.key)
            low, high = np.searchsorted(key, own), np.searchsorted(key, own, side="right")
            size = high - low
            take = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            base = np.repeat(pieces.start, size)
            lo, hi = (ranges[take] >> 16).astype(np.int64), (ranges[take] & 0xFFFF).astype(np.int64)
            removed = covered(n, base + lo, base + hi - 1 + length)
        lost = np.concatenate(([0], np.cumsum(removed)))
        at = docs.offsets - lost[docs.offsets]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), docs.n, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(docs.bytes[~removed])])
        size = np.diff(docs.offsets)
        out.append(batch(doc_id=docs.rows.column("doc_id"), n_bytes=size, n_removed=size - np.diff(at), kept=kept.cast(pa.binary()), spans=spans_of(removed, docs.offsets)).cast(_OUT))
    return pa.Table.from_batches(out, _OUT)


def repeated_bytes_removed(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """Per document: bytes, removed bytes, the bytes kept, and the removed spans (byte places)."""
    # Rows are dealt by a hash of id and text: null ids, and ids with a common factor, spread as others do.
    source = texts(docs).withColumn("owner", F.xxhash64("doc_id", "text"))
    n = blocks(text_bytes(docs), BLOCK_BYTES // 4)
    names = source.mapInArrow(partial(_scatter_names, length=length, k=k, buckets=n), PACKED)
    repeated = names.groupBy("bucket").applyInArrow(lambda key, rows: _repeated_names(key, rows, n), PACKED)
    placed = source.withColumn("block", F.pmod("owner", F.lit(n)).cast("int"))
    pieces = placed.groupBy("block").cogroup(repeated.groupBy("bucket")).applyInArrow(lambda rows, hits: _scatter_pieces(rows, hits, length, k, n), PIECES)
    found = pieces.groupBy("bucket").applyInArrow(lambda key, rows: _repeats(key, rows, length, n), PACKED)
    return (
        placed.groupBy("block")
        .cogroup(found.groupBy("bucket"))
        .applyInArrow(lambda rows, hits: _cut(rows, hits, length, k), f"doc_id long, n_bytes long, n_removed long, kept binary, spans {SPANS}")
    )
