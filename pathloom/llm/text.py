"""Vectorised text helpers used inside tasks: slices of documents, words, rolling hashes, packed keys.

Texts stay UTF-8 bytes in one numpy buffer.  A rolling hash is a polynomial over a fixed random
byte (or word) table modulo 2**64, so the hash of any range comes from two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C17
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (MurmurHash3's finaliser)."""
    h = h ^ (h >> _S)
    h *= _M1
    h ^= h >> _S
    h *= _M2
    h ^= h >> _S
    return h


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept for the next slice."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        row = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
        row[0] = 1
        known = _powers[base] = np.multiply.accumulate(row)
    return known[:n]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(BASE, len(codes)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end]; equal ranges have equal hashes wherever they stand."""
    inverse = powers(BASE_INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _M2)


def byte_class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


# Bytes of a word: all but space and \t\n\v\f\r.
WORD_BYTES = ~byte_class(b" \t\n\x0b\x0c\r")
# Bytes of a word made of ASCII letters and digits (after lower-casing) and all non-ASCII characters.
ALNUM_BYTES = byte_class(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Slice:
    """Some documents: row columns, one byte buffer, and where each document starts in it."""

    def __init__(self, rows: pa.RecordBatch, text: str):
        column = rows.column(text).fill_null("").cast(pa.large_string())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.rows, self.n = rows, len(column)
        self.bytes = raw[at[0] : at[-1]]
        self.offsets = at - at[0]

    def ids(self, name: str = "doc_id", null: int = np.iinfo(np.int64).max) -> np.ndarray:
        """An integer column; a null id ranks after all others."""
        return self.rows.column(name).cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)

    def words(self, keep: np.ndarray = WORD_BYTES, lower: bool = False) -> Words:
        return Words(self, keep, lower)


class Words:
    """Words of a slice: byte ranges, document of each, hash of each."""

    def __init__(self, docs: Slice, keep: np.ndarray, lower: bool):
        data = LOWER[docs.bytes] if lower else docs.bytes
        inside = keep[data]
        edges = docs.offsets[1:-1]
        edges = edges[edges < len(data)]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before[edges] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(docs.offsets, self.start, side="right") - 1
        self.hash = range_hash(prefix_sums(BYTE_CODES[data]), self.start, self.end)
        self.per_doc = np.bincount(self.doc, minlength=docs.n)
        self.first = np.concatenate(([0], np.cumsum(self.per_doc)))
        self.docs = docs
        self._sums = None

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of k words of one document."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return first, self.runs(first, first + k)

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self._sums is None:
            self._sums = prefix_sums(self.hash)
        return range_hash(self._sums, start, end)

    def cover(self, first: np.ndarray, k: int) -> np.ndarray:
        """Which words lie in a window of k words starting at one of ``first``."""
        return covered(len(self), first, np.minimum(first + k, len(self)))


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Documents of a task in slices of about ``limit`` bytes; a longer document is one slice."""
    waiting: list[pa.RecordBatch] = []
    size = 0

    def drain():
        rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0] if len(waiting) > 1 else waiting[0]
        whole = Slice(rows, text)
        at, start = whole.offsets, 0
        while start < whole.n:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
            yield Slice(rows.slice(start, stop - start), text)
            start = stop

    for batch in batches:
        if batch.num_rows == 0:
            continue
        waiting.append(batch)
        size += batch.column(batch.schema.get_field_index(text)).nbytes
        if size >= limit:
            yield from drain()
            waiting, size = [], 0
    if waiting:
        yield from drain()


def groups_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys starts, and how long it is."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return start, np.diff(np.concatenate((start, [len(sorted_keys)])))


# Packed keys: one row holds, for one bucket, the keys of many owners (documents, classes): owner ids,
# the number of keys of each owner, and the keys, owner after owner; ``more`` is one value per key.
PACKED = "bucket int, owners binary, counts binary, keys binary, more binary"
PACKED_ARROW = pa.schema(
    [("bucket", pa.int32()), ("owners", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), ("more", pa.binary())]
)


def pack(bucket: np.ndarray, owner: np.ndarray, keys: np.ndarray, more: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of PACKED; entries of one owner must stand together."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 65536 else bucket, kind="stable")
    bucket, owner, keys = bucket[order], owner[order], keys[order]
    more = more[order] if more is not None else None
    out = []
    for s, n in zip(*groups_of(bucket), strict=True):
        own = owner[s : s + n]
        at, counts = groups_of(own)
        extra = more[s : s + n].tobytes() if more is not None else b""
        out.append((int(bucket[s]), own[at].tobytes(), counts.astype(np.uint32).tobytes(), keys[s : s + n].tobytes(), extra))
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PACKED_ARROW, strict=True)], schema=PACKED_ARROW)


def unpack(rows: pa.Table, owner_type=np.int64, more_type=None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(owner of each key, keys, more) of the rows of one bucket."""

    def flat(name, kind):
        parts = [np.frombuffer(x.as_buffer(), kind) for x in rows.column(name)]
        return np.concatenate(parts) if parts else np.zeros(0, kind)

    owner = np.repeat(flat("owners", owner_type), flat("counts", np.uint32))
    return owner, flat("keys", np.uint64), flat("more", more_type) if more_type is not None else None


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], names=list(columns))
