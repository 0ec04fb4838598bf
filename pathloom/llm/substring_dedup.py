"""Removes word sequences that also start in an earlier document: suffix trees over prefix partitions.

Every word position starts a suffix; only its first ``window`` words matter, so the tree is cut at that
depth.  Suffixes are dealt to subtrees by a prefix of variable length: one word, and one word more for
as long as the prefix holds more suffixes than a subtree may.  Inside a subtree the internal nodes at
the cut are the runs of equal path fingerprints; a node with leaves of several documents is a repeat,
and overlapping repeats of a document merge into its maximal removed spans.

A slice of documents sends one leaf per path, that of its smallest document; what its other documents
share with it is known without asking.  A passage in a third of all documents so costs each subtree one
leaf per slice.

Cases: null or empty text has no words; a text shorter than the window loses nothing; rows with the same
id do not count as earlier than each other; a null id ranks after all ids; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.tables import BLOCK_BYTES, blocks, text_size, texts
from pathloom.llm.text import PACKED, SLICE_BYTES, Slice, Words, batch, covered, groups_of, pack, slices, unpack

WINDOW = 13
# Suffixes a prefix may hold before it is split by one more word; at most 1/10,000 of all, so that the
# list of split prefixes stays below window * 10,000 however large the table is.
SUBTREE = BLOCK_BYTES // 6
NULL_ID = np.iinfo(np.int64).max
SPANS = "array<struct<start:int,end:int>>"


def _prefix(words: Words, first: np.ndarray, depth: int) -> np.ndarray:
    return words.runs(first, first + depth)


def _count_prefixes(batches: Iterator[pa.RecordBatch], window: int, least: int) -> Iterator[pa.RecordBatch]:
    """Prefixes that ``least`` or more suffixes of a slice share, by depth."""
    for docs in slices(batches):
        words = docs.words()
        first, _ = words.windows(window)
        found: list[tuple[int, int]] = []
        for depth in range(1, window):
            if len(first) < least:
                break
            key = _prefix(words, first, depth)
            order = np.argsort(key)
            start, size = groups_of(key[order])
            large = size >= least
            found += zip(key[order][start[large]].view(np.int64).tolist(), size[large].tolist(), strict=True)
            first = first[order[np.repeat(large, size)]]
        if found:
            prefix, count = zip(*found, strict=True)
            yield batch(prefix=pa.array(prefix, pa.int64()), n=pa.array(count, pa.int64()))


def split_prefixes(docs: DataFrame, window: int, size: int, parts: int) -> np.ndarray:
    """Prefixes to be split by one more word, sorted.

    A prefix above the limit must reach the limit's share in some slice, so slices report only those.
    """
    n_slices = max(1, size // SLICE_BYTES + parts)
    limit = max(SUBTREE, size // 6 // 10_000)
    counted = docs.mapInArrow(partial(_count_prefixes, window=window, least=max(2, limit // n_slices)), "prefix long, n long")
    rows = counted.groupBy("prefix").agg(F.sum("n").alias("n")).filter(F.col("n") > limit // 2).select("prefix").collect()
    return np.sort(np.array([r["prefix"] for r in rows], np.int64).view(np.uint64))


def _scatter(batches: Iterator[pa.RecordBatch], window: int, subtrees: int, n_blocks: int, split: np.ndarray):
    for docs in slices(batches):
        words = docs.words()
        first, path = words.windows(window)
        owner = docs.ids()[words.doc[first]]
        order = np.lexsort((owner, path))
        owner, path, first = owner[order], path[order], first[order]
        at, size = groups_of(path)
        later = owner > np.repeat(owner[at], size)  # shares its path with an earlier document of the slice
        leaf = np.zeros(len(path), bool)
        leaf[at] = True
        # Leaves go to their subtree.
        prefix = _prefix(words, first[leaf], 1)
        for depth in range(2, window + 1):
            deeper = np.flatnonzero(np.isin(prefix, split)) if len(split) else np.zeros(0, int)
            if not len(deeper):
                break
            prefix[deeper] = _prefix(words, first[leaf][deeper], depth)
        by_owner = np.argsort(owner[leaf], kind="stable")
        yield pack((prefix % np.uint64(subtrees))[by_owner], owner[leaf][by_owner], path[leaf][by_owner])
        # What is known already passes through to the block of its document.
        owner, path = owner[later], path[later]
        by_owner = np.argsort(owner, kind="stable")
        yield pack(subtrees + owner[by_owner] % n_blocks, owner[by_owner], path[by_owner])


def _subtree(key: tuple, rows: pa.Table, subtrees: int, n_blocks: int) -> pa.Table:
    """Paths of a subtree's internal nodes, for each of their documents but the smallest."""
    bucket = key[0].as_py()
    if bucket >= subtrees:
        return rows.set_column(0, "bucket", pa.array(np.full(rows.num_rows, bucket - subtrees, np.int32)))
    owner, path, _ = unpack(rows)
    order = np.lexsort((owner, path))
    owner, path = owner[order], path[order]
    at, size = groups_of(path)
    again = owner > np.repeat(owner[at], size)
    owner, path = owner[again], path[again]
    order = np.argsort(owner, kind="stable")
    owner, path = owner[order], path[order]
    return pa.Table.from_batches([pack(owner % n_blocks, owner, path)])


def text_without(docs: Slice, words: Words, removed: np.ndarray) -> pa.Array:
    """The words not removed, joined by single spaces, per document."""
    kept = np.flatnonzero(~removed)
    data = docs.bytes.copy()
    mask = covered(len(data), words.start[kept], words.end[kept]) if len(data) else np.zeros(0, bool)
    follows = words.doc[kept[:-1]] == words.doc[kept[1:]]
    gap = words.end[kept[:-1]][follows]
    data[gap] = 0x20
    mask[gap] = True
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(mask)))[docs.offsets]
    return pa.LargeStringArray.from_buffers(docs.n, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[mask])).cast(pa.string())


def spans_of(removed: np.ndarray, first: np.ndarray) -> pa.Array:
    """Maximal runs of marked places per document, as places in the document; ``first`` bounds documents."""
    mark = np.zeros(len(removed) + 1, bool)
    mark[:-1] = removed
    before = np.zeros(len(removed) + 1, bool)
    before[1:] = removed
    before[first] = False  # a document's first place starts a run of its own
    start = np.flatnonzero(mark & ~before)
    stop = np.zeros(len(removed) + 1, bool)
    stop[:-1] = ~removed
    stop[first] = True
    ends = np.flatnonzero(stop)
    end = ends[np.searchsorted(ends, start, side="right")]
    doc = np.searchsorted(first, start, side="right") - 1
    pairs = pa.StructArray.from_arrays([pa.array((start - first[doc]).astype(np.int32)), pa.array((end - first[doc]).astype(np.int32))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, first).astype(np.int32)), pairs)


def _cut(rows: pa.Table, hits: pa.Table, window: int) -> pa.Table:
    owner, path, _ = unpack(hits)
    key = np.sort((owner.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ path)
    out = []
    for docs in slices(rows.to_batches()):
        words = docs.words()
        first, found = words.windows(window)
        ids = docs.ids()[words.doc[first]].astype(np.int64)
        hit = np.isin((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ found, key)
        removed = words.cover(first[hit], window)
        n_removed = np.bincount(words.doc, weights=removed, minlength=docs.n).astype(np.int64)
        out.append(batch(doc_id=docs.rows.column("doc_id"), n_words=words.per_doc.astype(np.int64), n_removed=n_removed,
                         kept_text=text_without(docs, words, removed), spans=spans_of(removed, words.first)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()),
                        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
    return pa.Table.from_batches([x.cast(schema) if x.schema != schema else x for x in out], schema)


def repeated_words_removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, removed words, the kept text, and the removed spans (word places)."""
    source = texts(docs)
    size, parts = text_size(docs)
    n = blocks(size)
    split = split_prefixes(source, window, size, parts)
    leaves = source.mapInArrow(partial(_scatter, window=window, subtrees=n, n_blocks=n, split=split), PACKED)
    hits = leaves.groupBy("bucket").applyInArrow(lambda key, rows: _subtree(key, rows, n, n), PACKED)
    placed = source.withColumn("block", F.pmod(F.coalesce("doc_id", F.lit(NULL_ID)), F.lit(n)).cast("int"))
    return (
        placed.groupBy("block")
        .cogroup(hits.groupBy("bucket"))
        .applyInArrow(lambda rows, found: _cut(rows, found, window), f"doc_id long, n_words long, n_removed long, kept_text string, spans {SPANS}")
    )
