"""Quality rules from repetition: how much of a text stands in n-grams and lines that it repeats.

Rolling hashes of several n-gram lengths are sorted per slice of documents; a word is covered when an
n-gram over it occurs twice or more in its document (first occurrence included), and coverage is the
share of the words' characters.  Lines count by exact equality.

Null text has no words and is rejected for being short; an empty table gives an empty table; equal rows
are judged alike; further input columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pathloom.llm.tables import texts
from pathloom.llm.text import Slice, batch, byte_class, groups_of, mix, slices

SYMBOLS = byte_class(b"#*$%&|<>")
MIN_WORDS = 10
# Largest percentage of words that may stand in repeated 5-word windows.
MAX_REPEATED_WORDS = 20
# Largest share of characters in repeated n-grams, by n, and in repeated lines.
MAX_COVERAGE = {6: 0.20, 8: 0.18, 10: 0.16}
MAX_LINE_COVERAGE = 0.30

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, line_coverage double, "
    + ", ".join(f"coverage_{n} double" for n in MAX_COVERAGE)
)


def _repeated(words, n: int) -> np.ndarray:
    """Words inside an n-word window that its document holds twice or more."""
    first, found = words.windows(n)
    key = found ^ mix(words.doc[first].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    start, size = groups_of(key[order])
    again = np.repeat(size > 1, size)
    return words.cover(first[order[again]], n)


def _lines(docs: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines equal to an earlier line, and their bytes, among lines with a word."""
    count, size = np.zeros(docs.n, np.int64), np.zeros(docs.n, np.int64)
    raw = docs.bytes.tobytes()
    for i, (s, e) in enumerate(zip(docs.offsets[:-1], docs.offsets[1:], strict=True)):
        if s == e:
            continue
        seen = set()
        for line in raw[s:e].split(b"\n"):
            if line in seen:
                if line.split():
                    count[i] += 1
                    size[i] += sum(map(len, line.split()))
            else:
                seen.add(line)
    return count, size


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for docs in slices(batches):
        words = docs.words()
        letters = np.concatenate(([0], np.cumsum((docs.bytes & 0xC0) != 0x80)))
        marks = np.concatenate(([0], np.cumsum(SYMBOLS[docs.bytes])))
        chars = letters[words.end] - letters[words.start]

        def by_doc(values, words=words, n=docs.n):
            return np.bincount(words.doc, weights=values, minlength=n).astype(np.int64)

        n_words, word_chars = words.per_doc, by_doc(chars)
        n_symbols = marks[docs.offsets[1:]] - marks[docs.offsets[:-1]]
        n_repeat = by_doc(_repeated(words, 5))
        n_lines, line_bytes = _lines(docs)
        word_bytes = by_doc(words.end - words.start)
        line_coverage = line_bytes / np.maximum(word_bytes, 1)
        failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEATED_WORDS * n_words)
        kept = ~failed & (line_coverage <= MAX_LINE_COVERAGE)
        coverage = {}
        for n, most in MAX_COVERAGE.items():
            coverage[f"coverage_{n}"] = by_doc(_repeated(words, n) * chars) / np.maximum(word_chars, 1)
            kept &= coverage[f"coverage_{n}"] <= most
        yield batch(
            doc_id=docs.rows.column("doc_id"), n_words=n_words, word_chars=word_chars, n_symbols=n_symbols,
            n_dup_lines=n_lines, n_repeat_words=n_repeat, base_failed=failed, kept=kept,
            line_coverage=line_coverage, **coverage,
        )


def repetition_rules(docs: DataFrame) -> DataFrame:
    """One row per document: repetition measures and the verdict ``kept``."""
    return texts(docs).mapInArrow(_measure, SCHEMA)


def kept_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected documents; no row moves between tasks."""

    def keep(batches):
        for rows in batches:
            if rows.num_rows:
                pair = rows.select(["doc_id", "text"])
                kept = [part.column(part.schema.get_field_index("kept")) for part in _measure(iter([pair]))]
                yield rows.filter(pa.concat_arrays(kept))

    return docs.mapInArrow(keep, docs.schema)
