"""Benchmark decontamination by winnowing.

Of every ``W`` consecutive k-grams of a document or item the one with the smallest hash is kept, so any
shared span of ``k + W - 1 = window`` words shares a kept k-gram.  Kept k-grams are joined by hash; each
carries the word hashes of its surroundings, and the hit is extended to both sides as far as the words
agree.  An extension of ``window`` words or more marks all its words.  An item shorter than the window
is one k-gram of its own length, looked up among all k-grams of that length (W = 1).

Before the shuffle documents drop k-grams missing from a Bloom filter over the items' k-grams.  The
filter has a fixed size whatever the benchmark holds; its false hits cost rows, not results.

Cases: null or empty text has no words and is never contaminated; items without words are no windows;
items with equal text each count; rows with the same doc_id stay apart by their text; an empty benchmark
marks nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.tables import own_names, text_part, texts
from pathloom.llm.text import ALNUM_BYTES, Words, batch, mix, slices
from pathloom.session import save_shared

WINDOW = 13
K = 6
FILTER_BITS = 1 << 23  # one megabyte, whatever the benchmark
GRAM = "array<struct<gram:bigint,place:int,k:int,before:binary,after:binary>>"
_GRAM = pa.struct([("gram", pa.int64()), ("place", pa.int32()), ("k", pa.int32()), ("before", pa.binary()), ("after", pa.binary())])


def _winnow(words: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the k-grams kept: the smallest of each run of window - k + 1, rightmost of equals."""
    first, gram = words.windows(k)
    width = window - k + 1
    if len(first) < width:
        return first[:0], gram[:0]
    runs = np.lib.stride_tricks.sliding_window_view(gram[::-1], width)[::-1]
    inside = np.flatnonzero(words.doc[first[: len(runs)]] == words.doc[first[width - 1 :]])
    best = np.empty(len(runs), np.int64)
    for s in range(0, len(runs), 1 << 16):
        best[s : s + (1 << 16)] = width - 1 - runs[s : s + (1 << 16)].argmin(axis=1)
    keep = np.unique(inside + best[inside])
    return first[keep], gram[keep]


def _context(words: Words, first: np.ndarray, k: int, reach: int) -> tuple[list[bytes], list[bytes]]:
    """Word hashes up to ``reach`` words before and after each k-gram, inside its document."""
    low = words.first[words.doc[first]]
    high = words.first[words.doc[first] + 1]
    before = [words.hash[max(a, p - reach) : p].tobytes() for a, p in zip(low.tolist(), first.tolist(), strict=True)]
    after = [words.hash[p + k : min(b, p + k + reach)].tobytes() for b, p in zip(high.tolist(), first.tolist(), strict=True)]
    return before, after


def _grams(words: Words, picked: list[tuple[np.ndarray, np.ndarray, int, int]], n: int) -> pa.Array:
    """A list of kept k-grams per document, from (first word, hash, k, reach) groups."""
    first = np.concatenate([p[0] for p in picked])
    gram = np.concatenate([p[1] for p in picked])
    k = np.concatenate([np.full(len(p[0]), p[2]) for p in picked])
    before, after = [], []
    for f, _, size, reach in picked:
        b, a = _context(words, f, size, reach)
        before += b
        after += a
    doc = words.doc[first]
    order = np.argsort(doc, kind="stable")
    place = (first - words.first[doc])[order].astype(np.int32)
    values = pa.StructArray.from_arrays(
        [pa.array(gram[order].view(np.int64)), pa.array(place), pa.array(k[order].astype(np.int32)),
         pa.array([before[i] for i in order], pa.binary()), pa.array([after[i] for i in order], pa.binary())],
        fields=list(_GRAM),
    )
    offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _item_grams(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    for items in slices(batches):
        words = items.words(ALNUM_BYTES, lower=True)
        picked = [(*_winnow(words, k, window), k, window - k)]
        for size in range(1, window):
            whole = np.flatnonzero(words.per_doc == size)
            first = words.first[whole]
            picked.append((first, words.runs(first, first + size), size, 0))
        yield batch(item_id=items.rows.column("item_id"), grams=_grams(words, picked, items.n))


def _doc_grams(batches: Iterator[pa.RecordBatch], window: int, k: int, bits: np.ndarray, short: list[int]) -> Iterator[pa.RecordBatch]:
    def known(gram):
        slot = mix(gram.copy()) % np.uint64(FILTER_BITS)
        return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1

    for docs in slices(batches):
        words = docs.words(ALNUM_BYTES, lower=True)
        picked = []
        for first, gram, size, reach in [(*_winnow(words, k, window), k, window - k), *[(*words.windows(m), m, 0) for m in short]]:
            keep = known(gram)
            picked.append((first[keep], gram[keep], size, reach))
        yield batch(doc_id=docs.rows.column("doc_id"), part=docs.rows.column("part"), n_words=words.per_doc.astype(np.int64), grams=_grams(words, picked, docs.n))


def _filter(grams: DataFrame) -> np.ndarray:
    """Bloom filter (one hash) of the items' k-grams; each task sends one filter of fixed size."""

    def fill(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for rows in batches:
            bits[mix(rows.column("gram").to_numpy().view(np.uint64).copy()) % np.uint64(FILTER_BITS)] = True
        yield batch(bits=pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()))

    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in grams.coalesce(8).mapInArrow(fill, "bits binary").toLocalIterator():
        bits |= np.frombuffer(row["bits"], np.uint8)
    return bits


def _agree(x: list[bytes], y: list[bytes], backwards: bool, reach: int) -> np.ndarray:
    """How many word hashes agree, from the k-gram outwards."""
    def table(values, fill):
        out = np.full((len(values), reach), fill, np.uint64)
        for i, v in enumerate(values):
            row = np.frombuffer(v, np.uint64)
            out[i, : len(row)] = row[::-1] if backwards else row
        return out

    if not x or not reach:
        return np.zeros(len(x), np.int64)
    lengths = np.minimum([len(v) // 8 for v in x], [len(v) // 8 for v in y])
    same = table(x, 0) == table(y, 1)
    return np.minimum(np.logical_and.accumulate(same, axis=1).sum(axis=1), lengths)


def _extend(batches: Iterator[pa.RecordBatch], window: int, reach: int) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        if not rows.num_rows:
            continue
        got = {c: rows.column(c).to_pylist() for c in ("before", "after", "i_before", "i_after")}
        left = _agree(got["before"], got["i_before"], True, reach)
        right = _agree(got["after"], got["i_after"], False, reach)
        place, k = rows.column("place").to_numpy().astype(np.int64), rows.column("k").to_numpy()
        keep = (left + k + right >= window) | rows.column("whole").to_numpy(zero_copy_only=False)
        out = [rows.column(c).filter(pa.array(keep)) for c in ("doc_id", "part", "context")]
        yield batch(doc_id=out[0], part=out[1], context=out[2], start=(place - left)[keep], end=(place + k + right)[keep])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Per document: words, words inside benchmark windows, the items found (sorted strings), hit spans."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    grams = items.mapInArrow(partial(_item_grams, window=window, k=k), f"item_id string, grams {GRAM}")
    grams = save_shared(grams.select("item_id", F.explode("grams").alias("g")).select("item_id", "g.*"), "benchmark-grams")
    short = sorted(r["k"] for r in grams.select("k").distinct().collect() if r["k"] != k)
    whole_k = not grams.filter(f"k = {k} AND octet_length(before) = 0 AND octet_length(after) = 0").isEmpty()
    # A short item of k words cannot share the winnowed k-grams: documents keep only some of those.
    short = sorted({*short, *([k] if whole_k else [])})
    bits = _filter(grams)

    # Items with the same k-gram in the same surroundings are extended once.
    contexts = grams.groupBy("gram", "k", "before", "after").agg(F.collect_set("item_id").alias("ids"))
    contexts = contexts.withColumn("context", F.xxhash64("gram", "k", "before", "after"))
    contexts = contexts.withColumn("whole", (F.octet_length("before") == 0) & (F.octet_length("after") == 0))
    contexts = save_shared(contexts.withColumnRenamed("before", "i_before").withColumnRenamed("after", "i_after"), "benchmark-contexts")

    source = texts(docs).withColumn("part", text_part())
    marked = source.mapInArrow(partial(_doc_grams, window=window, k=k, bits=bits, short=short), f"doc_id long, part long, n_words long, grams {GRAM}")
    marked = save_shared(marked, "marked-docs")
    found = marked.select("doc_id", "part", F.explode("grams").alias("g")).select("doc_id", "part", "g.*")
    pairs = found.join(contexts.drop("ids"), ["gram", "k"]).select("doc_id", "part", "place", "k", "before", "after", "i_before", "i_after", "context", "whole")
    hits = pairs.mapInArrow(partial(_extend, window=window, reach=window - k), "doc_id long, part long, context long, start long, end long")
    hits = save_shared(hits.distinct(), "benchmark-hits")

    # Union of the spans of a document: a span starts anew where it begins beyond all earlier ends.
    key = ["doc_id", "part"]
    order = Window.partitionBy(*key).orderBy("start", "end")
    spans = hits.select(*key, "start", "end").distinct()
    spans = spans.withColumn("reached", F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    spans = spans.withColumn("run", F.sum((F.col("start") > F.col("reached")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy(*key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy(*key).agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    names = hits.select(*key, "context").distinct().join(contexts.select("context", "ids"), "context")
    names = names.select(*key, F.explode("ids").alias("item_id")).distinct().groupBy(*key).agg(F.sort_array(F.collect_list("item_id")).alias("items"))

    x = marked.drop("grams").alias("x")
    for side in (spans.alias("s"), names.alias("s")):
        on = F.col("x.doc_id").eqNullSafe(F.col("s.doc_id")) & F.col("x.part").eqNullSafe(F.col("s.part"))
        x = x.join(side, on, "left").select("x.*", *[F.col(f"s.{c}") for c in side.columns if c not in key]).alias("x")
    return x.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        "part",
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents."""
    bad = find_contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("part").alias("_part")).distinct()
    keyed, at = own_names(docs)
    on = F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("_id")) & (text_part(at["text"]) == F.col("_part"))
    return keyed.join(bad, on, "left_anti").select(*[F.col(c).alias(name) for name, c in at.items()])
