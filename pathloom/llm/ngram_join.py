"""N-gram Jaccard join by several global orders, and the groups that its links form.

A document is the set of its distinct word n-grams.  Equal sets are one class.  Every order puts
n-grams of one class first (they can match nothing), then rarer before more frequent ones, with ties
and frequency bands broken by its own hash.  Two classes that reach the similarity share an n-gram
among the first ``n - ceil(t * n) + 1`` of both under each order, so a candidate pair must meet in the
prefix of one order and pass the bitmaps of the prefixes of the others before the sets are compared.

1. Hash buckets of n-grams give document frequencies; only shared n-grams return to their classes.
2. Each n-gram of a prefix links its classes to its smallest class: a number of pairs linear in the
   index.  Links are verified on the whole sets and closed to components.
3. Only classes under one n-gram that are still in different components are paired and verified, so
   no link between components is lost and a large family of copies is not paired out.  A pair counts
   under its first common n-gram: all it has in common stands there or later in both.  The parity of
   the sets bounds the n-grams that only one of them has.

Cases: null or empty text has an empty set and links with nothing; a text with fewer than n words is
one n-gram; rows with the same id and different text are documents of their own; a null id never names
a component unless it stands alone; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.tables import blocks, components, own_names, text_bytes, text_part, texts
from pathloom.llm.text import PACKED, Slice, batch, groups_of, mix, pack, slices, unpack
from pathloom.session import save_shared

WORDS = 5
THRESHOLD = 80  # percent
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # hash seeds of the further orders
STAR_ROUNDS = 2
_BITS = 128  # width of a prefix bitmap
_PARITY_BITS = 256  # width of the parity of all shared n-grams


def _sets(docs: Slice, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram) of every distinct pair, sorted; set size and set digest per document."""
    words = docs.words(lower=True)
    first, grams = words.windows(k)
    owner = words.doc[first]
    short = np.flatnonzero((words.per_doc > 0) & (words.per_doc < k))
    if len(short):
        whole = words.runs(words.first[short], words.first[short + 1])
        owner, grams = np.concatenate((owner, short)), np.concatenate((grams, whole))
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    owner, grams = owner[new], grams[new]
    size = np.bincount(owner, minlength=docs.n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams ^ np.uint64(ORDERS[0])))))
    at = np.concatenate(([0], np.cumsum(size)))
    digest = mix(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64))
    return owner, grams, size, digest


def _describe(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for docs in slices(batches):
        _, _, size, digest = _sets(docs, k)
        yield batch(doc_id=docs.rows.column("doc_id"), part=docs.rows.column("part"), n_shingles=size.astype(np.int64), node=digest.view(np.int64))


def _scatter(batches: Iterator[pa.RecordBatch], k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """N-grams of a task's distinct sets, dealt by n-gram; equal sets are sent once."""
    sent: set[int] = set()
    for docs in slices(batches):
        owner, grams, size, digest = _sets(docs, k)
        new = np.zeros(docs.n, bool)
        for i in np.flatnonzero(size):
            d = int(digest[i])
            if d not in sent:
                sent.add(d)
                new[i] = True
        pick = new[owner]
        owner, grams = owner[pick], grams[pick]
        yield pack(grams % np.uint64(buckets), digest[owner], grams)


def _frequencies(rows: pa.Table, buckets: int) -> pa.Table:
    """Document frequency of each n-gram of a bucket; those of several classes return, dealt by class."""
    node, gram, _ = unpack(rows, np.uint64)
    order = np.lexsort((node, gram))
    node, gram = node[order], gram[order]
    new = np.ones(len(node), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
    node, gram = node[new], gram[new]
    _, size = groups_of(gram)
    size = np.repeat(size, size)
    shared = size > 1
    node, gram, size = node[shared], gram[shared], size[shared].astype(np.uint32)
    order = np.argsort(node, kind="stable")
    node, gram, size = node[order], gram[order], size[order]
    return pa.Table.from_batches([pack(node % np.uint64(buckets), node, gram, size)])


def _gather(rows: pa.Table) -> pa.Table:
    """The shared n-grams of each class with their frequencies."""
    node, gram, size = unpack(rows, np.uint64, np.uint32)
    order = np.lexsort((gram, node))
    node, gram, size = node[order], gram[order], size[order]
    at, count = groups_of(node)
    offsets = np.concatenate((at, [len(node)])).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(gram.view(np.int64)))
    sizes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(size.astype(np.int32)))
    return pa.Table.from_batches([batch(node=node[at].view(np.int64), grams=lists, sizes=sizes)])


def _bitmap(grams: np.ndarray) -> np.ndarray:
    bits = np.zeros(_BITS, bool)
    bits[grams % np.uint64(_BITS)] = True
    return np.packbits(bits).view(np.int64)


def _parity(grams: np.ndarray) -> np.ndarray:
    """Bits that differ between two sets are at most as many as the n-grams that only one of them has."""
    counts = np.bincount(((grams >> np.uint64(32)) % np.uint64(_PARITY_BITS)).astype(np.int64), minlength=_PARITY_BITS)
    return np.packbits((counts & 1).astype(bool)).view(np.int64)


_MAPS = [f"map_{i}" for i in range(len(ORDERS) * _BITS // 64)]
_PARITY = [f"parity_{i}" for i in range(_PARITY_BITS // 64)]
_INDEX = ["gram", "node", "n", "m", "k", *_MAPS, *_PARITY]
INDEX = ", ".join(f"{c} long" for c in _INDEX) + ", central double"


def _prefixes(batches: Iterator[pa.RecordBatch], seeds: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Index rows of the first order: n-gram, class, set size n, shared n-grams m, place k among these,
    bitmaps of its prefixes under the other orders, the parity of its shared n-grams, and how widely it is shared."""
    for rows in batches:
        out: list[tuple[np.ndarray, ...]] = []
        for node, n, room, grams, sizes in zip(
            rows.column("node").to_pylist(), rows.column("n").to_pylist(), rows.column("room").to_pylist(),
            rows.column("grams"), rows.column("sizes"), strict=True,
        ):
            gram = grams.values.to_numpy(zero_copy_only=False).view(np.uint64)
            size = sizes.values.to_numpy(zero_copy_only=False)
            rarity = np.log2(size)
            first = gram[np.lexsort((gram, size))[:room]].view(np.int64)
            band = rarity.astype(np.int8)
            maps = np.concatenate([_bitmap(gram[np.lexsort((mix(gram ^ np.uint64(s)), band))[:room]]) for s in seeds])
            same = np.concatenate(([node, n, len(gram)], maps, _parity(gram)))
            whole = np.repeat(np.insert(same, 3, 0)[None], len(first), 0)
            whole[:, 3] = np.arange(len(first))
            out.append((np.concatenate((first[:, None], whole), axis=1), np.full(len(first), rarity.sum() / n)))
        if out:
            table, central = (np.concatenate(x) for x in zip(*out, strict=True))
            yield batch(**{c: table[:, i] for i, c in enumerate(_INDEX)}, central=central)


class _Join:
    """Index and sets of the classes that can have a partner."""

    def __init__(self, sets: DataFrame, threshold: int):
        self.threshold = threshold
        need = F.expr(f"(n * {threshold} + 99) div 100")
        sets = sets.withColumn("room", (F.col("n") - need + 1 - (F.col("n") - F.size("grams"))).cast("int"))
        self.sets = save_shared(sets.filter("room > 0"), "ngram-sets")
        self.index = save_shared(self.sets.mapInArrow(partial(_prefixes, seeds=ORDERS), INDEX), "ngram-index")

    def _candidates(self, left: DataFrame, right: DataFrame, where: str, first: bool = False) -> DataFrame:
        """Distinct pairs a < b that share a prefix n-gram and pass the bounds of size, place and parity and
        the prefixes of the further orders; with ``first`` only under an n-gram that can be their first in common."""
        t = self.threshold
        x = left.select("gram", *[F.col(c).alias(f"x_{c}") for c in left.columns if c != "gram"])
        y = right.select("gram", *[F.col(c).alias(f"y_{c}") for c in right.columns if c != "gram"])
        # At most this many n-grams in common: the shared one and those after it; those before it unless it is the first.
        after = "least(x_m - x_k, y_m - y_k)"
        bound = after if first else f"least(x_k, y_k) + {after}"
        differ = " + ".join(f"bit_count(x_{c} ^ y_{c})" for c in _PARITY)
        each = [_MAPS[i : i + _BITS // 64] for i in range(0, len(_MAPS), _BITS // 64)]
        meet = " AND ".join("(" + " | ".join(f"(x_{c} & y_{c})" for c in cs) + ") <> 0" for cs in each)
        pairs = x.join(y, "gram").filter(
            f"x_node <> y_node AND 100 * x_n >= {t} * y_n AND 100 * y_n >= {t} * x_n "
            f"AND {100 + t} * ({bound}) >= {t} * (x_n + y_n) AND {100 + t} * (x_m + y_m - ({differ})) >= {2 * t} * (x_n + y_n) "
            f"AND {meet} AND ({where})"
        )
        return pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()

    def _verified(self, pairs: DataFrame) -> DataFrame:
        side = self.sets.select("node", "n", "grams")
        a = side.toDF("a", "a_n", "a_grams")
        b = side.toDF("b", "b_n", "b_grams")
        both = pairs.join(a, "a").join(b, "b").withColumn("same", F.size(F.array_intersect("a_grams", "b_grams")))
        return both.filter(f"100 * same >= {self.threshold} * (a_n + b_n - same)").select("a", "b")

    def links(self) -> DataFrame:
        """Components of the classes that have a similar one.

        Each star round links the classes under an n-gram to its most widely shared class outside the
        largest part (an original is shared by all its copies); what is still apart is then paired.
        """
        links, found = None, None
        open_rows = self.index.withColumn("part", F.col("node"))
        for _ in range(STAR_ROUNDS):
            hub = open_rows.groupBy("gram").agg(F.max_by(F.struct(*open_rows.columns[1:]), F.struct("central", "node")).alias("h"), F.count("*").alias("c"))
            hub = hub.filter("c > 1").select("gram", "h.*")
            more = self._verified(self._candidates(open_rows, hub, "x_part <> y_part"))
            links = save_shared(links.unionByName(more) if links is not None else more, "ngram-links")
            found = components(links)
            parts, largest = self._parts(found)
            # Under an n-gram whose classes are not all connected: the others against the largest part.
            open_rows = save_shared(parts.join(largest, "gram").filter("part <> largest").drop("largest"), "ngram-open")
        # Two classes outside the largest part meet twice here; the smaller one brings the pair.
        every = parts.join(largest, "gram")
        where = "x_part <> y_part AND (y_part = y_largest OR x_node < y_node)"
        more = self._verified(self._candidates(open_rows, every, where, first=True))
        return components(links.unionByName(more))

    def _parts(self, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Index rows with their component, and the largest component of n-grams that hold several."""
        named = self.index.join(found.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left")
        parts = save_shared(named.withColumn("part", F.coalesce("component", "node")).drop("at", "component"), "ngram-parts")
        per_part = parts.groupBy("gram", "part").agg(F.count("*").alias("c"))
        largest = per_part.groupBy("gram").agg(F.max_by("part", F.struct("c", "part")).alias("largest"), F.count("*").alias("parts"))
        return parts, largest.filter("parts > 1").select("gram", "largest")


def jaccard_groups(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: set size, smallest id of its component, and a key of the component (none for empty sets)."""
    source = texts(docs).withColumn("part", text_part())
    buckets = blocks(text_bytes(docs))
    described = save_shared(source.mapInArrow(partial(_describe, k=words), "doc_id long, part long, n_shingles long, node long"), "ngram-docs")
    dealt = source.mapInArrow(partial(_scatter, k=words, buckets=buckets), PACKED)
    shared = dealt.groupBy("bucket").applyInArrow(lambda rows: _frequencies(rows, buckets), PACKED)
    sets = shared.groupBy("bucket").applyInArrow(lambda rows: _gather(rows), "node long, grams array<bigint>, sizes array<int>")
    classes = described.filter("n_shingles > 0").groupBy("node").agg(F.max("n_shingles").alias("n"))
    join = _Join(sets.join(classes, "node"), threshold)
    parts = join.links()

    placed = described.filter("n_shingles > 0").join(parts.toDF("node", "part_"), "node", "left").withColumn("part_", F.coalesce("part_", "node"))
    placed = save_shared(placed, "ngram-placed")
    named = placed.groupBy("part_").agg(F.min("doc_id").alias("component_id"))
    linked = placed.join(named, "part_", "left").select("doc_id", "part", "n_shingles", "component_id", F.col("part_").alias("component"))
    alone = described.filter("n_shingles = 0").select("doc_id", "part", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return linked.unionByName(alone)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id.  Documents without words all stay."""
    groups = jaccard_groups(docs)
    named = groups.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "part")).alias("s"))
    id_key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    stay = named.select(id_key("s.doc_id").alias("_id"), F.col("s.part").alias("_part"), F.lit(True).alias("_one"))
    empty = groups.filter("component IS NULL").select(id_key("doc_id").alias("_id"), F.col("part").alias("_part"), F.lit(False).alias("_one")).distinct()
    keyed, at = own_names(docs)
    keyed = keyed.withColumn("_id", id_key(at["doc_id"])).withColumn("_part", text_part(at["text"]))
    kept = keyed.join(stay.unionByName(empty), ["_id", "_part"])
    # Rows with equal id and text are one group as well; the window reuses the join's partitions.
    place = F.row_number().over(Window.partitionBy("_id", "_part").orderBy("_one"))
    return kept.withColumn("_place", place).filter("_place = 1 OR NOT _one").select(*[F.col(c).alias(name) for name, c in at.items()])
