"""DataFrame helpers of this subpackage: whole columns in, sizes, components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.session import save_shared

# Text bytes that one bucket of keys or one block of documents is planned for.
BLOCK_BYTES = 12 << 20


def texts(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id long, text string) of a table with any further columns."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def text_part(text: str = "text") -> Column:
    """Tells rows with one id apart by their text."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def own_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns under names that no operator uses, and these names by the documents'."""
    plain = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*plain), dict(zip(docs.columns, plain, strict=True))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return text_size(docs, text)[0]


def text_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Text bytes of a table and the number of partitions that hold them."""
    size = F.sum(F.octet_length(F.col(text).cast("string")))
    row = docs.groupBy(F.spark_partition_id().alias("part")).agg(size.alias("size")).agg(F.sum("size"), F.count("*")).first()
    return row[0] or 0, row[1]


def blocks(size: int, block: int = BLOCK_BYTES) -> int:
    """How many buckets hold ``size`` text bytes."""
    return max(8, math.ceil(size / block))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): smallest node reachable, for the nodes of undirected edges (a, b).

    Large-star / small-star: each round links every node's larger neighbours to its smallest
    neighbour, then its smaller ones.  Rounds are written to the shared folder; only their number of
    edges and hash sums reach the driver.  It ends when a round changes nothing.
    """

    def seen(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = save_shared(edges, label)
    before = seen(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = save_shared(small.select("e.*").filter("u <> v").distinct(), label)
        now = seen(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
