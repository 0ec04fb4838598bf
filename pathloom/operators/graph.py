"""The user-item graph of the training events.  Items follow the users in one node id space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.skew import lookup


def interaction_edges(events: DataFrame, user_num: int) -> DataFrame:
    """``src`` user, ``dst`` item shifted by the number of users."""
    return events.select(F.col("user_id").cast("long").alias("src"), (F.col("item_id") + user_num).cast("long").alias("dst"))


def bidirectional_edges(edges: DataFrame) -> DataFrame:
    """Both directions of every edge in one scan, duplicates kept."""
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.inline(both))


def degree(edges: DataFrame) -> DataFrame:
    """``node, n``: edges leaving each node."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"))


def attach_degrees(edges: DataFrame, degrees: DataFrame, frequent: list | None = None) -> DataFrame:
    """The degree of both ends; a node without edges counts as degree 1."""
    out = edges
    for end in ("src", "dst"):
        table = degrees.select(F.col("node").alias(end), F.col("n").alias(f"{end}_degree"))
        out = lookup(out, table, end, frequent=frequent)
    return out.withColumns({f"{e}_degree": F.greatest(F.coalesce(f"{e}_degree", F.lit(1)), F.lit(1)) for e in ("src", "dst")})


def normalized_adjacency(events: DataFrame, user_num: int, frequent: list | None = None) -> DataFrame:
    """``src, dst, weight`` with weight ``1 / sqrt(degree(src)) / sqrt(degree(dst))``."""
    edges = interaction_edges(events, user_num)
    with_degrees = attach_degrees(edges, degree(bidirectional_edges(edges)), frequent)
    weight = ((1 / F.sqrt("src_degree")) * (1 / F.sqrt("dst_degree"))).alias("weight")
    # The weight is the same both ways: only single edges are joined, the reverse is added last.
    turned = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return with_degrees.select("src", "dst", weight).select(F.inline(F.array(F.struct("src", "dst", "weight"), turned)))
