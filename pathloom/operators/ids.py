"""Dense integer ids and the vocabulary tables behind them.  Id 0 is reserved for padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.skew import frequent_rows, global_index, lookup
from pathloom.session import slots


def dense_vocabulary(df: DataFrame, key: str) -> DataFrame:
    """``token, id, n``: distinct non-null keys numbered from 1 in key order, with row counts."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    return global_index(counts, [F.col("token")], "id").select("token", F.col("id").cast("int").alias("id"), "n")


def first_seen_vocabulary(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``token, id, n``: distinct keys numbered from 1 by first appearance in ``order``."""
    first = (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("token"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("_first"))
    )
    numbered = global_index(first, [F.col("_first"), F.col("token")], "id")
    return numbered.select("token", F.col("id").cast("int").alias("id"), "n")


def frequent_ids(vocabulary: DataFrame, column: str = "token") -> list | None:
    """Frequent tokens (or ids) by the row counts the vocabulary carries."""
    if "n" not in vocabulary.columns:
        return None
    spark = vocabulary.sparkSession
    top = vocabulary.filter(F.col("n") > frequent_rows(spark)).orderBy(F.desc("n"), column).limit(4 * slots(spark))
    return [r[0] for r in top.select(column).collect()]


def encode_ids(
    df: DataFrame, column: str, vocabulary: DataFrame, missing: int | None = None, frequent: list | None = None
) -> DataFrame:
    """Replace tokens by ids.  Unknown and null tokens become ``missing`` (null unless given)."""
    table = vocabulary.select(F.col("token").alias(column), F.col("id").alias("_new"))
    if frequent is None:
        frequent = frequent_ids(vocabulary)
    joined = lookup(df, table, column, frequent=frequent)
    new = F.col("_new") if missing is None else F.coalesce("_new", F.lit(missing))
    return joined.select(*[new.alias(c) if c == column else F.col(c) for c in df.columns])


def decode_ids(df: DataFrame, column: str, vocabulary: DataFrame, frequent: list | None = None) -> DataFrame:
    """Replace ids by their tokens."""
    table = vocabulary.select(F.col("id").alias(column), F.col("token").alias("_old"))
    if frequent is None:
        frequent = frequent_ids(vocabulary, "id")
    joined = lookup(df, table, column, frequent=frequent)
    return joined.select(*[F.col("_old").alias(c) if c == column else F.col(c) for c in df.columns])


def dense_ids(df: DataFrame, column: str, **skew) -> DataFrame:
    """1-based dense rank of the column's values; nulls stay null."""
    return encode_ids(df, column, dense_vocabulary(df, column), **skew)


def sorted_ids(df: DataFrame, column: str, **skew) -> DataFrame:
    """As ``dense_ids``, with null mapped to 0."""
    return encode_ids(df, column, dense_vocabulary(df, column), missing=0, **skew)


def first_seen_ids(df: DataFrame, column: str, order: list[Column], **skew) -> DataFrame:
    return encode_ids(df, column, first_seen_vocabulary(df, column, order), **skew)
