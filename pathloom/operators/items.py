"""Item text and user-supplied tokenizers and encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.text import item_prompt_text
from pathloom.operators.history import SEGMENT_LENGTH
from pathloom.operators.skew import lookup, positions
from pathloom.session import slots


def item_texts(items: DataFrame, keys: Sequence[str], prompt: str = "") -> DataFrame:
    """``item_id, text`` once per item with an id above 0; of several rows of an item the smallest text."""
    texts = items.filter(F.col("item_id") > 0).select("item_id", item_prompt_text(items, keys, prompt).alias("text"))
    return texts.groupBy("item_id").agg(F.min("text").alias("text"))


def attach_item_text(rows: DataFrame, items: DataFrame, keys: Sequence[str], prompt: str = "", **skew) -> DataFrame:
    """``text`` of each row's ``item_id``; unknown ids and id 0 get the empty string.

    An item with several rows has one text, the smallest, so no row of ``rows`` is doubled.
    """
    return lookup(rows, item_texts(items, keys, prompt), "item_id", **skew).withColumn("text", F.coalesce("text", F.lit("")))


def window_items(windows: DataFrame, keys: Sequence[str] = ("user_id", "seq_no"), column: str = "item_seq") -> DataFrame:
    """One row per place of a window, for joins by item."""
    return windows.select(*keys, F.posexplode(column).alias("place", "item_id"))


def split_words(text: Column) -> Column:
    """Built-in tokenizer: words between single spaces."""
    return F.split(text, " ")


def tokenize_with(df: DataFrame, text: str, factory: Callable[[], Callable[[str], list[int]]], out: str = "tokens") -> DataFrame:
    """Token ids by a user-supplied tokenizer; ``factory`` runs once per Python worker task."""

    @F.pandas_udf("array<int>")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for batch in batches:
            yield batch.map(encode, na_action="ignore")

    return df.withColumn(out, tokens(F.col(text)))


def encode_items_with(
    items: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str = "item_id long, vector array<double>"
) -> DataFrame:
    """Item rows -> vectors by a user-supplied batch encoder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = factory()
        for batch in batches:
            yield encode(batch)

    return items.mapInPandas(run, schema)


def encode_users_with(
    windows: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str = "user_id long, vector array<double>"
) -> DataFrame:
    """Padded histories (with item vectors, if joined before) -> user vectors."""
    return encode_items_with(windows, factory, schema)


def group_apply(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    segment_rows: int = SEGMENT_LENGTH,
    **skew,
) -> DataFrame:
    """A user-supplied pandas function per group, rows in ``order``.

    A group of more than ``segment_rows`` rows is handed over in consecutive segments (column ``segment``), so
    no task ever holds an unbounded group, and ``merge`` turns the results of a group's segments (in their
    order) into the result of the group.  Without ``merge`` such a group is an error: its answer would depend
    on where it is cut.
    """
    placed = positions(df, keys, [F.col(c) for c in order], "_pos", **skew)
    cut = placed.withColumn("segment", F.floor((F.col("_pos") - 1) / segment_rows).cast("int"))
    # Python's work per group is large beside its bytes: set numbers keep Spark from merging partitions by bytes.
    wide = 2 * slots(df.sparkSession)
    cut = cut.repartition(wide, *keys, "segment")
    names = [f"_key{i}" for i in range(len(keys))]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if merge is None and key[-1] > 0:
            raise ValueError(f"group {key[:-1]} has more than {segment_rows} rows: group_apply needs a merge function")
        out = function(rows.sort_values("_pos").drop(columns="_pos"))
        return out if merge is None else out.assign(**dict(zip([*names, "_segment"], key, strict=True)))

    if merge is None:
        return cut.groupBy(*keys, "segment").applyInPandas(run, schema)
    hidden = ", ".join(f"{n} {df.schema[k].dataType.simpleString()}" for n, k in zip(names, keys, strict=True))
    parts = cut.groupBy(*keys, "segment").applyInPandas(run, f"{schema}, {hidden}, _segment int")

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        return merge(rows.sort_values("_segment", kind="stable").drop(columns=[*names, "_segment"]).reset_index(drop=True))

    return parts.repartition(wide, *names).groupBy(*names).applyInPandas(joined, schema)
