"""Padded training examples and item descriptions -> packed token examples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.arrays import token_layout
from pathloom.operators.items import item_texts
from pathloom.operators.skew import lookup

_LAYOUT = "struct<input_ids:array<int>,input_len:int,position_ids:array<int>>"


def text_training_examples(
    examples: DataFrame,
    items: DataFrame,
    keys: Sequence[str],
    prompt: str,
    tokens: Callable[[DataFrame], DataFrame],
    limit: int,
    slots: int = 1,
    **skew,
) -> DataFrame:
    """The columns of ``examples`` (see ``training_examples``) and, for positives and negatives, the tokens of
    their items end to end: ``pos_input_ids, pos_input_lens, pos_position_ids`` and the same with ``neg_``.

    ``tokens`` adds an ``array<int>`` column ``tokens`` to a table with ``text``; it sees every item's text
    once, however many examples hold the item.  A text keeps ``limit`` tokens and gets ``slots`` zeros.  Places
    with padding or an unknown item get the tokens of the empty text.  Positives and negatives go through one
    join; the other columns travel with the first place of an example.
    """
    laid = lambda rows: token_layout(F.col("tokens").cast("array<int>"), limit, slots).cast(_LAYOUT)
    texts = item_texts(items, keys, prompt)
    table = tokens(texts).select("item_id", laid(texts).alias("t"))
    blank = examples.sparkSession.range(1).select(F.lit("").alias("text"))
    none = tokens(blank).select(laid(blank).alias("t")).first()["t"]  # one value, for all blank places
    empty = F.struct(
        F.lit(list(none["input_ids"])).cast("array<int>").alias("input_ids"), F.lit(none["input_len"]).alias("input_len"),
        F.lit(list(none["position_ids"])).cast("array<int>").alias("position_ids"),
    )
    whole = F.struct(*[c for c in examples.columns if c not in ("user_id", "seq_no")])
    places = examples.select("user_id", "seq_no", whole.alias("_row"), F.posexplode(F.concat("item_seq", "neg_item")).alias("_place", "item_id"))
    # Padding meets no item: its keys differ, so that it does not gather in one task.
    spread = -1 - F.pmod(F.xxhash64("user_id", "seq_no", "_place"), F.lit(1 << 30))
    places = places.select(
        "user_id", "seq_no", "_place", F.when(F.col("_place") == 0, F.col("_row")).alias("_row"),
        F.when(F.col("item_id") > 0, F.col("item_id")).otherwise(spread).alias("item_id"),
    )
    found = lookup(places, table, "item_id", **skew)
    ordered = F.array_sort(F.collect_list(F.struct("_place", F.coalesce("t", empty.cast(_LAYOUT)).alias("t"))))
    packed = found.groupBy("user_id", "seq_no").agg(F.first("_row", ignorenulls=True).alias("_row"), ordered["t"].alias("_all"))
    n_pos, n_neg = F.size("_row.item_seq"), F.size("_row.neg_item")
    out = packed.select(
        "user_id", "seq_no", "_row.*", F.slice("_all", F.lit(1), n_pos).alias("_pos"), F.slice("_all", n_pos + 1, n_neg).alias("_neg")
    )
    for side in ("pos", "neg"):
        of = f"_{side}"
        out = out.withColumns({
            f"{side}_input_ids": F.flatten(F.col(of)["input_ids"]), f"{side}_input_lens": F.col(of)["input_len"],
            f"{side}_position_ids": F.flatten(F.col(of)["position_ids"]),
        })
    return out.drop("_pos", "_neg")
