"""User-supplied tokenizers, encoders, metrics and group functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.catalog.joins import part_items
from pathloom.catalog.registry import query
from pathloom.catalog.tables import (
    HABIT, ORDER_A, PLACED_A, VECTORS, habit_recs, hot, item_vectors, log_a, placed_a, table, user_vectors,
)
from pathloom.operators import items, metrics
from pathloom.operators.sequences import eval_split
from pathloom.operators.vectors import lookup_vectors


def word_lengths():
    """A stand-in tokenizer: the length of each word is its token id."""
    return lambda text: [len(w) for w in text.split(" ")]


@query("tokenize_with", "doc_id:i tokens:a", """
SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS tokens FROM documents""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return items.tokenize_with(docs, "text", word_lengths).drop("text")


def shape_encoder():
    """A stand-in batch encoder: three numbers from an item's text and size."""
    import pandas as pd

    def encode(batch):
        name = batch["p_name"].str.len().astype("float64")
        brand = batch["p_brand"].str.len().astype("float64")
        size = batch["p_size"].astype("float64")
        rows = list(zip(name, brand, size / (name + brand)))
        return pd.DataFrame({"item_id": batch["item_id"].astype("int64"), "vector": [list(r) for r in rows]})

    return encode


@query("encode_items_with", "item_id:i x:d y:d z:d", """
SELECT p_partkey + 1 AS item_id, length(p_name) AS x, length(p_brand) AS y, p_size / (length(p_name) + length(p_brand)) AS z FROM part""")
def _(spark, sf):
    coded = items.encode_items_with(part_items(spark, sf), shape_encoder)
    return coded.select("item_id", *[F.get("vector", F.lit(i)).alias(c) for i, c in enumerate("xyz")])


def mean_encoder():
    """A user-supplied user encoder that must agree with the built-in one: normalised mean vector."""
    import numpy as np
    import pandas as pd

    def encode(batch):
        out = []
        for rows in batch["vector"]:
            mean = np.stack([np.asarray(r, dtype="float64") for r in rows]).mean(axis=0)
            out.append(list(mean / np.linalg.norm(mean)))
        return pd.DataFrame({"user_id": batch["user_id"].astype("int64"), "vector": out})

    return encode


USERS_SQL = f"WITH {VECTORS} SELECT user_id, unnest(range(0, len(u))) AS dim, unnest(u) AS value FROM users"


@query("encode_users_with", "user_id:i dim:i value:d", USERS_SQL)
def _(spark, sf):
    windows = eval_split(placed_a(spark, sf), 10)
    with_vectors = lookup_vectors(windows, item_vectors(spark, sf), ["user_id"], frequent=hot(spark, sf, "a", "item_id"))
    coded = items.encode_users_with(with_vectors, mean_encoder)
    return coded.select("user_id", F.posexplode("vector").alias("dim", "value"))


@query("mean_user_vectors", "user_id:i dim:i value:d", USERS_SQL)
def _(spark, sf):
    """The built-in user encoder."""
    return user_vectors(spark, sf).select("user_id", F.posexplode("vector").alias("dim", "value"))


@query("register_metric", "metric:s value:d", f"""
WITH {HABIT}, u AS (SELECT user_id, min(CASE WHEN hit = 1 THEN rank END) AS first FROM recs GROUP BY user_id)
SELECT 'firsthit' AS metric, round(avg(first), 5) AS value FROM u""")
def _(spark, sf):
    """A new metric: mean rank of the first hit among users with one."""
    if "firsthit" not in metrics.METRICS:
        first = metrics.Metric(
            "hits", lambda i: {"firsthit": F.avg(F.get("hit_ranks", F.lit(0)))}, smaller_is_better=True
        )
        metrics.register_metric("firsthit", first)
    return metrics.evaluate(["firsthit"], 20, recs=habit_recs(spark, sf))


def first_and_last(rows):
    """A stand-in group function: what a history starts and ends with."""
    import pandas as pd

    first, last = rows.iloc[0], rows.iloc[-1]
    return pd.DataFrame(
        {"user_id": [first["user_id"]], "segment": [first["segment"]], "events": [len(rows)],
         "first_item": [first["item_id"]], "last_item": [last["item_id"]], "total": [float(rows["value"].sum())]}
    )


def joined_segments(parts):
    """The same from the results of a history's segments."""
    import pandas as pd

    first, last = parts.iloc[0], parts.iloc[-1]
    return pd.DataFrame(
        {"user_id": [first["user_id"]], "segment": [first["segment"]], "events": [int(parts["events"].sum())],
         "first_item": [first["first_item"]], "last_item": [last["last_item"]], "total": [float(parts["total"].sum())]}
    )


@query("group_apply", "user_id:i segment:i events:i first_item:i last_item:i total:d", f"""
WITH {PLACED_A} SELECT user_id, 0 AS segment, count(*) AS events, arg_min(item_id, pos) AS first_item,
  arg_max(item_id, pos) AS last_item, sum(value) AS total FROM placed GROUP BY user_id""")
def _(spark, sf):
    rows = log_a(spark, sf).select("user_id", "item_id", "event_time", "event_no", "value")
    return items.group_apply(
        rows, ["user_id"], ORDER_A, first_and_last,
        "user_id int, segment int, events long, first_item int, last_item int, total double", joined_segments,
        frequent=hot(spark, sf, "a", "user_id"),
    )
