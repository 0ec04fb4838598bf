"""Evaluation states: partial sums that shards write and one step turns into metric values.

A state is a table ``state, label, item_id, pred, total, weight``:

* ``mean``      one row per metric (and k): its value on the shard times its weight, and the weight
* ``exposure``  one row per item and cutoff (``label``): how often the item is recommended within it
* ``curve``     one row per distinct score: positives (``total``) and negatives (``weight``)

States add up: those of shards that hold whole users and share no row give the values of one run over all
rows, whatever the shards are, and merging never reads the shards' rows again.  Metrics of other tables than
these are averaged by their weight, so a registered metric must be a weighted mean to be merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.scores import METRIC_PLACES, round_metric
from pathloom.operators.metrics import METRICS, TABLES, Inputs, check_request, evaluate, exposure_table, score_counts

_BY_ITEM = ("exposure", "histogram")
_KEYS = ("state", "label", "item_id", "pred")


def _row(state: str, label: Column, total: Column, weight: Column, item: Column | None = None, pred: Column | None = None) -> list[Column]:
    none = F.lit(None)
    return [
        F.lit(state).alias("state"), label.cast("string").alias("label"), (none if item is None else item).cast("string").alias("item_id"),
        (none if pred is None else pred).cast("double").alias("pred"), total.cast("double").alias("total"), weight.cast("double").alias("weight"),
    ]


def evaluation_state(metrics: Sequence[str], topk: int | Sequence[int] | None = None, **tables) -> DataFrame:
    """The state of one shard; arguments as those of ``evaluate``."""
    names, ks = check_request(metrics, topk)
    inputs = Inputs(topk=ks, **tables)
    out = []
    for table in sorted({METRICS[n].table for n in names} - {*_BY_ITEM, "curve"}):
        values = {c: (METRICS[n], e) for n in names if METRICS[n].table == table for c, e in METRICS[n].build(inputs).items()}
        one = TABLES[table](inputs).agg(
            *[e.cast("double").alias(f"v{i}") for i, (_, e) in enumerate(values.values())],
            *[m.weight().cast("double").alias(f"w{i}") for i, (m, _) in enumerate(values.values())],
        )
        pairs = []
        for i, (label, (metric, _)) in enumerate(values.items()):
            value = F.col(f"v{i}") * F.col(f"v{i}") if metric.squared else F.col(f"v{i}")
            weight = F.coalesce(F.col(f"w{i}"), F.lit(0.0))
            pairs.append(F.struct(*_row("mean", F.lit(label), F.coalesce(value * weight, F.lit(0.0)), weight)))
        out.append(one.select(F.inline(F.array(*pairs))))
    if any(METRICS[n].table in _BY_ITEM for n in names):
        counts = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c_{k}").alias("c")) for k in ks])
        shown = exposure_table(inputs).select("item_id", F.inline(counts)).filter("c > 0")
        out.append(shown.select(*_row("exposure", F.col("k"), F.col("c"), F.lit(0), item=F.col("item_id"))))
    if any(METRICS[n].table == "curve" for n in names):
        out.append(score_counts(inputs.scored).select(*_row("curve", F.lit(None), F.col("pos"), F.col("neg"), pred=F.col("pred"))))
    state = out[0]
    for more in out[1:]:
        state = state.unionByName(more)
    return state


def merge_states(*states: DataFrame) -> DataFrame:
    """One state from several (or from one table that holds the rows of several)."""
    rows = states[0]
    for more in states[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(*_KEYS).agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))


def state_values(
    state: DataFrame, metrics: Sequence[str], topk: int | Sequence[int] | None = None, item_count: int | None = None,
    places: int | None = METRIC_PLACES,
) -> DataFrame:
    """``metric, value`` as ``evaluate`` gives them, from a state (merged or not) alone."""
    names, ks = check_request(metrics, topk)
    shown = (lambda c: round_metric(c, places)) if places is not None else (lambda c: c)
    out = []
    means = [n for n in names if METRICS[n].table not in (*_BY_ITEM, "curve")]
    if means:
        base = F.split("label", "@")[0]
        value = F.try_divide(F.sum("total"), F.sum("weight"))
        squared = [n for n in means if METRICS[n].squared]
        value = F.when(base.isin(squared), F.sqrt(value)).otherwise(value)
        labels = [c for n in means for c in METRICS[n].build(Inputs(topk=ks))]
        kept = state.filter((F.col("state") == "mean") & F.col("label").isin(labels))
        out.append(kept.groupBy("label").agg(value.alias("value")).select(F.col("label").alias("metric"), shown(F.col("value")).alias("value")))
    given: dict = {"item_count": item_count}
    if by_item := [n for n in names if METRICS[n].table in _BY_ITEM]:
        counts = [F.sum(F.when(F.col("label") == str(k), F.col("total")).otherwise(0)).cast("long").alias(f"c_{k}") for k in ks]
        given["exposure"] = given["recs"] = state.filter("state = 'exposure'").groupBy("item_id").agg(*counts)
    if by_score := [n for n in names if METRICS[n].table == "curve"]:
        sums = F.sum("total").cast("long").alias("pos"), F.sum("weight").cast("long").alias("neg")
        given["score_counts"] = given["scored"] = state.filter("state = 'curve'").groupBy("pred").agg(*sums)
    if by_item or by_score:
        out.append(evaluate([*by_item, *by_score], ks, places, **given))
    values = out[0]
    for more in out[1:]:
        values = values.unionByName(more)
    return values
