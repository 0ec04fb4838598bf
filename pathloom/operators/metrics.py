"""Offline quality metrics.

A metric names the table it reads and gives aggregate expressions; ``evaluate`` runs one
aggregation per table however many metrics are asked for.  Tables:

* ``hits``       one row per user: sorted ranks of the hits in the top-k list, ``pos_len``
* ``exposure``   one row per item: how often it is recommended within each k
* ``histogram``  per k, how many items share an exposure count, in count order
* ``slots``      one row per recommended (user, rank): item popularity, long-tail flag
* ``mean_rank``  one row per user: rank sum of positives, candidates, positives
* ``scored``     one row per prediction: ``pred, label``
* ``curve``      one row per distinct score: true and false positives from the top down
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.scores import METRIC_PLACES, round_metric
from pathloom.operators.selection import parts_at
from pathloom.operators.skew import frequent_keys, lookup, running_sums

# Fixed value: probabilities are kept this far from 0 and 1 in the log loss.
LOGLOSS_EPS = 1e-15


# Fixed value: the share of items that are the long tail where none is asked for.
TAIL = 0.1


@dataclass(frozen=True)
class Inputs:
    """What an evaluation may read; only the tables the chosen metrics need must be given.

    ``recs``: user_id, rank, item_id, hit, pos_len (see ``ranking.mark_positives``).
    """

    topk: Sequence[int] = ()
    recs: DataFrame | None = None
    mean_rank: DataFrame | None = None
    scored: DataFrame | None = None
    item_count: int | None = None
    popularity: DataFrame | None = None
    tail: float | None = TAIL
    exposure: DataFrame | None = None
    score_counts: DataFrame | None = None


@dataclass(frozen=True)
class Metric:
    """``weight``: what values of several shards are averaged by (``squared``: as squares); the rows unless given."""

    table: str
    build: Callable[[Inputs], dict[str, Column]]
    kind: str = "ranking"
    needs: tuple[str, ...] = ("recs",)
    smaller_is_better: bool = False
    weight: Callable[[], Column] = lambda: F.count(F.lit(1))
    squared: bool = False


def _at(name: str, make: Callable[[int, int], Column]) -> Callable[[Inputs], dict[str, Column]]:
    """Expressions ``name@k`` for each k; ``make(k, K)`` with K the longest list."""
    return lambda i: {f"{name}@{k}": make(k, max(i.topk)) for k in i.topk}


def _within(k: int) -> Column:
    return F.filter("hit_ranks", lambda r: r <= k)


def _per_user(value: Column) -> Column:
    return F.avg(F.coalesce(value.cast("double"), F.lit(0.0)))


def _hit(k: int, top: int) -> Column:
    return _per_user((F.size(_within(k)) > 0).cast("int"))


def _mrr(k: int, top: int) -> Column:
    first = F.get("hit_ranks", F.lit(0))
    return _per_user(F.when(first <= k, 1 / first))


def _map(k: int, top: int) -> Column:
    precision = F.transform(_within(k), lambda r, i: (i + 1) / r)
    total = F.aggregate(precision, F.lit(0.0), lambda acc, x: acc + x)
    return _per_user(F.try_divide(total, F.least(F.lit(k), F.lit(top), F.col("pos_len"))))


def _recall(k: int, top: int) -> Column:
    return _per_user(F.try_divide(F.size(_within(k)), F.col("pos_len")))


def _ndcg(k: int, top: int) -> Column:
    ideal, total = [], 0.0
    for r in range(1, k + 1):
        total += 1 / math.log2(r + 1)
        ideal.append(total)
    gains = F.transform(_within(k), lambda r: 1 / F.log2((r + 1).cast("double")))
    gained = F.aggregate(gains, F.lit(0.0), lambda acc, x: acc + x)
    best = F.get(F.array(*[F.lit(x) for x in ideal]), F.least(F.lit(k), F.col("pos_len")).cast("int") - 1)
    return _per_user(F.try_divide(gained, best))


def _precision(k: int, top: int) -> Column:
    return _per_user(F.size(_within(k)) / F.lit(k))


def _ranked_positives() -> Column:
    """Positives of the users that have negatives too."""
    pos = F.col("positives").cast("double")
    return F.sum(F.when((pos > 0) & (F.col("candidates") - pos > 0), pos))


def _predictions() -> Column:
    return F.count(F.col("pred") + F.col("label"))


def _ranked_users() -> Column:
    return F.count(F.when(F.col("rank") == 1, 1))


def _gauc(_: Inputs) -> dict[str, Column]:
    pos, total = F.col("positives").cast("double"), F.col("candidates").cast("double")
    usable = (pos > 0) & (total - pos > 0)
    pairs = (total + 1) * pos - pos * (pos + 1) / 2 - F.col("pos_rank_sum")
    auc = F.try_divide(pairs, (total - pos) * pos)
    return {"gauc": F.try_divide(F.sum(F.when(usable, auc * pos)), _ranked_positives())}


def _auc(_: Inputs) -> dict[str, Column]:
    # Each negative at a score loses to the positives above it and half of those beside it.
    won = F.sum(F.col("neg") * (F.col("tps") - F.col("pos") / 2))
    value = F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg"))
    return {"auc": F.coalesce(value, F.lit(float("nan")))}


def _mae(_: Inputs) -> dict[str, Column]:
    return {"mae": F.avg(F.abs(F.col("pred") - F.col("label")))}


def _rmse(_: Inputs) -> dict[str, Column]:
    gap = F.col("pred") - F.col("label")
    return {"rmse": F.sqrt(F.avg(gap * gap))}


def _logloss(_: Inputs) -> dict[str, Column]:
    p = F.greatest(F.least(F.col("pred").cast("double"), F.lit(1 - LOGLOSS_EPS)), F.lit(LOGLOSS_EPS))
    y = F.col("label").cast("double")
    return {"logloss": F.avg(-y * F.log(p) - (1 - y) * F.log(1 - p))}


def _coverage(i: Inputs) -> dict[str, Column]:
    return {f"itemcoverage@{k}": F.count(F.when(F.col(f"c_{k}") > 0, 1)) / F.lit(i.item_count) for k in i.topk}


def _entropy(i: Inputs) -> dict[str, Column]:
    """Entropy of the exposure, divided by the number of items exposed."""
    out = {}
    for k in i.topk:
        c = F.col(f"c_{k}").cast("double")
        shown, total = F.count(F.when(c > 0, 1)), F.sum(c)
        weighted = F.sum(F.when(c > 0, c * F.log(c)))
        out[f"shannonentropy@{k}"] = (F.log(total) - weighted / total) / shown
    return out


def _gini(i: Inputs) -> dict[str, Column]:
    n = i.item_count
    out = {}
    for k in i.topk:
        here = F.col("k") == k
        c, m = F.col("c").cast("double"), F.col("items").cast("double")
        # The m items with the same count sit at places first+1 .. first+m of n.
        first = n - F.col("shown") + F.col("before")
        share = c * (2 * (m * first + m * (m + 1) / 2) - m * (n + 1))
        out[f"giniindex@{k}"] = F.sum(F.when(here, share)) / F.sum(F.when(here, c * m)) / n
    return out


def _slot_mean(name: str, column: str) -> Callable[[Inputs], dict[str, Column]]:
    def build(i: Inputs) -> dict[str, Column]:
        return {
            f"{name}@{k}": F.sum(F.when(F.col("rank") <= k, F.col(column)).otherwise(0)) / (_ranked_users() * k) for k in i.topk
        }

    return build


METRICS: dict[str, Metric] = {
    "hit": Metric("hits", _at("hit", _hit)),
    "mrr": Metric("hits", _at("mrr", _mrr)),
    "map": Metric("hits", _at("map", _map)),
    "recall": Metric("hits", _at("recall", _recall)),
    "ndcg": Metric("hits", _at("ndcg", _ndcg)),
    "precision": Metric("hits", _at("precision", _precision)),
    "gauc": Metric("mean_rank", _gauc, needs=("mean_rank",), weight=_ranked_positives),
    "auc": Metric("curve", _auc, kind="value", needs=("scored",)),
    "mae": Metric("scored", _mae, kind="value", needs=("scored",), smaller_is_better=True, weight=_predictions),
    "rmse": Metric("scored", _rmse, kind="value", needs=("scored",), smaller_is_better=True, weight=_predictions, squared=True),
    "logloss": Metric("scored", _logloss, kind="value", needs=("scored",), smaller_is_better=True, weight=_predictions),
    "itemcoverage": Metric("exposure", _coverage, needs=("recs", "item_count")),
    "averagepopularity": Metric(
        "slots", _slot_mean("averagepopularity", "popularity"), needs=("recs", "popularity"), smaller_is_better=True,
        weight=_ranked_users,
    ),
    "shannonentropy": Metric("exposure", _entropy),
    "giniindex": Metric("histogram", _gini, needs=("recs", "item_count"), smaller_is_better=True),
    "tailpercentage": Metric("slots", _slot_mean("tailpercentage", "is_tail"), needs=("recs", "popularity"), weight=_ranked_users),
}


def register_metric(name: str, metric: Metric) -> None:
    """Add a metric under a new (lower-case) name."""
    if name != name.lower() or name in METRICS:
        raise ValueError(f"metric name {name!r} must be new and lower case")
    if metric.kind not in ("ranking", "value") or metric.table not in TABLES:
        raise ValueError("a metric needs kind 'ranking' or 'value' and a known table")
    METRICS[name] = metric


# ---- the tables ---------------------------------------------------------------------------


def hit_table(i: Inputs) -> DataFrame:
    top = max(i.topk)
    ranks = F.array_sort(F.collect_list(F.when((F.col("hit") == 1) & (F.col("rank") <= top), F.col("rank").cast("int"))))
    return i.recs.groupBy("user_id").agg(ranks.alias("hit_ranks"), F.max("pos_len").alias("pos_len"))


def exposure_table(i: Inputs) -> DataFrame:
    if i.exposure is not None:
        return i.exposure
    counts = [F.count(F.when(F.col("rank") <= k, 1)).alias(f"c_{k}") for k in i.topk]
    return i.recs.groupBy("item_id").agg(*counts)


def exposure_histogram(i: Inputs) -> DataFrame:
    """Items per exposure count.  With T recommendations there are at most sqrt(2 T) distinct counts,
    so the window over one k stays small."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c_{k}").alias("c")) for k in i.topk])
    counts = (
        exposure_table(i).select(F.inline(pairs)).filter(F.col("c") > 0)
        .groupBy("k", "c").agg(F.count(F.lit(1)).alias("items"))
    )
    lower = Window.partitionBy("k").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        "*",
        F.coalesce(F.sum("items").over(lower), F.lit(0)).alias("before"),
        F.sum("items").over(Window.partitionBy("k")).alias("shown"),
    )


def attach_popularity(recs: DataFrame, popularity: DataFrame, **skew) -> DataFrame:
    """``popularity``: interactions of the recommended item, 0 if it has none."""
    table = popularity.select("item_id", F.col("n").alias("popularity"))
    return lookup(recs, table, "item_id", **skew).withColumn("popularity", F.coalesce("popularity", F.lit(0)))


def tail_items(popularity: DataFrame, tail: float | None = TAIL) -> DataFrame:
    """Long-tail items.  A ``tail`` above 1 is the largest interaction count of one, else the share of the items
    that count as the rarest (whole items, at least one; of equally rare ones the smaller ids)."""
    asked = tail if tail and tail > 0 else TAIL
    if asked > 1:
        return popularity.filter(F.col("n") <= asked).select("item_id")
    rarest = parts_at(popularity, F.col("n").cast("long"), F.col("item_id"), lambda items: [max(1, int(items * asked))], "_rarer")
    return rarest.filter(F.col("_rarer") == 0).select("item_id")


def flag_tail_items(recs: DataFrame, tail: DataFrame, **skew) -> DataFrame:
    """``is_tail``: 1 for recommended long-tail items."""
    flagged = lookup(recs, tail.withColumn("is_tail", F.lit(1)), "item_id", **skew)
    return flagged.withColumn("is_tail", F.coalesce("is_tail", F.lit(0)))


def slot_table(i: Inputs) -> DataFrame:
    # A popular item may be recommended to a large share of all users.
    hot = frequent_keys(i.recs, "item_id")
    with_counts = attach_popularity(i.recs, i.popularity, frequent=hot)
    return flag_tail_items(with_counts, tail_items(i.popularity, i.tail), frequent=hot)


def score_counts(scored: DataFrame) -> DataFrame:
    """``pred, pos, neg``: positives and negatives at each distinct score."""
    return scored.groupBy("pred").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") != 1, 1)).alias("neg")
    )


def roc_points(scored: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``pred, pos, neg, tps, fps``: positives and negatives at each distinct score and from the top down to it."""
    counts = score_counts(scored) if counts is None else counts
    return running_sums(counts, [F.col("pred").desc()], {"pos": "tps", "neg": "fps"})


TABLES: dict[str, Callable[[Inputs], DataFrame]] = {
    "hits": hit_table,
    "exposure": exposure_table,
    "histogram": exposure_histogram,
    "slots": slot_table,
    "mean_rank": lambda i: i.mean_rank,
    "scored": lambda i: i.scored,
    "curve": lambda i: roc_points(i.scored, i.score_counts),
}


# ---- evaluation ---------------------------------------------------------------------------


def check_request(metrics: Sequence[str], topk: int | Sequence[int] | None) -> tuple[list[str], list[int]]:
    """Metric names in lower case and the list of cutoffs, if the ``Metric`` records can serve them together."""
    cutoffs = list(topk) if isinstance(topk, (list, tuple)) else [] if topk is None else [topk]
    odd = [k for k in cutoffs if not isinstance(k, int) or isinstance(k, bool)]
    if odd:
        raise TypeError(f"cutoffs are whole numbers, not {odd}")
    if min(cutoffs, default=1) < 1:
        raise ValueError(f"cutoffs start at 1: {cutoffs}")
    wanted = [metrics] if isinstance(metrics, str) else list(metrics)
    records = {name.lower(): METRICS.get(name.lower()) for name in wanted}
    unknown = sorted(name for name, record in records.items() if record is None)
    if unknown:
        raise NotImplementedError(f"not among the metrics: {unknown}")
    kinds = {record.kind for record in records.values()}
    if len(kinds) > 1:
        raise RuntimeError(f"one evaluation serves one kind of metric, not {sorted(kinds)}")
    return list(records), cutoffs


def evaluate(
    metrics: Sequence[str], topk: int | Sequence[int] | None = None, places: int | None = METRIC_PLACES, **tables
) -> DataFrame:
    """``metric, value``: one row per metric (and k), rounded to ``places``."""
    names, ks = check_request(metrics, topk)
    inputs = Inputs(topk=ks, **tables)
    for name in names:
        missing = [n for n in METRICS[name].needs if getattr(inputs, n) is None]
        if missing:
            raise ValueError(f"metric {name!r} needs {missing}")
    grouped: dict[str, dict[str, Column]] = {}
    for name in names:
        grouped.setdefault(METRICS[name].table, {}).update(METRICS[name].build(inputs))
    result = None
    for table, expressions in grouped.items():
        row = TABLES[table](inputs).agg(*[e.cast("double").alias(label) for label, e in expressions.items()])
        value = (lambda c: round_metric(F.col(c), places)) if places is not None else F.col
        pairs = [F.struct(F.lit(c).alias("metric"), value(f"`{c}`").alias("value")) for c in expressions]
        long = row.select(F.inline(F.array(*pairs)))
        result = long if result is None else result.unionByName(long)
    return result


def valid_score(results: DataFrame, metric: str | None = None) -> DataFrame:
    """The monitored value and whether larger is better; ``recall@10`` unless named."""
    name = (metric or "recall@10").lower()
    base = name.split("@")[0]
    if base not in METRICS:
        raise NotImplementedError(f"there is no metric named {base!r}")
    bigger = not METRICS[base].smaller_is_better
    return results.filter(F.col("metric") == name).withColumn("bigger_is_better", F.lit(bigger))
