"""User and item vectors -> ranked recommendations and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.metrics import METRICS, check_request, evaluate
from pathloom.operators.ranking import mark_positives, top_k_items
from pathloom.operators.scoring import ItemBlocks, full_sort_scores, mean_rank, seen_bits, target_rank
from pathloom.operators.skew import lookup
from pathloom.session import save_shared


def recommend(
    users: DataFrame, items: DataFrame | ItemBlocks, k: int, seen: DataFrame | None = None, block: int | None = None,
    bits: DataFrame | None = None,
) -> DataFrame:
    """``user_id, item_id, score, rank``: the best ``k`` unseen items per user."""
    return top_k_items(full_sort_scores(users, items, k, seen, block, bits), k)


def hits_of_targets(ranked: DataFrame, k: int) -> DataFrame:
    """The hits of the top-k lists from ``target_rank``, without ranking all candidates.

    ``user_id, rank, item_id, hit, pos_len``; a target outside the list (or suppressed, which
    ranks it behind all candidates) keeps a row without a rank.  Enough for hit, mrr, map,
    recall, ndcg and precision.
    """
    hit = (F.col("rank") <= k) & (F.col("rank") <= F.col("candidates"))
    positives = ranked.groupBy("user_id").agg(F.count(F.lit(1)).alias("pos_len"))
    flagged = ranked.select(
        "user_id", F.when(hit, F.col("rank")).alias("rank"), "item_id", F.when(hit, 1).otherwise(0).alias("hit")
    )
    return lookup(flagged, positives, "user_id", "inner")


def evaluate_vectors(
    users: DataFrame,
    items: DataFrame,
    targets: DataFrame,
    metrics: Sequence[str],
    topk: Sequence[int],
    seen: DataFrame | None = None,
    popularity: DataFrame | None = None,
    tail: float | None = None,
    item_count: int | None = None,
    block: int | None = None,
) -> DataFrame:
    """``metric, value`` for ranking metrics, computing only what the chosen metrics need.

    ``tail`` is that of ``tail_items``: a share of the items or a largest count.
    """
    names, ks = check_request(metrics, topk)
    tables = {METRICS[n].table for n in names}
    if not ks:
        raise ValueError("evaluate_vectors needs at least one cutoff in topk")
    # Each is read by several steps below: compute once, share as tables.  Whatever is asked, the users
    # evaluated are those with a vector and a target, with all their targets.
    targets = targets.select("user_id", "item_id").distinct()
    users = save_shared(users.join(targets.select("user_id").distinct(), "user_id", "left_semi"), "users")
    targets = save_shared(targets.join(users.select("user_id"), "user_id", "left_semi"), "targets")
    items, bits = ItemBlocks(items, block), None
    if seen is not None:
        seen = seen.join(users.select("user_id"), "user_id", "left_semi")
        seen = save_shared(seen.select("user_id", "item_id").distinct(), "seen")
        bits = save_shared(seen_bits(seen, users, items), "seen-bits")
    given: dict = {"popularity": popularity, "item_count": item_count, "tail": tail}
    if tables & {"exposure", "histogram", "slots"}:
        recs = mark_positives(recommend(users, items, max(ks), seen, bits=bits), targets)
        given["recs"] = save_shared(recs, "recs")
    if "mean_rank" in tables or ("hits" in tables and "recs" not in given):
        ranked = save_shared(target_rank(users, items, targets, seen, bits=bits), "target-ranks")
        given["mean_rank"] = mean_rank(ranked)
        given.setdefault("recs", hits_of_targets(ranked, max(ks)))
    return evaluate(names, ks, **given)
