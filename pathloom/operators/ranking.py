"""Rankings per user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.skew import frequent_keys, lookup, positions


def top_k_items(scored: DataFrame, k: int, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """``rank`` 1 .. k per user, by score descending then item id.

    Spark cuts every map task to ``k`` rows per user before the shuffle (WindowGroupLimit).
    """
    best = Window.partitionBy(user).orderBy(F.col("score").desc(), F.col(item).asc())
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def full_ranking(scored: DataFrame, user: str = "user_id", item: str = "item_id", **skew) -> DataFrame:
    """``rank`` of every candidate, by score descending then item id."""
    return positions(scored, [user], [F.col("score").desc(), F.col(item).asc()], "rank", **skew)


def average_rank(
    scored: DataFrame,
    user: str = "user_id",
    descending: bool = True,
    frequent: list | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """``avg_rank``: rank within the user with ties averaged (the middle of the tied places)."""
    score = F.col("score")
    if frequent is None:
        frequent = frequent_keys(scored, user, min_rows)
    placed = positions(scored, [user], [score.desc() if descending else score.asc()], "_place", frequent=frequent)
    if not frequent:
        tied = Window.partitionBy(user, "score")  # within the shuffle by user
        middle = (F.min("_place").over(tied) + F.max("_place").over(tied)) / 2
        return placed.withColumn("avg_rank", middle).drop("_place")
    # A text key, which a null user or score has too; adding zero makes both zeros one.
    tie = F.to_json(F.struct(F.col(user), (score + F.lit(0.0)).alias("score")))
    ties = placed.groupBy(tie.alias("_tie")).agg(((F.min("_place") + F.max("_place")) / 2).alias("avg_rank"))
    return lookup(scored.withColumn("_tie", tie), ties, "_tie", "inner", min_rows=min_rows).drop("_tie")


def mark_positives(recs: DataFrame, targets: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """``hit`` (0/1) per recommended row and ``pos_len``, the user's number of positives.

    Positives are distinct (user, item) pairs, so neither join has a repeated key on the right.
    """
    pairs = targets.select(user, item).distinct()
    counts = pairs.groupBy(user).agg(F.count(F.lit(1)).alias("pos_len"))
    flagged = recs.join(pairs.withColumn("hit", F.lit(1)), [user, item], "left")
    return flagged.join(counts, user, "left").withColumns(
        {"hit": F.coalesce("hit", F.lit(0)), "pos_len": F.coalesce("pos_len", F.lit(0))}
    )


def suppress_history(candidates: DataFrame, seen: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Candidates the user has not met yet; id 0 (padding) is never a candidate."""
    return candidates.filter(F.col(item) != 0).join(seen.select(user, item).distinct(), [user, item], "left_anti")


def running_hits(recs: DataFrame, user: str = "user_id") -> DataFrame:
    """``hits_so_far`` down the (bounded) top-k list of each user."""
    down = Window.partitionBy(user).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return recs.withColumn("hits_so_far", F.sum("hit").over(down))


def sort_multi(df: DataFrame, *keys: tuple[str, str], tie: Sequence[str] = ()) -> DataFrame:
    """Rows ordered by ``(column, "asc" | "desc")`` pairs, then by the ``tie`` columns ascending."""
    way = {"asc": Column.asc, "desc": Column.desc}
    odd = [direction for _, direction in keys if direction not in way]
    if odd:
        raise ValueError(f"a direction is 'asc' or 'desc', not {odd}")
    return df.orderBy(*[way[direction](F.col(name)) for name, direction in [*keys, *((name, "asc") for name in tie)]])
