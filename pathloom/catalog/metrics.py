"""Offline evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.catalog.registry import query
from pathloom.catalog.tables import (
    HABIT, SCORED, VECTORS, habit_recs, scored_documents, seen_a, targets_a, train_popularity,
    unit_item_vectors, user_vectors,
)
from pathloom.operators import metrics, scoring, states
from pathloom.plans.evaluation import evaluate_vectors

TOPK = [1, 5, 10, 20]
KS = "(VALUES (1), (5), (10), (20)) AS ks(k)"


def _per_user(name: str, value: str) -> str:
    """SQL for a metric that is a mean over users of ``value`` (over the first k places)."""
    return f"""
WITH {HABIT}, ranked AS (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY rank) AS run FROM recs),
per_user AS (SELECT user_id, k, {value} AS v FROM ranked CROSS JOIN {KS} GROUP BY user_id, k)
SELECT '{name}@' || k AS metric, round(avg(coalesce(v, 0)), 5) AS value FROM per_user GROUP BY k"""


def _register(name: str, sql: str, key: str | None = None, **tables):
    @query(f"{key or name}_at_k", "metric:s value:d", sql)
    def _(spark, sf):
        given = {key: make(spark, sf) for key, make in tables.items()}
        return metrics.evaluate([name], TOPK, recs=habit_recs(spark, sf), **given)


def _item_count(spark, sf):
    return train_popularity(spark, sf).count()


_register("hit", _per_user("hit", "max(CASE WHEN rank <= k THEN hit ELSE 0 END)"))
_register("mrr", _per_user("mrr", "1 / min(CASE WHEN rank <= k AND hit = 1 THEN rank END)"))
_register("map", _per_user("map", "sum(CASE WHEN rank <= k AND hit = 1 THEN run / rank ELSE 0 END) / nullif(least(k, max(pos_len)), 0)"))
_register("recall", _per_user("recall", "sum(CASE WHEN rank <= k THEN hit ELSE 0 END) / nullif(max(pos_len), 0)"))
_register("precision", _per_user("precision", "sum(CASE WHEN rank <= k THEN hit ELSE 0 END) / k"))
_register("ndcg", f"""
WITH {HABIT}, gains AS (
  SELECT user_id, k, max(pos_len) AS pos_len, sum(CASE WHEN rank <= k AND hit = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg
  FROM recs CROSS JOIN {KS} GROUP BY user_id, k),
ideal AS (SELECT m, sum(1 / log2(i + 1)) AS best FROM range(1, 21) AS a(m) JOIN range(1, 21) AS b(i) ON i <= m GROUP BY m)
SELECT 'ndcg@' || k AS metric, round(avg(coalesce(dcg / best, 0)), 5) AS value
FROM gains LEFT JOIN ideal ON m = least(k, pos_len) GROUP BY k""")

EXPOSED = f"""{HABIT}, shown AS (
  SELECT k, item_id, count(*) AS c FROM recs CROSS JOIN {KS} WHERE rank <= k GROUP BY k, item_id),
size AS (SELECT count(*) AS n FROM popularity)"""

_register("itemcoverage", f"""
WITH {EXPOSED} SELECT 'itemcoverage@' || k AS metric, round(count(*) / max(n), 5) AS value FROM shown CROSS JOIN size GROUP BY k""",
          "item_coverage", item_count=_item_count)
_register("shannonentropy", f"""
WITH {EXPOSED}, p AS (SELECT k, c / sum(c) OVER (PARTITION BY k) AS p FROM shown)
SELECT 'shannonentropy@' || k AS metric, round(sum(-p * ln(p)) / count(*), 5) AS value FROM p GROUP BY k""", "shannon_entropy")
_register("giniindex", f"""
WITH {EXPOSED}, i AS (SELECT k, c, n, n - count(*) OVER (PARTITION BY k) + row_number() OVER (PARTITION BY k ORDER BY c, item_id) AS i
  FROM shown CROSS JOIN size)
SELECT 'giniindex@' || k AS metric, round(sum((2 * i - n - 1) * c) / sum(c) / max(n), 5) AS value FROM i GROUP BY k""",
          "gini", item_count=_item_count)
_register("averagepopularity", f"""
WITH {HABIT}, u AS (SELECT count(DISTINCT user_id) AS users FROM recs)
SELECT 'averagepopularity@' || k AS metric, round(sum(CASE WHEN rank <= k THEN coalesce(n, 0) ELSE 0 END) / (max(users) * k), 5) AS value
FROM recs LEFT JOIN popularity USING (item_id) CROSS JOIN u CROSS JOIN {KS} GROUP BY k""", "average_popularity", popularity=train_popularity)
_register("tailpercentage", f"""
WITH {HABIT}, u AS (SELECT count(DISTINCT user_id) AS users FROM recs),
tail AS (SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY n, item_id) AS r, count(*) OVER () AS m FROM popularity)
  WHERE r <= greatest(floor(m * 0.1), 1))
SELECT 'tailpercentage@' || k AS metric, round(sum(CASE WHEN rank <= k AND t.item_id IS NOT NULL THEN 1 ELSE 0 END) / (max(users) * k), 5) AS value
FROM recs r LEFT JOIN tail t ON t.item_id = r.item_id CROSS JOIN u CROSS JOIN {KS} GROUP BY k""", "tail_percentage", popularity=train_popularity)

RANKED_TARGETS = f"""{VECTORS}, free AS (SELECT user_id, count(*) AS candidates FROM candidates GROUP BY user_id),
target_ranks AS (
  SELECT t.user_id, coalesce(r.rank, f.candidates + 1) AS rank, coalesce(r.avg_rank, f.candidates + 1) AS avg_rank, f.candidates,
         r.user_id IS NULL AS suppressed
  FROM targets t JOIN free f USING (user_id) LEFT JOIN ranked r ON r.user_id = t.user_id AND r.item_id = t.item_id),
mean_ranks AS (SELECT user_id, sum(avg_rank) AS pos_rank_sum, max(candidates) AS candidates, count(*) AS positives
  FROM target_ranks GROUP BY user_id)"""
GAUC_SQL = """SELECT 'gauc' AS metric, round(sum(((c + 1) * p - p * (p + 1) / 2 - s) / ((c - p) * p) * p) / sum(p), 5) AS value FROM (
  SELECT candidates::DOUBLE AS c, positives::DOUBLE AS p, pos_rank_sum::DOUBLE AS s FROM mean_ranks) WHERE c > p AND p > 0"""


def _vectors(spark, sf):
    return user_vectors(spark, sf), unit_item_vectors(spark, sf), targets_a(spark, sf)


@query("mean_rank", "user_id:i pos_rank_sum:d candidates:i positives:i", f"WITH {RANKED_TARGETS} SELECT * FROM mean_ranks")
def _(spark, sf):
    return scoring.mean_rank(scoring.target_rank(*_vectors(spark, sf), seen_a(spark, sf)))


@query("gauc", "metric:s value:d", f"WITH {RANKED_TARGETS} {GAUC_SQL}")
def _(spark, sf):
    return evaluate_vectors(*_vectors(spark, sf), ["gauc"], [1], seen=seen_a(spark, sf))


def _value_metric(name: str, sql: str):
    @query(name, "metric:s value:d", sql)
    def _(spark, sf):
        return metrics.evaluate([name], scored=scored_documents(spark, sf))


_value_metric("auc", f"""
WITH {SCORED}, r AS (SELECT label, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS r FROM scored)
SELECT 'auc' AS metric, round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0)
  / (sum(label) * sum(1 - label)), 5) AS value FROM r""")
_value_metric("mae", f"WITH {SCORED} SELECT 'mae' AS metric, round(avg(abs(pred - label)), 5) AS value FROM scored")
_value_metric("rmse", f"WITH {SCORED} SELECT 'rmse' AS metric, round(sqrt(avg((pred - label) * (pred - label))), 5) AS value FROM scored")
_value_metric("logloss", f"""
WITH {SCORED}, p AS (SELECT label, greatest(least(pred, 1 - 1e-15), 1e-15) AS p FROM scored)
SELECT 'logloss' AS metric, round(avg(-label * ln(p) - (1 - label) * ln(1 - p)), 5) AS value FROM p""")


@query("evaluate", "metric:s value:d", f"""
WITH {RANKED_TARGETS}, h AS (SELECT user_id, k, min(CASE WHEN NOT suppressed AND rank <= k THEN rank END) AS first,
  count(CASE WHEN NOT suppressed AND rank <= k THEN 1 END) AS hits, count(*) AS pos_len
  FROM target_ranks CROSS JOIN (VALUES (5), (50)) AS ks(k) GROUP BY user_id, k)
SELECT 'hit@' || k AS metric, round(avg(CASE WHEN hits > 0 THEN 1 ELSE 0 END), 5) AS value FROM h GROUP BY k
UNION ALL SELECT 'mrr@' || k, round(avg(coalesce(1 / first, 0)), 5) FROM h GROUP BY k
UNION ALL SELECT 'recall@' || k, round(avg(hits / pos_len), 5) FROM h GROUP BY k
UNION ALL ({GAUC_SQL})""")
def _(spark, sf):
    """Vectors in, metrics out; ranks are found by counting, no top-k list is built."""
    return evaluate_vectors(*_vectors(spark, sf), ["Hit", "MRR", "Recall", "GAUC"], [5, 50], seen=seen_a(spark, sf))


@query("valid_score", "metric:s value:d bigger_is_better:i", f"""
SELECT metric, value, 1 AS bigger_is_better FROM ({_per_user("recall", "sum(CASE WHEN rank <= k THEN hit ELSE 0 END) / nullif(max(pos_len), 0)")})
WHERE metric = 'recall@10'""")
def _(spark, sf):
    results = metrics.evaluate(["hit", "recall"], TOPK, recs=habit_recs(spark, sf))
    return metrics.valid_score(results).withColumn("bigger_is_better", F.col("bigger_is_better").cast("int"))


@query("merged_evaluation", "metric:s value:d", f"""
SELECT * FROM ({_per_user("recall", "sum(CASE WHEN rank <= k THEN hit ELSE 0 END) / nullif(max(pos_len), 0)")})
UNION ALL SELECT * FROM (
WITH {EXPOSED}, p AS (SELECT k, c / sum(c) OVER (PARTITION BY k) AS p FROM shown)
SELECT 'shannonentropy@' || k AS metric, round(sum(-p * ln(p)) / count(*), 5) AS value FROM p GROUP BY k)
UNION ALL SELECT * FROM (
WITH {EXPOSED} SELECT 'itemcoverage@' || k AS metric, round(count(*) / max(n), 5) AS value FROM shown CROSS JOIN size GROUP BY k)""")
def _(spark, sf):
    """States of three shards of users, merged into the values of one run."""
    names = ["recall", "shannonentropy", "itemcoverage"]
    recs, count = habit_recs(spark, sf), _item_count(spark, sf)
    shard = F.pmod("user_id", F.lit(3))
    parts = [states.evaluation_state(names, TOPK, recs=recs.filter(shard == i), item_count=count) for i in range(3)]
    return states.state_values(states.merge_states(*parts), names, TOPK, count)
