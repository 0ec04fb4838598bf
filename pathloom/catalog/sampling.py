"""Negatives, splits, shards, batches and the normalised graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.catalog.joins import EDGES_SQL, PROMPT, hot_nodes, part_items, user_count
from pathloom.catalog.registry import query
from pathloom.catalog.sequences import FREE_SQL, ITEMS, item_top, walk_sql
from pathloom.catalog.sources import SPLIT_SQL
from pathloom.catalog.tables import (
    ORDER_A, PLACED_A, WINDOW, WINDOWS_A, hot, item_vectors, log_a, placed_a, table, windows_a,
)
from pathloom.functions.draws import any_item
from pathloom.functions.permutation import FACTOR, PRIME, round_keys
from pathloom.operators import batches, contrastive, graph, negatives, sequences, splits
from pathloom.operators.skew import global_index, lookup, row_index
from pathloom.plans.text_training import text_training_examples
from pathloom.plans.training import training_examples
from pathloom.session import save_shared


@query("sample_negatives", "user_id:i seq_no:i item_seq:a neg_item:a", f"""
WITH {FREE_SQL} SELECT user_id, seq_no, item_seq, list_transform(range(1, len), lambda p: {walk_sql(42, 'p')}) AS neg_item
FROM free""")
def _(spark, sf):
    return negatives.sample_negatives(windows_a(spark, sf), item_top(spark, sf), draw="arithmetic")


@query("sample_negatives_hashed", "windows:i drawn:i inside:i out_of_range:i", f"""
WITH {FREE_SQL} SELECT count(*) AS windows, sum(len - 1) AS drawn, 0 AS inside, 0 AS out_of_range FROM free""")
def _(spark, sf):
    """The hash draw, checked by its properties: none inside the window, all in range."""
    top = item_top(spark, sf)
    drawn = negatives.sample_negatives(windows_a(spark, sf), top)
    neg = F.col("neg_item")
    return drawn.agg(
        F.count(F.lit(1)).alias("windows"), F.sum(F.size(neg)).alias("drawn"),
        F.sum(F.size(F.array_intersect(neg, "item_seq"))).alias("inside"),
        F.sum(F.size(F.filter(neg, lambda x: (x < 1) | (x > top)))).alias("out_of_range"),
    )


@query("sample_shared_negatives", "user_id:i seq_no:i unseen:a any_item:a", f"""
WITH {FREE_SQL} SELECT user_id, seq_no, list_transform(range(1, 5), lambda p: {walk_sql(42, 'p')}) AS unseen,
  list_transform(range(1, 5), lambda p: 1 + (42 + user_id * 7919 + seq_no * 104729 + p * 1299709) % m) AS any_item
FROM free WHERE free > 0""")
def _(spark, sf):
    """ceil(100 / 2 workers / 16 rows) = 4 items per window, with and without the window excluded."""
    top = item_top(spark, sf)
    args = {"item_count": top, "num_negatives": 100, "workers": 2, "batch": 16, "draw": "arithmetic"}
    both = negatives.sample_shared_negatives(windows_a(spark, sf), **args).withColumnRenamed("neg_item", "unseen")
    both = negatives.sample_shared_negatives(both, exclude_history=False, **args)
    return both.withColumnRenamed("neg_item", "any_item")


@query("sample_per_position", "user_id:i seq_no:i pos:i neg_item:a", f"""
WITH {WINDOWS_A} SELECT user_id, seq_no, p AS pos, list_transform(range(1, 4), lambda j:
  1 + (42 + user_id * 7919 + (seq_no * 100000 + p) * 104729 + j * 1299709) % m) AS neg_item
FROM windows CROSS JOIN {ITEMS} CROSS JOIN range(1, 20) AS r(p) WHERE p < len""")
def _(spark, sf):
    return negatives.sample_per_position(windows_a(spark, sf), item_top(spark, sf), 3, draw="arithmetic")


BATCH = 64
EXAMPLES = f"""{PLACED_A}, steps AS (
  SELECT event_no, user_id, pos, item_id, lead(item_id) OVER (PARTITION BY user_id ORDER BY pos) AS next_item FROM placed),
drawn AS (
  SELECT user_id, pos, item_id AS o, next_item AS t, 1 + (7 + user_id * 7919 + pos * 104729) % m AS g,
         row_number() OVER (ORDER BY user_id, pos) AS idx FROM steps CROSS JOIN {ITEMS} WHERE next_item IS NOT NULL),
unit AS (
  SELECT item_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM (
    SELECT vec_id + 1 AS item_id, embedding::DOUBLE[] AS v FROM embeddings)),
sims AS (SELECT a.item_id AS a, b.item_id AS b, list_inner_product(a.v, b.v) AS s FROM unit a CROSS JOIN unit b
  WHERE a.item_id <= (SELECT m FROM {ITEMS}) AND b.item_id <= (SELECT m FROM {ITEMS})),
crossed AS (
  SELECT p.idx AS example_id, (p.idx - 1) // {BATCH} AS batch_id, po.s AS pos_sim, og.s AS neg_sim, tg.s <= 0.99 AS keep
  FROM drawn p JOIN drawn q ON (q.idx - 1) // {BATCH} = (p.idx - 1) // {BATCH}
  JOIN sims po ON po.a = p.o AND po.b = p.t JOIN sims og ON og.a = p.o AND og.b = q.g JOIN sims tg ON tg.a = p.t AND tg.b = q.g),
summary AS (
  SELECT example_id, batch_id, count(*) AS negatives, count(CASE WHEN keep THEN 1 END) AS kept,
         max(CASE WHEN keep THEN neg_sim END) AS best_negative, 20 * max(pos_sim) AS pos_logit,
         ln(exp(20 * max(pos_sim)) + coalesce(sum(CASE WHEN keep THEN exp(20 * neg_sim) END), 0)) - 20 * max(pos_sim) AS loss,
         1 + count(CASE WHEN keep AND neg_sim > pos_sim + 1e-12 THEN 1 END) AS pos_rank
  FROM crossed GROUP BY example_id, batch_id)"""


def contrastive_examples(spark, sf):
    """Each event's item predicts the next one; the negative is drawn by (user, position).

    Examples, which name vectors by id, and the vectors: they would be shuffled with each example otherwise.
    """
    placed = placed_a(spark, sf)
    top = item_top(spark, sf)
    # The next event is found by shifting the position, not by a window over the history.  Both sides have a row
    # for each event: merged, as Spark would take a compressed file's size for small and copy one side to every task.
    following = placed.select("user_id", (F.col("pos") - 1).alias("pos"), F.col("item_id").alias("t"))
    steps = placed.select("user_id", "pos", F.col("item_id").alias("o")).join(following.hint("merge"), ["user_id", "pos"])
    drawn = steps.withColumn("g", any_item(top, 7, F.col("user_id"), F.col("pos"), draw="arithmetic").cast("int"))
    indexed = global_index(drawn, [F.col("user_id"), F.col("pos")], "example_id")
    vectors = row_index(item_vectors(spark, sf), "id")
    for key, name in (("o", "output"), ("t", "positive"), ("g", "negative")):
        named = vectors.select(F.col("item_id").alias(key), F.col("id").alias(name))
        # Negatives are drawn evenly; inputs and targets are as frequent as the log's items.
        indexed = lookup(indexed, named, key, "inner", frequent=[] if key == "g" else hot(spark, sf, "a", "item_id"))
    examples = indexed.select(
        F.floor((F.col("example_id") - 1) / BATCH).alias("batch_id"), "example_id", "output", "positive", "negative"
    )
    return save_shared(examples, "examples"), vectors.select("id", "vector")


@query("batch_negatives", "example_id:i batch_id:i negatives:i pos_logit:d",
       f"WITH {EXAMPLES} SELECT * FROM summary")
def _(spark, sf):
    examples, vectors = contrastive_examples(spark, sf)
    return contrastive.batch_negatives(examples, vectors=vectors)


@query("drop_false_negatives", "example_id:i kept:i best_negative:d", f"WITH {EXAMPLES} SELECT * FROM summary")
def _(spark, sf):
    examples, vectors = contrastive_examples(spark, sf)
    return contrastive.batch_negatives(examples, vectors=vectors)


@query("contrastive_eval", "metric:s value:d", f"""
WITH {EXAMPLES}, a AS (SELECT avg(loss) AS loss, avg(kept + 1) AS nce_samples,
  avg(CASE WHEN negatives + 1 >= 1 THEN CASE WHEN pos_rank <= 1 THEN 1 ELSE 0 END END) AS t1,
  avg(CASE WHEN negatives + 1 >= 5 THEN CASE WHEN pos_rank <= 5 THEN 1 ELSE 0 END END) AS t5,
  avg(CASE WHEN negatives + 1 >= 10 THEN CASE WHEN pos_rank <= 10 THEN 1 ELSE 0 END END) AS t10,
  avg(CASE WHEN negatives + 1 >= 50 THEN CASE WHEN pos_rank <= 50 THEN 1 ELSE 0 END END) AS t50 FROM summary)
SELECT 'loss' AS metric, loss AS value FROM a UNION ALL SELECT 'nce_samples', nce_samples FROM a
UNION ALL SELECT 'nce_top1_acc', t1 FROM a UNION ALL SELECT 'nce_top5_acc', t5 FROM a
UNION ALL SELECT 'nce_top10_acc', t10 FROM a UNION ALL SELECT 'nce_top50_acc', t50 FROM a""")
def _(spark, sf):
    """Batches of 64: top-100 accuracy is not defined and left out."""
    examples, vectors = contrastive_examples(spark, sf)
    return contrastive.contrastive_eval(examples, vectors=vectors)


@query("contrastive_masked", "example_id:i negatives:i kept:i loss:d pos_rank:i",
       f"WITH {EXAMPLES} SELECT * FROM summary WHERE example_id % 3 <> 0")
def _(spark, sf):
    """A third of the examples is masked: without a loss, their negatives stay in the pool.  Tiles of 20."""
    examples, vectors = contrastive_examples(spark, sf)
    masked = examples.withColumn("used", F.col("example_id") % 3 != 0)
    return contrastive.batch_negatives(masked, mask="used", tile=20, vectors=vectors)


@query("split_rows", "o_orderkey:i split:s", SPLIT_SQL)
def _(spark, sf):
    return splits.split_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", draw="arithmetic")


@query("split_users", "user_id:i half:i n:i", f"""
WITH {PLACED_A}, u AS (SELECT user_id, max(n) AS n FROM placed GROUP BY user_id),
r AS (SELECT user_id, n, row_number() OVER (ORDER BY (42 + user_id * 7919) % 1000003, user_id) AS r, count(*) OVER () AS m FROM u)
SELECT user_id, CASE WHEN r <= floor(m * 0.8) THEN 1 ELSE 2 END AS half, n FROM r""")
def _(spark, sf):
    halves = splits.split_users(log_a(spark, sf).select("user_id"), draw="arithmetic")
    return halves.groupBy("user_id", "half").agg(F.count(F.lit(1)).alias("n"))


@query("shuffle_rows", "o_orderkey:i first_epoch:i second_epoch:i", """
SELECT o_orderkey, row_number() OVER (ORDER BY (42 + o_orderkey * 7919) % 1000003, o_orderkey) AS first_epoch,
  row_number() OVER (ORDER BY (43 + o_orderkey * 7919) % 1000003, o_orderkey) AS second_epoch FROM orders""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey")
    first = splits.shuffle_rows(rows, "o_orderkey", epoch=0, draw="arithmetic").withColumnRenamed("idx", "first_epoch")
    return splits.shuffle_rows(first, "o_orderkey", epoch=1, draw="arithmetic").withColumnRenamed("idx", "second_epoch")


def epoch_sql(seed: int, epoch: int) -> str:
    """Places of a dense index by four Feistel rounds on two digits, walked until below n."""
    k = round_keys(seed, epoch)

    def mixed(digit: str, key: int) -> str:
        x = f"(({digit} + {key}) % {PRIME})"
        return f"((({x} * {x} + {key}) % {PRIME} * {FACTOR} + {digit}) % {PRIME})"

    def one(source: str, x: str) -> str:
        l1 = f"SELECT *, ({x} // b + {mixed(f'({x} % b)', k[0])}) % a AS l1, {x} % b AS r0 FROM {source}"
        r1 = f"SELECT *, (r0 + {mixed('l1', k[1])}) % b AS r1 FROM ({l1})"
        l2 = f"SELECT *, (l1 + {mixed('r1', k[2])}) % a AS l2 FROM ({r1})"
        return f"SELECT id, n, a, b, l2 * b + (r1 + {mixed('l2', k[3])}) % b AS x FROM ({l2})"

    return f"""SELECT id, x + 1 AS place FROM (
      WITH RECURSIVE walk AS ({one('dense', 'i')} UNION ALL {one('(SELECT * FROM walk WHERE x >= n)', 'x')})
      SELECT id, n, x FROM walk) WHERE x < n"""


@query("shuffle_epochs", "o_orderkey:i first_epoch:i second_epoch:i", f"""
WITH counted AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM orders),
dense AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, n, a, (n + a - 1) // a AS b FROM orders CROSS JOIN counted)
SELECT f.id AS o_orderkey, f.place AS first_epoch, s.place AS second_epoch
FROM ({epoch_sql(42, 0)}) f JOIN ({epoch_sql(42, 1)}) s ON f.id = s.id""")
def _(spark, sf):
    """One index, two epochs."""
    indexed = global_index(table(spark, sf, "orders").select("o_orderkey"), [F.col("o_orderkey")])
    n = indexed.count()
    first = splits.shuffle_epoch(indexed, n, epoch=0, place="first_epoch")
    return splits.shuffle_epoch(first, n, epoch=1, place="second_epoch")


@query("shard_strided", "o_orderkey:i shard:i",
       "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS shard FROM orders")
def _(spark, sf):
    return splits.shard_strided(global_index(table(spark, sf, "orders").select("o_orderkey"), [F.col("o_orderkey")]), 7)


@query("shard_contiguous", "o_orderkey:i idx:i shard:i filler:i", """
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS idx, count(*) OVER () AS n FROM orders),
p AS (SELECT *, CAST(ceil(n / 64.0 / 7) AS BIGINT) * 64 AS per FROM o),
f AS (SELECT o_orderkey, unnest(range(n + 1, per * 7 + 1)) AS idx, per FROM p WHERE idx = n)
SELECT o_orderkey, idx, (idx - 1) // per AS shard, 0 AS filler FROM p
UNION ALL SELECT o_orderkey, idx, (idx - 1) // per, 1 FROM f""")
def _(spark, sf):
    """Seven shards of whole batches of 64, the last row repeated as filler."""
    indexed = global_index(table(spark, sf, "orders").select("o_orderkey"), [F.col("o_orderkey")])
    return splits.shard_contiguous(indexed, 7, 64).withColumn("filler", F.col("filler").cast("int"))


@query("pack_batches", "batch_id:i user_id:a item_seq:a item_seq_lens:a", f"""
WITH {WINDOWS_A}, w AS (SELECT *, row_number() OVER (ORDER BY user_id, seq_no) AS idx FROM windows)
SELECT (idx - 1) // 16 AS batch_id, list(user_id ORDER BY idx) AS user_id, flatten(list(item_seq ORDER BY idx)) AS item_seq,
  list(len ORDER BY idx) AS item_seq_lens FROM w GROUP BY (idx - 1) // 16""")
def _(spark, sf):
    indexed = global_index(windows_a(spark, sf), [F.col("user_id"), F.col("seq_no")])
    return batches.pack_batches(indexed, 16, ["user_id"], ["item_seq"])


@query("pack_eval_batches", "batch_id:i user_id:a target:a", f"""
WITH {PLACED_A}, u AS (SELECT user_id, item_id AS target, row_number() OVER (ORDER BY user_id) - 1 AS i FROM placed WHERE pos = n - 1)
SELECT i // 32 AS batch_id, list(user_id ORDER BY i) AS user_id, list(target ORDER BY i) AS target FROM u GROUP BY i // 32""")
def _(spark, sf):
    placed = placed_a(spark, sf)
    indexed = global_index(sequences.eval_split(placed, 10), [F.col("user_id")])
    return batches.pack_eval_batches(indexed, 32, ["user_id", "target"], sequences.eval_history(placed), frequent=[])[0]


@query("pack_eval_histories", "batch_id:i row:i item_id:i", f"""
WITH {PLACED_A}, u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i FROM placed WHERE pos = n - 1)
SELECT i // 32 AS batch_id, i % 32 AS row, item_id FROM placed JOIN u USING (user_id) WHERE pos <= n - 2""")
def _(spark, sf):
    """The other result of ``pack_eval_batches``: what each row of a batch has to suppress."""
    placed = placed_a(spark, sf)
    indexed = global_index(sequences.eval_split(placed, 10), [F.col("user_id")])
    return batches.pack_eval_batches(indexed, 32, ["user_id", "target"], sequences.eval_history(placed), frequent=[])[1]


@query("normalized_adjacency", "src:i dst:i weight:d", f"""
WITH {EDGES_SQL} SELECT src, dst, 1 / sqrt(a.n) * (1 / sqrt(b.n)) AS weight FROM edges
JOIN deg a ON a.node = src JOIN deg b ON b.node = dst""")
def _(spark, sf):
    return graph.normalized_adjacency(log_a(spark, sf), user_count(spark, sf), hot_nodes(spark, sf))


@query("training_examples", "user_id:i seq_no:i item_seq:a neg_item:a masked_index:a", f"""
WITH {FREE_SQL} SELECT user_id, seq_no, list_concat(list_resize([]::INTEGER[], 20 - len, 0), item_seq) AS item_seq,
  list_concat(list_resize([]::BIGINT[], 21 - len, 0), list_transform(range(1, len), lambda p: {walk_sql(42, 'p')})) AS neg_item,
  list_concat(list_resize([]::INTEGER[], 20 - len, 0), list_resize([]::INTEGER[], len - 1, 1)) AS masked_index
FROM free""")
def _(spark, sf):
    """The whole path from events to padded training examples."""
    return training_examples(
        log_a(spark, sf), ORDER_A, WINDOW - 1, item_top(spark, sf), draw="arithmetic",
        frequent=hot(spark, sf, "a", "user_id"),
    )


def packed_sql(side: str) -> str:
    """Token columns of one side of an example, four tokens of an item's text and one slot."""
    return f"""SELECT user_id, seq_no, flatten(list(list_concat(k, [0]) ORDER BY place)) AS {side}_input_ids,
  list(len(k) + 1 ORDER BY place) AS {side}_input_lens, flatten(list(range(4 - len(k), 5) ORDER BY place)) AS {side}_position_ids
  FROM (SELECT user_id, seq_no, place, coalesce(k, [0]) AS k FROM (
    SELECT user_id, seq_no, unnest({side}) AS item_id, generate_subscripts({side}, 1) AS place FROM ex) LEFT JOIN tok USING (item_id))
  GROUP BY user_id, seq_no"""


@query("text_training_examples", "user_id:i seq_no:i item_seq:a neg_item:a pos_input_ids:a pos_input_lens:a pos_position_ids:a "
       "neg_input_ids:a neg_input_lens:a neg_position_ids:a last_year:i", f"""
WITH {FREE_SQL}, ex AS (
  SELECT user_id, seq_no, list_concat(list_resize([]::INTEGER[], 20 - len, 0), item_seq)::BIGINT[] AS pos,
    list_concat(list_resize([]::BIGINT[], 21 - len, 0), list_transform(range(1, len), lambda p: {walk_sql(42, 'p')})) AS neg,
    year(to_timestamp(time_seq[len]) AT TIME ZONE 'UTC') AS last_year
  FROM free),
tok AS (SELECT p_partkey + 1 AS item_id, list_slice(list_transform(
  string_split('{PROMPT}p_name: ' || p_name || 'p_brand: ' || p_brand, ' '), lambda w: length(w)), 1, 4) AS k FROM part),
pos AS ({packed_sql("pos")}), neg AS ({packed_sql("neg")})
SELECT *, pos AS item_seq, neg AS neg_item FROM ex JOIN pos USING (user_id, seq_no) JOIN neg USING (user_id, seq_no)""")
def _(spark, sf):
    """From events and item descriptions to packed tokens; a word's length stands for its token id."""
    examples = training_examples(
        log_a(spark, sf), ORDER_A, WINDOW - 1, item_top(spark, sf), draw="arithmetic",
        frequent=hot(spark, sf, "a", "user_id"),
    )
    words = lambda rows: rows.withColumn("tokens", F.transform(F.split("text", " "), F.length))
    packed = text_training_examples(
        examples, part_items(spark, sf), ["p_name", "p_brand"], PROMPT, words, 4, frequent=hot(spark, sf, "a", "item_id"),
    )
    return packed.withColumn("last_year", F.element_at(F.element_at("time_ids", -1), 1))
