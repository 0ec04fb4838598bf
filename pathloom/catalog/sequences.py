"""Windows, padding, masks, prompts, vectors and score functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.catalog.joins import PROMPT, part_items
from pathloom.catalog.registry import query
from pathloom.catalog.tables import (
    HABIT, LOG_A, LOG_B, ORDER_A, ORDER_B, PLACED_A, PLACED_B, SCORED, WINDOW, WINDOWS_A, habit_recs, hot, item_vectors, log_a, log_b,
    placed_a, placed_b, scored_documents, table, windows_a,
)
from pathloom.functions import arrays, scores, text, vectors
from pathloom.operators import batches, clean, history, items, negatives, sequences
from pathloom.operators.skew import global_index
from pathloom.operators.vectors import lookup_vectors


@query("leave_last_k_train", "user_id:i item_id:i pos:i", f"WITH {PLACED_B} SELECT user_id, item_id, pos FROM placed WHERE pos <= n - 3")
def _(spark, sf):
    return sequences.leave_last_k_train(placed_b(spark, sf), 3)


def eval_sql(last: int) -> str:
    return f"""
WITH {PLACED_B}, r AS (SELECT user_id, n, list(item_id ORDER BY pos) AS s FROM placed GROUP BY user_id, n)
SELECT user_id, list_concat(list_resize([]::INTEGER[], greatest(12 - (n - {last}), 0), 0),
         list_slice(s, greatest(n - {last} - 12, 0) + 1, n - {last})) AS item_seq,
       s[n - {last} + 1] AS target, n - {last} AS history_len FROM r WHERE n >= {last}"""


@query("eval_split", "user_id:i item_seq:a target:i history_len:i", eval_sql(4))
def _(spark, sf):
    return sequences.eval_split(placed_b(spark, sf), 12, "valid", k=4)


@query("eval_split_test", "user_id:i item_seq:a target:i history_len:i", eval_sql(2))
def _(spark, sf):
    return sequences.eval_split(placed_b(spark, sf), 12, "test", k=4)


@query("slice_events", "user_id:i item_id:i pos:i n:i", f"""
WITH {PLACED_B} SELECT user_id, item_id, pos - greatest(n - 30, 0) AS pos, n - 2 - greatest(n - 30, 0) AS n FROM placed
WHERE pos > greatest(n - 30, 0) AND pos <= n - 2""")
def _(spark, sf):
    """history[-30:-2] on events, without arrays."""
    return sequences.slice_events(placed_b(spark, sf), -30, -2)


@query("chunk_sequences", "user_id:i seq_no:i item_seq:a time_seq:a", f"WITH {WINDOWS_A} SELECT * FROM windows")
def _(spark, sf):
    return windows_a(spark, sf)


@query("tail_sequence", "user_id:i item_seq:a", f"""
WITH {PLACED_B} SELECT user_id, list(item_id ORDER BY pos) AS item_seq FROM placed WHERE pos > n - 15 GROUP BY user_id""")
def _(spark, sf):
    return sequences.tail_sequence(placed_b(spark, sf), 15)


@query("prefix_augment", "user_id:i seq_no:i prefix_len:i item_seq:a time_seq:a", f"""
WITH {WINDOWS_A} SELECT user_id, seq_no, k AS prefix_len, list_slice(item_seq, 1, k) AS item_seq,
  list_slice(time_seq, 1, k) AS time_seq FROM windows CROSS JOIN range(2, {WINDOW + 1}) AS r(k) WHERE k <= len""")
def _(spark, sf):
    return sequences.prefix_augment(windows_a(spark, sf))


@query("right_aligned_chunks", "user_id:i seq_no:i item_seq:a", f"""
WITH {PLACED_B} SELECT user_id, (n - pos) // 10 + 1 AS seq_no, list(item_id ORDER BY pos) AS item_seq FROM placed
WHERE n >= 10 AND (n - pos) // 10 + 1 <= n // 10 GROUP BY user_id, (n - pos) // 10 + 1""")
def _(spark, sf):
    return sequences.right_aligned_chunks(placed_b(spark, sf), 10)


@query("left_pad", "user_id:i seq_no:i wide:a narrow:a", f"""
WITH {WINDOWS_A} SELECT user_id, seq_no, list_concat(list_resize([]::INTEGER[], 25 - len, 0), item_seq) AS wide,
  list_concat(list_resize([]::INTEGER[], greatest(8 - len, 0), 0), list_slice(item_seq, greatest(len - 8, 0) + 1, len)) AS narrow
FROM windows""")
def _(spark, sf):
    seq = F.col("item_seq")
    return windows_a(spark, sf).select(
        "user_id", "seq_no", arrays.left_pad(seq, 25).alias("wide"), arrays.left_pad(seq, 8).alias("narrow")
    )


ITEMS = "(SELECT max(item_id) AS m FROM log_a)"


def item_top(spark, sf):
    return log_a(spark, sf).agg(F.max("item_id")).first()[0]


def walk_sql(seed: int, place: str) -> str:
    """The item a draw picks: start at the drawn rank, step over each item of the window."""
    return f"""list_reduce(list_prepend(CAST(1 + ({seed} + user_id * 7919 + seq_no * 104729 + {place} * 1299709) % free AS BIGINT), seen),
      lambda a, x: CASE WHEN x <= a THEN a + 1 ELSE a END)"""


FREE_SQL = f"""{WINDOWS_A}, free AS (
  SELECT *, list_sort(list_distinct(item_seq))::BIGINT[] AS seen, m - len(list_distinct(item_seq)) AS free
  FROM windows CROSS JOIN {ITEMS})"""


@query("left_pad_negatives", "user_id:i seq_no:i item_seq:a", f"""
WITH {FREE_SQL} SELECT user_id, seq_no, list_concat(list_transform(range(1, greatest(24 - len, 0) + 1),
  lambda p: {walk_sql(42, 'p')}), item_seq::BIGINT[]) AS item_seq FROM free""")
def _(spark, sf):
    return negatives.left_pad_negatives(windows_a(spark, sf), 24, item_top(spark, sf), draw="arithmetic")


@query("position_mask", "user_id:i seq_no:i mask:a", f"""
WITH {WINDOWS_A} SELECT user_id, seq_no, list_concat(list_resize([]::INTEGER[], 24 - (len - 1), 0),
  list_resize([]::INTEGER[], len - 1, 1)) AS mask FROM windows""")
def _(spark, sf):
    return windows_a(spark, sf).withColumn("mask", arrays.position_mask(F.size("item_seq"), 24))


@query("shift_pairs", "user_id:i seq_no:i place:i input:i target:i", f"""
WITH {WINDOWS_A} SELECT user_id, seq_no, i AS place, item_seq[i + 1] AS input, item_seq[i + 2] AS target
FROM windows CROSS JOIN range(0, {WINDOW}) AS r(i) WHERE i < len - 1""")
def _(spark, sf):
    seq = F.col("item_seq")
    pairs = F.arrays_zip(arrays.input_items(seq).alias("input"), arrays.target_items(seq).alias("target"))
    return windows_a(spark, sf).select("user_id", "seq_no", F.posexplode(pairs).alias("place", "p")).select(
        "user_id", "seq_no", "place", "p.input", "p.target"
    )


@query("split_long_recent", "user_id:i early:a recent:a", f"""
WITH {PLACED_A}, h AS (SELECT user_id, n, list(item_id ORDER BY pos) AS s FROM placed WHERE pos <= n - 2 AND pos > n - 42 GROUP BY user_id, n),
p AS (SELECT user_id, list_concat(list_resize([]::INTEGER[], greatest(40 - (n - 2), 0), 0), s) AS s FROM h)
SELECT user_id, list_slice(s, 1, 30) AS early, list_slice(s, 31, 40) AS recent FROM p""")
def _(spark, sf):
    """Evaluation windows of 40: the first 30 and the last 10 items."""
    early, recent = arrays.split_long_recent(F.col("item_seq"), 30, 10)
    return sequences.eval_split(placed_a(spark, sf), 40).select("user_id", early.alias("early"), recent.alias("recent"))


PLAN, MARKERS = [(5, 2), (12, 1)], 3
PADDED = f"SELECT user_id, seq_no, len, list_concat(list_resize([]::INTEGER[], {WINDOW} - len, 0), item_seq) AS item_seq FROM windows"


def padded_a(spark, sf):
    """All training windows of log A, filled on the left."""
    return windows_a(spark, sf).withColumn("item_seq", arrays.left_pad(F.col("item_seq"), WINDOW))


@query("insert_placeholders", "user_id:i seq_no:i item_seq:a", f"""
WITH {WINDOWS_A} SELECT user_id, seq_no, list_concat(list_concat(list_concat(list_slice(item_seq, 1, 5), [-1, -1]),
  list_concat(list_slice(item_seq, 6, 12), [-1])), list_slice(item_seq, 13, {WINDOW})) AS item_seq FROM ({PADDED})""")
def _(spark, sf):
    """Two markers before place 5, one before place 12 of padded windows."""
    return padded_a(spark, sf).withColumn("item_seq", arrays.insert_placeholders(F.col("item_seq"), PLAN, MARKERS))


@query("segment_bounds", "user_id:i seq_no:i first:i last:i", f"""
WITH {WINDOWS_A} SELECT user_id, seq_no, b[1] AS first, b[2] AS last FROM (
  SELECT user_id, seq_no, unnest([[0, 4], [7, 13], [15, {WINDOW + 2}]]) AS b FROM ({PADDED}))""")
def _(spark, sf):
    bounds = arrays.segment_bounds(F.size("item_seq"), PLAN, MARKERS)
    return padded_a(spark, sf).select("user_id", "seq_no", F.inline(bounds))


@query("loss_mask", "user_id:i seq_no:i all_items:a recent_items:a", f"""
WITH {WINDOWS_A} SELECT user_id, seq_no, list_transform(range(0, {WINDOW + 3}), lambda i: CASE WHEN
    i <= 4 AND i >= {WINDOW} - len OR i BETWEEN 7 AND 13 AND i - 2 >= {WINDOW} - len OR i >= 15 AND i - 3 >= {WINDOW} - len
    THEN 1 ELSE 0 END) AS all_items,
  list_transform(range(0, {WINDOW + 3}), lambda i: CASE WHEN i >= 15 AND i - 3 >= {WINDOW} - len THEN 1 ELSE 0 END) AS recent_items FROM ({PADDED})""")
def _(spark, sf):
    rows = padded_a(spark, sf).select(
        "user_id", "seq_no",
        arrays.insert_placeholders(arrays.real_item_mask(F.col("item_seq")), PLAN, MARKERS, marker=1).alias("mask"),
        arrays.segment_bounds(F.size("item_seq"), PLAN, MARKERS).alias("bounds"),
    )
    mask, bounds = F.col("mask"), F.col("bounds")
    return rows.select(
        "user_id", "seq_no", arrays.loss_mask(mask, bounds).alias("all_items"),
        arrays.loss_mask(mask, bounds, recent_only=True).alias("recent_items"),
    )


@query("token_lengths", "batch_id:i idx:i last_token:i", f"""
WITH {WINDOWS_A}, w AS (SELECT *, row_number() OVER (ORDER BY user_id, seq_no) AS idx FROM windows)
SELECT (idx - 1) // 16 AS batch_id, idx, sum(len) OVER (PARTITION BY (idx - 1) // 16 ORDER BY idx) - 1 AS last_token FROM w""")
def _(spark, sf):
    """Place of the last token of each sequence in its packed batch of 16."""
    indexed = global_index(windows_a(spark, sf), [F.col("user_id"), F.col("seq_no")])
    return batches.token_lengths(indexed.withColumn("len", F.size("item_seq")), 16, "len")


@query("item_dropout", "user_id:i seq_no:i mask:a", f"""
WITH {WINDOWS_A} SELECT user_id, seq_no, list_transform(range(0, {WINDOW}), lambda i: CASE WHEN i < {WINDOW} - len OR i >= 8 AND
  ((42 + user_id * 7919 + seq_no * 104729 + i * 1299709) % 1000003) / 1000003.0 < 0.3 THEN 0 ELSE 1 END) AS mask FROM ({PADDED})""")
def _(spark, sf):
    """Three in ten of the recent items are masked out; padding stays masked."""
    return negatives.item_dropout(padded_a(spark, sf), arrays.real_item_mask(F.col("item_seq")), 8, 0.3, draw="arithmetic")


@query("explode_parallel", "user_id:i item_id:i event_time:i value:d",
       f"WITH {LOG_A} SELECT user_id, item_id, event_time, value FROM log_a")
def _(spark, sf):
    columns = ["item_id", "event_time", "value"]
    h = history.build_history_arrays(log_a(spark, sf), columns, ORDER_A, frequent=hot(spark, sf, "a", "user_id"))
    return clean.explode_parallel(h, columns)


@query("repeat_and_explode", "user_id:i pos:i item_id:i event_time:i", f"WITH {PLACED_B} SELECT * FROM placed")
def _(spark, sf):
    h = history.build_history_arrays(log_b(spark, sf), ["item_id", "event_time"], ORDER_B, frequent=hot(spark, sf, "b", "user_id"))
    return history.explode_history(h, ["item_id", "event_time"])


@query("history_pairs", "batch_id:i row:i item_id:i", f"""
WITH {PLACED_A}, u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i FROM placed WHERE pos = 1)
SELECT i // 32 AS batch_id, i % 32 AS row, item_id FROM placed JOIN u USING (user_id) WHERE pos <= n - 2""")
def _(spark, sf):
    placed = placed_a(spark, sf)
    indexed = global_index(sequences.eval_split(placed, 10), [F.col("user_id")])
    _, pairs = batches.pack_eval_batches(
        indexed, 32, ["user_id", "target"], sequences.eval_history(placed), frequent=hot(spark, sf, "a", "user_id")
    )
    return pairs


@query("pad_ragged_scores", "user_id:i filled:i missing:i total:d shown:a", f"""
WITH {HABIT} SELECT user_id, count(*) AS filled, 24 - count(*) AS missing, sum(score) AS total,
  list_concat(list(CAST(score AS VARCHAR) ORDER BY rank), list_resize([]::VARCHAR[], 24 - count(*), '-inf')) AS shown
FROM recs GROUP BY user_id""")
def _(spark, sf):
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.col("score").cast("double").alias("score"))))
    lists = habit_recs(spark, sf).groupBy("user_id").agg(ranked["score"].alias("scores"))
    padded = lists.withColumn("scores", arrays.pad_scores(F.col("scores"), 24))
    shown = F.transform("scores", lambda x: F.when(x == float("-inf"), "-inf").otherwise(x.cast("long").cast("string")))
    real = F.filter("scores", lambda x: x > float("-inf"))
    return padded.select(
        "user_id", F.size(real).alias("filled"), (F.size("scores") - F.size(real)).alias("missing"),
        F.aggregate(real, F.lit(0.0), lambda a, x: a + x).alias("total"), shown.alias("shown"),
    )


@query("composite_key", "key:s n:i", f"WITH {LOG_B} SELECT user_id || '_' || sequence_id AS key, count(*) AS n FROM log_b GROUP BY 1")
def _(spark, sf):
    key = text.composite_key(F.col("user_id"), F.col("sequence_id")).alias("key")
    return log_b(spark, sf).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


@query("item_prompt_text", "item_id:i text:s", f"""
SELECT p_partkey + 1 AS item_id, '{PROMPT}' || CASE WHEN p_name <> 'blue bolt' THEN 'p_name: ' || p_name ELSE '' END ||
  CASE WHEN p_brand <> 'Brand#2' THEN 'p_brand: ' || p_brand ELSE '' END ||
  CASE WHEN p_size % 5 <> 0 THEN 'p_size: ' || p_size ELSE '' END AS text FROM part""")
def _(spark, sf):
    """Some names are null, some brands 'nan', some sizes 0: those keys are skipped."""
    rows = part_items(spark, sf).select(
        "item_id", F.nullif("p_name", F.lit("blue bolt")).alias("p_name"),
        F.when(F.col("p_brand") == "Brand#2", "nan").otherwise(F.col("p_brand")).alias("p_brand"),
        F.when(F.col("p_size") % 5 == 0, 0).otherwise(F.col("p_size")).alias("p_size"),
    )
    return rows.select("item_id", text.item_prompt_text(rows, ["p_name", "p_brand", "p_size"], PROMPT).alias("text"))


WORD_IDS = "list_transform(string_split(text, ' '), lambda w: length(w))"


def word_ids(spark, sf):
    """Documents as token ids: the length of each word."""
    ids = F.transform(items.split_words(F.col("text")), lambda w: F.length(w))
    return table(spark, sf, "documents").select("doc_id", ids.alias("tokens"))


@query("truncate_tokens", "doc_id:i tokens:a", f"SELECT doc_id, list_slice({WORD_IDS}, 1, 64) AS tokens FROM documents")
def _(spark, sf):
    return word_ids(spark, sf).withColumn("tokens", arrays.truncate_tokens(F.col("tokens"), 64))


@query("token_layout", "doc_id:i input_ids:a input_len:i position_ids:a", f"""
WITH t AS (SELECT doc_id, list_slice({WORD_IDS}, 1, 64) AS k FROM documents)
SELECT doc_id, list_concat(k, [0]) AS input_ids, len(k) + 1 AS input_len, range(64 - len(k), 65) AS position_ids FROM t""")
def _(spark, sf):
    return word_ids(spark, sf).select("doc_id", arrays.token_layout(F.col("tokens"), 64, 1).alias("t")).select("doc_id", "t.*")


@query("l2_normalize", "vec_id:i dim:i value:d", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, unnest(range(0, len(v))) AS dim, unnest(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))) AS value FROM e""")
def _(spark, sf):
    unit = vectors.l2_normalize(F.col("embedding"), 1e-6)
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(unit).alias("dim", "value"))


@query("cosine", "user_id:i seq_no:i place:i cosine:d", f"""
WITH {WINDOWS_A}, p AS (SELECT user_id, seq_no, i AS place, item_seq[i + 1] AS a, item_seq[i + 2] AS b
  FROM windows CROSS JOIN range(0, {WINDOW}) AS r(i) WHERE i < len - 1),
e AS (SELECT vec_id + 1 AS item_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT user_id, seq_no, place, list_inner_product(x.v, y.v) / sqrt(list_inner_product(x.v, x.v) * list_inner_product(y.v, y.v)) AS cosine
FROM p JOIN e x ON x.item_id = a JOIN e y ON y.item_id = b""")
def _(spark, sf):
    """Similarity of each item to the next one in its window."""
    found = lookup_vectors(windows_a(spark, sf), item_vectors(spark, sf), frequent=hot(spark, sf, "a", "item_id"))
    v = F.col("vector")
    n = F.size("vector") - 1
    zipped = F.arrays_zip(F.slice(v, F.lit(1), n).alias("a"), F.slice(v, F.lit(2), n).alias("b"))
    pairs = found.filter(F.size("vector") > 1).select("user_id", "seq_no", F.posexplode(zipped).alias("place", "p"))
    return pairs.select("user_id", "seq_no", "place", vectors.cosine(F.col("p.a"), F.col("p.b")).alias("cosine"))


@query("threshold_flag", "doc_id:i flag:i", f"WITH {SCORED} SELECT doc_id, CASE WHEN pred > 0.5 THEN 1 ELSE 0 END AS flag FROM scored")
def _(spark, sf):
    return scored_documents(spark, sf).withColumn("flag", scores.threshold_flag(F.col("pred"), 0.5))


@query("round_scores", "l_orderkey:i up:d down:d near:d", """
SELECT l_orderkey, ceil(l_quantity / 4) AS up, floor(l_quantity / 4) AS down,
  CASE WHEN l_quantity % 4 = 2 THEN 2 * round(l_quantity / 8) ELSE round(l_quantity / 4) END AS near FROM lineitem""")
def _(spark, sf):
    """Quarters of the quantity: halves round to the even neighbour."""
    quarter = F.col("l_quantity") / 4
    return table(spark, sf, "lineitem").select(
        "l_orderkey", scores.round_scores(quarter, "ceil").alias("up"), scores.round_scores(quarter, "floor").alias("down"),
        scores.round_scores(quarter, "around").alias("near"),
    )


@query("round_metric", "l_orderkey:i rate:d", "SELECT l_orderkey, round(l_extendedprice / 7, 5) AS rate FROM lineitem")
def _(spark, sf):
    rate = F.col("l_extendedprice") / 7
    return table(spark, sf, "lineitem").select("l_orderkey", scores.round_metric(rate).alias("rate"))
