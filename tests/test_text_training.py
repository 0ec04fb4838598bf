"""Packed token examples against a plain version."""

import pytest
from pyspark.sql import functions as F

from pathloom.plans.text_training import text_training_examples


@pytest.mark.parametrize("min_rows", [2, 10**6])
def test_tokens_of_padded_examples(spark, min_rows):
    names = {1: "ab c def", 2: "x", 3: None, 5: "q w e r t y"}
    items = spark.createDataFrame([*names.items(), (2, "zz"), (0, "never")], "item_id int, name string")
    data = [(1, 0, [0, 0, 1, 2], [0, 5, 3]), (1, 1, [2, 1, 2, 1], [9, 9, 1]), (None, 0, [0, 0, 0, 0], []), (2, 0, [1, 1, 1, 5], [0, 0, 0])]
    examples = spark.createDataFrame(data, "user_id int, seq_no int, item_seq array<int>, neg_item array<int>").withColumn("mask", F.col("seq_no") + 7)
    words = lambda rows: rows.withColumn("tokens", F.filter(F.transform(F.split("text", " "), F.length), lambda n: n > 0))
    got = text_training_examples(examples, items, ["name"], "P: ", words, 3, 2, min_rows=min_rows).collect()

    def layout(item):
        text = "P: " + (f"name: {names[item]}" if names[item] else "") if item in names else ""
        kept = [len(w) for w in text.split(" ") if w][:3]
        return kept + [0, 0], len(kept) + 2, list(range(3 - len(kept), 5))

    assert len(got) == len(data)
    for r in got:
        row = next(d for d in data if d[:2] == (r["user_id"], r["seq_no"]))
        assert (r["item_seq"], r["neg_item"], r["mask"]) == (row[2], row[3], row[1] + 7)
        for side, ids in (("pos", row[2]), ("neg", row[3])):
            laid = [layout(i) for i in ids]
            assert r[f"{side}_input_ids"] == [x for t in laid for x in t[0]] and r[f"{side}_input_lens"] == [t[1] for t in laid]
            assert r[f"{side}_position_ids"] == [x for t in laid for x in t[2]]
