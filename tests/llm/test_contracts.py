"""Every operator against brute force on a table with nulls, empty and long texts, ties and clashing names."""

import math
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import ITEMS, ROWS

from pathloom.llm import (
    decontaminate, language_model, mixing, ngram_join, quality_classifier, quality_rules, sanitise, substring_dedup, suffix_array, tool_calls,
)
from pathloom.llm.text import covered, slices
from pyspark.sql import functions as F

PAIRS = [(r[0], r[1]) for r in ROWS]
NULL = 1 << 62


def keyed(rows):
    return sorted((NULL if r[0] is None else r[0], *r[1:]) for r in rows)


def ranked():
    return [(NULL if i is None else i, t) for i, t in PAIRS]


def test_groups(docs, empty):
    got = keyed(tuple(r) for r in ngram_join.jaccard_groups(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute.op2(ranked())
    assert ngram_join.jaccard_groups(empty).count() == 0
    kept = sorted((r["doc_id"] for r in ngram_join.one_of_each_group(docs).collect()), key=str)
    assert kept.count(1) == 1 and 2 not in kept and None not in kept and kept.count(6) == 1 and {4, 5, 10} <= set(kept)


def test_groups_of_many_copies(spark):
    words = [f"v{i}" for i in range(200)]
    rows = [(0, " ".join(words))]
    for i in range(1, 60):  # each changes one or two words of the original; some stand alone
        own = list(words)
        for j in range(1 + i % 9):
            own[(i * 7 + 23 * j) % 200] = f"y{i}_{j}"
        rows.append((i, " ".join(own)))
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert keyed(tuple(r) for r in got.collect()) == brute.op2(rows)


def test_substrings(docs, empty):
    got = substring_dedup.repeated_words_removed(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert keyed(tuple(r) for r in got.collect()) == brute.op3(ranked())
    assert substring_dedup.repeated_words_removed(empty).count() == 0


def test_quality_rules(docs, empty):
    got = quality_rules.repetition_rules(docs).collect()
    assert keyed(tuple(r)[:7] for r in got) == brute.op4(ranked())
    assert all(not r["kept"] for r in got if r["base_failed"])
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality_rules.repetition_rules(empty).count() == 0


def test_suffix_array(docs, empty):
    got = suffix_array.repeated_bytes_removed(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert keyed(tuple(r) for r in got.collect()) == brute.op6(ranked())
    assert suffix_array.repeated_bytes_removed(empty).count() == 0


def test_two_stage_order():
    rng = np.random.default_rng(1)
    for _ in range(60):
        length = int(rng.integers(8, 24))
        pieces = [bytes(rng.choice(list(b"abc"[: rng.integers(1, 4)]), int(rng.integers(length, length + 40))).tolist()) for _ in range(8)]
        text = b"".join(pieces)
        end = np.cumsum([len(p) for p in pieces])
        start, last = end - [len(p) for p in pieces], end - length
        order = suffix_array.two_stage_order(text, start, last, end, length)
        window = covered(len(text), start, last + 1)
        order = order[window[order]]
        keys = [text[i : i + length] for i in order.tolist()]
        assert sorted(order.tolist()) == np.flatnonzero(window).tolist() and keys == sorted(keys)


def test_contamination(docs, items, empty):
    found = decontaminate.find_contamination(docs, items)
    got = found.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated")
    want = brute.op7(ranked(), ITEMS)
    assert keyed(tuple(r) for r in got.collect()) == want
    assert decontaminate.clean_documents(docs, items).count() == sum(not w[-1] for w in want)
    assert decontaminate.find_contamination(empty, items).count() == 0
    assert decontaminate.find_contamination(docs, items.limit(0)).filter("contaminated").count() == 0


def test_private(docs, empty):
    found = sanitise.find_private(docs)
    got = found.select("doc_id", F.sha2(sanitise.shown(F.col("base")), 256)).collect()
    assert keyed(tuple(r) for r in got) == [(w[0], w[5]) for w in brute.op10(ranked())]
    clean = {r["doc_id"]: r["text"] for r in sanitise.redact(docs).collect()}
    assert "[EMAIL]" in clean[11] and "[IP]" in clean[11] and "[CARD]" in clean[11] and "[PHONE]" in clean[11] and "smith" not in clean[11]
    assert clean[1] == ROWS[0][1] and clean[4] is None
    assert sanitise.find_private(empty).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"zorblax writes from bob{i % 2}@x.example.com every day the") for i in range(0, 8, 2)] + [(100 + i, "the day every from writes") for i in range(40)]
    spans = sanitise.find_private(spark.createDataFrame(rows, "doc_id long, text string"))
    shown = {r[0]: r[1] for r in spans.select("doc_id", sanitise.shown(F.col("spans"))).collect()}
    assert shown[0].startswith("term:0:7") and "email:20:" in shown[0] and "the" not in shown[0] and shown[100] == ""


def private_spans(spark, rows):
    spans = sanitise.find_private(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r[0]: r[1] for r in spans.select("doc_id", sanitise.shown(F.col("spans"))).collect()}


def test_disclosing_terms_of_whole_documents(spark):
    filler = "the day every from writes and then goes on as all of them do here " * 20
    rows = [(i, f"Zorblax, {filler}mail bob@x.example.com now zorblax") for i in range(3)]
    rows += [(9, "a letter of Zorblax without any address")] + [(100 + i, filler + "mail now") for i in range(40)]
    rows += [(5, rows[0][1]), (5, rows[0][1])]  # an equal row is no further document
    shown = private_spans(spark, rows)
    for i in (0, 1, 2, 5):
        text = rows[0][1]
        at, last = text.index("bob@"), text.rindex("zorblax")
        assert shown[i] == f"term:0:8,email:{at}:{at + 17},term:{last}:{last + 7}"
    assert shown[9] == "term:12:19" and shown[100] == ""


def test_terms_against_brute_force(spark):
    words = [f"t{i}" for i in range(60)]
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        group = int(rng.integers(0, 8))  # documents of a group share an address and some words
        own = [words[int(w)] for w in rng.integers(20, 60, int(rng.integers(0, 12)))]
        own += [words[group * 2 + j] for j in range(2) if rng.random() < 0.8] + [words[18]] * (group == 3)
        own += [f"box{group}@x.example.com"] * (rng.random() < 0.7) + ["box9@x.example.com"] * (rng.random() < 0.3)
        rows.append((i, " ".join(own)))
    found = {}
    documents = [{w for w in t.split(" ") if w} for _, t in set(rows)]
    count = Counter(w for d in documents for w in d)
    pairs = Counter((e, w) for d in documents for e in d if "@" in e for w in d if "@" not in w)
    for (e, w), both in pairs.items():
        if both >= 2 and both < len(documents) and both / count[w] >= sanitise.GENERALISE_SHARE:
            npmi = math.log(both * len(documents) / (count[w] * count[e])) / math.log(len(documents) / both)
            if npmi >= sanitise.MIN_NPMI:
                found[w] = max(found.get(w, ""), "term" if both / count[w] >= sanitise.REMOVE_SHARE else "general")
    shown = private_spans(spark, rows)
    got = {}
    for i, text in rows:
        for kind, start, end in (s.split(":") for s in shown[i].split(",") if s):
            if kind in ("term", "general"):
                assert got.setdefault(text[int(start) : int(end)], kind) == kind
    assert got == found and {"term", "general"} == set(found.values())


def test_repeated_row_is_one_document(spark):
    rows = [(1, "zorblax at bob@x.example.com")] * 2 + [(100 + i, "at") for i in range(20)]
    assert private_spans(spark, rows)[1] == "email:11:28"


def test_terms_of_any_characters(spark):
    words = ["user_4711", "A-1027", "(Smith)", '"Miller"', "smith/jones", "1234", "«Ørsted»,", "中文", "(...)"]
    rows = [(i, " ".join(words) + " at bob@x.example.com") for i in range(2)] + [(8, "Smith, miller! a-1027: ... (1234)")] + [(100 + i, "at") for i in range(20)]
    shown = private_spans(spark, rows)
    text = rows[0][1]
    assert shown[0].split(",")[:-1] == [f"term:{text.index(w)}:{text.index(w) + len(w)}" for w in words[:8]]
    assert shown[0].split(",")[-1].startswith("email:") and shown[8] == "term:0:6,term:7:14,term:15:22,term:27:33" and shown[100] == ""


def assert_settled(rows):
    """No document added, dropped or swapped for another brings any source nearer to its target."""
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append(r)
    for own in sources.values():
        gap = own[0]["_target"] - sum(r["_words"] * r["_copies"] for r in own)
        more = {0, *(r["_words"] for r in own if r["_words"] and r["_copies"] < 3)}
        less = {0, *(r["_words"] for r in own if r["_copies"] > 0)}
        assert abs(gap) <= min(abs(gap - a + b) for a in more for b in less) + 1e-6


def test_mixing_of_small_sources(spark):
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert_settled(got)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["_words"] * r["_copies"]
    assert all(abs(taken[r["source"]] / r["_target"] - 1) < 0.02 for r in got)
    six = [(1, "a " * 7, "x"), (2, "a " * 82, "x"), (3, "a " * 115, "x"), (4, "a " * 900, "x"), (5, "a " * 10, "y"), (6, "a " * 500, "z")]
    assert_settled(mixing.mix(spark.createDataFrame(six, "doc_id long, text string, source string")).collect())


def test_mixing(docs, empty):
    own = docs.drop("_words", "_copies")
    got = mixing.mix(own).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r["_copies"] <= 3 and (r["_words"] or not r["_copies"]) for r in got)
    totals, taken, target = Counter(), Counter(), {}
    for r in got:
        totals[r["source"]] += r["_words"]
        taken[r["source"]] += r["_words"] * r["_copies"]
        target[r["source"]] = r["_target"]
    weights = dict(zip(["a", "b", "c", None], [1, 2, 3, 1], strict=True))
    full, total = set(), sum(totals.values())
    while True:
        level = (total - sum(3 * totals[s] for s in full)) / max(sum(w for s, w in weights.items() if s not in full), 1)
        more = {s for s in weights if s not in full and weights[s] * level > 3 * totals[s]}
        if not more:
            break
        full |= more
    assert target == pytest.approx({s: 3 * totals[s] if s in full else weights[s] * level for s in weights})
    again = Counter((r["doc_id"], r["text"], r["_copies"]) for r in mixing.mix(own).collect())
    assert Counter((r["doc_id"], r["text"], r["_copies"]) for r in got) == again
    assert_settled(got)
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    rows = copies.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == sum((Counter({(r["doc_id"], r["text"]): r["_copies"]}) for r in got), Counter())
    assert all(r["_words"] == "own_words" and r["_key"] == "own_key" for r in rows)
    assert mixing.mix(empty).count() == 0


def test_mixing_leaves_texts_in_place(spark, monkeypatch):
    rows = [(i, "w " * (i % 7 + 1), "xyz"[i % 3]) for i in range(200)]
    own = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    made = mixing.mixed_documents(own)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Aggregate" not in plan
    near = Counter(r["doc_id"] for r in made.collect())
    # Many cuts, and cells of many parts: the same mix by another join.
    monkeypatch.setattr(mixing, "BROADCAST_CUTS", 0)
    assert Counter(r["doc_id"] for r in mixing.mixed_documents(own).collect()) == near
    monkeypatch.setattr(mixing, "CELL", 3)
    got = mixing.mix(own).collect()
    assert len(got) == len(rows) and all(0 <= r["_copies"] <= 3 for r in got)
    assert_settled(got)


def test_mixing_of_equal_rows(spark):
    rows = [(1, "a b c", "x")] * 5 + [(2, "a b c", "x"), (3, "d", "y")] + [(4, "e f g h", "z")] * 9 + [(None, "i j", None)] * 3
    own = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(own).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter(rows)
    assert_settled(got)
    for many in ([r["_copies"] for r in got if r["doc_id"] == i] for i in (1, 4, None)):
        assert max(many) - min(many) <= 1
    assert any(len({r["_copies"] for r in got if r["doc_id"] == i}) == 2 for i in (1, 4, None))
    taken = sum((Counter({r["doc_id"]: r["_copies"]}) for r in got), Counter())
    assert Counter(r["doc_id"] for r in mixing.mixed_documents(own).collect()) == taken


def test_classifier(docs, spark, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 0), (7, 0), (9, 0), (None, 1), (8, None)], "doc_id long, quality int")
    got = quality_classifier.quality_scores(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert {r["score"] for r in quality_classifier.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_scores(empty, labels).count() == 0


def test_isotonic():
    x, y = quality_classifier.isotonic(np.arange(5.0), np.array([1.0, 0, 2, 1, 4]), np.array([1.0, 1, 2, 2, 4]))
    assert (np.diff(y) > 0).all() and len(x) == len(y)


def test_language_model(docs, empty):
    got = language_model.score_documents(docs).collect()
    counts, tokens = Counter(), defaultdict(list)
    for i, t in PAIRS:
        own = [*brute.W.findall(brute.lower(t or "")), 0]
        tokens[i].append(own)
        if i is None or zlib.crc32(str(i).encode()) % 10:
            counts.update(own)
    total = sum(counts.values())
    price = lambda own: sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in own)
    want = keyed((i, len(w), sum(counts[x] > 0 for x in w), total, round(price(w), 6)) for i, ws in tokens.items() for w in ws)
    assert keyed((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert language_model.score_documents(empty).count() == 0


def test_network_gradient():
    net = language_model.Network(np.array([0, 0, 1, 1, 1, 2]))
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    state, before, target = np.zeros((2, language_model.HIDDEN)), np.array([5, 5]), np.array([1, 3])

    def loss():
        h = net.step(state, before)[0]
        return -net.log_probability(net.step(h, target)[0], target)[0].sum()

    gradients = {k: np.zeros_like(v) for k, v in net.weights.items()}
    h, *rest = net.step(state, before)
    h2, *rest2 = net.step(h, target)
    _, back = net.log_probability(h2, target, gradients)
    net._backward([(state, before, *rest), (h, target, *rest2)], np.stack([np.zeros_like(back), back]), gradients, end=5)
    for name in ("u", "x", "c", "w", "b"):
        spot = np.unravel_index(np.abs(gradients[name]).argmax(), gradients[name].shape)
        net.weights[name][spot] += 1e-5
        up = loss()
        net.weights[name][spot] -= 2e-5
        down = loss()
        net.weights[name][spot] += 1e-5
        assert gradients[name][spot] == pytest.approx((up - down) / 2e-5, rel=1e-3)


def test_training_updates_do_not_follow_the_stream(monkeypatch):
    seen = []

    def count(self, states, target, gradients=None):
        seen.append(len(target))
        return np.zeros(len(target)), np.zeros_like(states)

    monkeypatch.setattr(language_model.Network, "log_probability", count)
    monkeypatch.setattr(language_model.Network, "_backward", lambda *a: None)
    net = language_model.Network(np.array([0, 0, 1, 1, 1, 2]))
    stream = np.random.default_rng(0).integers(0, 6, 1_600_021).astype(np.int16)
    net.train(stream, 5)
    assert len(stream) - sum(seen) < 64
    assert len(seen) < 700  # 1,042 with 64 lanes


def test_score_of_documents_in_step(monkeypatch):
    rng = np.random.default_rng(0)
    net = language_model.Network(np.array([0, 0, 1, 1, 1, 2]))
    net.train(rng.integers(0, 6, 5000).astype(np.int16), 5)
    size = rng.integers(1, 70, 40)
    symbols = rng.integers(0, 5, size.sum()).astype(np.int16)
    symbols[np.cumsum(size) - 1] = 5
    monkeypatch.setattr(language_model, "LANES", 7)
    want = []
    for own in np.split(symbols, np.cumsum(size)[:-1]):
        state, before, total = np.zeros((1, language_model.HIDDEN), np.float32), 5, 0.0
        for x in own:
            state = net.step(state, np.array([before]))[0]
            logits = state[0] @ net.weights["c"] + net.weights["cb"]
            inside = np.flatnonzero(net.classes == net.classes[x])
            words = state[0] @ net.weights["w"][:, inside] + net.weights["wb"][inside]
            total += logits[net.classes[x]] - np.log(np.exp(logits).sum()) + words[x - inside[0]] - np.log(np.exp(words).sum())
            before = x
        want.append(total)
    assert net.score(symbols, size, 5) == pytest.approx(np.array(want), rel=1e-4, abs=1e-4)


def test_training_covers_all_documents(spark, monkeypatch):
    monkeypatch.setattr(language_model, "TRAIN_TOKENS", 200, raising=False)
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 200, raising=False)
    texts = [" ".join(f"own{i}x{j}" for j in range(4)) + " " for i in range(150)]
    rows = [(i, text * 6) for i, text in enumerate(texts)]
    held = next(slices(iter(pa.table({"text": [t for _, t in rows]}).to_batches()))).words(lower=True)
    known = np.unique(held.hash)
    n = len(known) + 2
    network = language_model.Network(np.arange(n) * 8 // n)
    before = network.weights["x"].copy()
    source = spark.createDataFrame(rows, "row long, text string").withColumn("train", F.lit(True))
    after = language_model._trained(source, network, len(held) + len(rows), known, np.arange(n - 2), n - 1, n - 2)
    learnt = (after["x"][: n - 2] != before[: n - 2]).any(axis=1)
    assert len(known) == 600 and learnt.mean() > 0.99 and np.isfinite(after["x"]).all()


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, "a", "f", '{"y": 1, "x": "t"}', None), (1, "b", "f", '{"x": 2}', ["a", "a"]), (1, "c", "f", "{oops", ["b"]),
         (1, "d", "g", "{}", ["e"]), (1, "e", "g", "{}", ["d"]), (2, "a", "f", None, ["zz"]), (None, "q", "f", '{"x": ""}', [])],
        tool_calls.CALLS,
    )
    results = spark.createDataFrame([(1, "a", "r2"), (1, "a", "r1"), (1, "b", None), (None, "q", "x")], "conv_id long, call_id string, content string")
    schemas = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "string"}}}}
    got = {(r["conv_id"], r["call_id"]): r for r in tool_calls.format_calls(calls, results, schemas).collect()}
    assert [got[1, c]["level"] for c in "abcde"] == [0, 1, 2, None, None] and got[2, "a"]["level"] is None and got[None, "q"]["level"] == 0
    assert got[1, "a"]["valid"] and got[1, "a"]["n_results"] == 2 and got[None, "q"]["n_results"] == 0
    assert got[1, "a"]["messages"] == '[{"role":"assistant","tool_calls":[{"function":{"arguments":{"x":"t","y":1},"name":"f"},"id":"a","type":"function"}]},{"content":"r1","role":"tool","tool_call_id":"a"}]'
    assert got[1, "b"]["problems"] == "$.x: not string" and got[1, "c"]["problems"] == "$: not JSON" and got[1, "d"]["problems"] == "no schema"
    assert tool_calls.format_calls(calls.limit(0), results, schemas).count() == 0


def test_tool_calls_lose_no_row(spark):
    calls = spark.createDataFrame(
        [(None, "a", "f", "1", None), (None, "a", "f", "2", None), (1, None, "f", "3", ["b"]), (1, None, "f", "4", ["zz"]), (1, "b", "f", "5", None), (1, "b", "f", "6", None)],
        tool_calls.CALLS,
    )
    results = spark.createDataFrame([(1, "b", "y"), (1, "b", "x"), (1, "b", "x"), (1, "zz", "orphan"), (None, "a", "n"), (1, None, None)], "conv_id long, call_id string, content string")
    got = [r.asDict() for r in tool_calls.format_calls(calls, results, {}).collect()]
    assert sorted((r["conv_id"] or 0, r["call_id"] or "", r["level"] if r["level"] is not None else -1, r["n_calls"], r["n_results"]) for r in got) == [
        (0, "a", 0, 1, 0), (0, "a", 0, 1, 0), (1, "", -1, 1, 0), (1, "", 1, 1, 0), (1, "b", 0, 2, 3),
    ]
    both = next(r for r in got if r["call_id"] == "b")
    assert '"x"' in both["messages"] and both["other_results"] == '["y"]' and both["other_calls"] == '[{"after":null,"arguments":"6","name":"f"}]'
    left = sorted((r["call_id"] or "", r["messages"], r["problems"]) for r in tool_calls.unlinked_results(calls, results).collect())
    assert [x[0] for x in left] == ["", "a", "zz"] and "orphan" in left[2][1] and all(x[2] == "no call" for x in left)


def test_turns_keep_all_answers(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "z"), (1, 2, "assistant", "b"), (1, 5, "user", "r"), (1, 9, "assistant", "c"), (2, 0, "assistant", "d"), (None, 1, "assistant", "e")]
    calls, results = tool_calls.turns_as_calls(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {r["call_id"]: r for r in tool_calls.format_calls(calls, results, tool_calls.REPLY).collect()}
    assert '"z"' in got["call_0"]["messages"] and got["call_0"]["other_results"] == '["b"]' and '"c"' in got["call_5"]["messages"]
    assert tool_calls.unlinked_results(calls, results).count() == 2


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows.columns == source.columns
    kept = {r["doc_id"] for r in rows.collect()}
    good = {w[0]: w[6] for w in brute.op4([(r["doc_id"], r["text"]) for r in source.collect()])}
    assert kept and not any(good[i] for i in kept)
