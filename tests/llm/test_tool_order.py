"""Levels of tool calls against brute force, schemas, unreadable arguments, stretches of long conversations."""

import random

from pathloom.llm import tool_calls


def _levels(calls):
    """Level of each (conv_id, call_id), None on cycles and after missing calls."""
    needs = {(c, i): {(c, a) for a in after or []} for c, i, after in calls}
    level = {}
    while True:
        ready = {k: 1 + max((level[n] for n in ns), default=-1) for k, ns in needs.items() if k not in level and all(n in level for n in ns)}
        if not ready:
            return level
        level.update(ready)


def test_levels_equal_brute_force(spark):
    draw = random.Random(1)
    calls = [(1, f"c{i}", [f"c{i - 1}"] if i else None) for i in range(100)]  # one long chain
    for c in (5, 6, 7):
        calls += [(c, f"c{i}", draw.sample([f"c{j}" for j in range(i)] + ["gone"] * (draw.random() < 0.05), min(i, draw.randrange(4)))) for i in range(40)]
    calls += [(3, "a", ["b"]), (3, "b", ["c"]), (3, "c", ["b"]), (3, "d", ["a", "e"]), (3, "e", None), (3, "f", ["e", "e", None]), (3, "g", ["g"])]
    calls += [(4, f"c{i}", [f"c{i - 1}"] if i % 7 else [f"c{i - 1}", f"c{i // 2}"] if i else []) for i in range(60)]  # chains between joins
    rows = spark.createDataFrame([(c, i, "f", "{}", a) for c, i, a in calls], tool_calls.CALLS)
    results = spark.createDataFrame([], "conv_id long, call_id string, content string")
    want = _levels(calls)
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in tool_calls.format_calls(rows, results, {"f": True}).collect()}
    assert len(got) == len(calls) and {k: v for k, v in got.items() if v is not None} == want


def test_schemas():
    ask = tool_calls.violations
    assert ask(None, {"type": ["string", "null"]}) == [] and ask(3, {"type": ["string", "null"]}) == ["$: not string or null"]
    assert ask(3, {"type": "colour"}) == ["$: unknown type colour"] and ask(3, {"format": "x"}) == ["$: unknown keyword format"]
    assert ask(3, True) == [] and ask(3, False) == ["$: not allowed"] and ask({"a": 1}, {"properties": {"a": False}}) == ["$.a: not allowed"]
    assert ask(1.0, {"type": "integer"}) == [] and ask(1.5, {"type": "integer"}) == ["$: not integer"] and ask(True, {"type": "number"}) == ["$: not number"]
    assert ask(True, {"enum": [1]}) == ["$: not in enum"] and ask(1.0, {"enum": [1]}) == [] and ask([1], {"const": [1.0]}) == [] and ask("a", {"const": "b"})
    assert ask(11, {"maximum": 10}) == ["$: above maximum"] and ask("abc", {"maxLength": 2}) == ["$: too long"] and ask("abc", {"pattern": "^b"}) == ["$: not in pattern"]
    assert ask(5, {"multipleOf": 0.5}) == [] and ask(0.3, {"multipleOf": 0.1}) == [] and ask(5, {"multipleOf": 2}) == ["$: not a multiple"]
    assert ask([1, 1.0], {"uniqueItems": True}) == ["$: repeated items"] and ask([1, True], {"uniqueItems": True}) == []
    assert ask("a", {"anyOf": [{"type": "integer"}, {"minLength": 2}]}) == ["$: none of anyOf"] and ask(3, {"oneOf": [{"type": "integer"}, {"minimum": 1}]}) == ["$: not one of oneOf"]
    assert ask(3, {"not": {"type": "integer"}}) == ["$: ruled out"] and ask(3, {"allOf": [{"minimum": 4}, {"maximum": 2}]}) == ["$: below minimum", "$: above maximum"]
    assert ask({"b": "x"}, {"additionalProperties": {"type": "integer"}}) == ["$.b: not integer"]


def test_unreadable_arguments(spark):
    odd = ["NaN", "[Infinity]", "1e999", "[" * 100_000, "[" * 300 + "]" * 300, '"\\ud800"', "null", "", "{" * 9]
    rows = spark.createDataFrame([(1, str(i), "f", a, None) for i, a in enumerate(odd)], tool_calls.CALLS)
    results = spark.createDataFrame([], "conv_id long, call_id string, content string")
    got = {int(r["call_id"]): r["problems"] for r in tool_calls.format_calls(rows, results, {"f": {}}).collect()}
    deep, bad = "$: nested too deep", "$: not JSON"
    assert [got[i] for i in range(len(odd))] == [bad, bad, bad, deep, deep, "", "$: missing", bad, bad]


def test_answers_find_calls_across_stretches(spark):
    n = tool_calls.STRETCH
    turns = [0, 1, n - 1, n, 2 * n + 5, 4 * n, -3, -2]
    roles = {0: "user", 1: "assistant", n - 1: "assistant", n: "assistant", 2 * n + 5: "user", 4 * n: "assistant", -3: "assistant", -2: None}
    rows = spark.createDataFrame([(7, t, roles[t], f"t{t}") for t in turns] + [(7, 1, "assistant", "again")], "conv_id long, turn long, role string, text string")
    _, answers = tool_calls.turns_as_calls(rows)
    got = sorted((r["at"], r["content"], r["call_id"]) for r in answers.collect())
    first = "call_0"
    assert got == [(-3, "t-3", None), (1, "again", first), (1, "t1", first), (n - 1, f"t{n - 1}", first), (n, f"t{n}", first), (4 * n, f"t{4 * n}", f"call_{2 * n + 5}")]
