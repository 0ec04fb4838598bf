"""Chat formatting: tool calls linked to results, ordered, validated and written as canonical JSON.

Calls (conv_id, call_id, name, arguments as JSON text, after: ids of calls it needs) and results
(conv_id, call_id, content) are hash-joined by identifier.  Calls take levels in topological order: 0 if
they need nothing, else one more than the highest call they need.  Chains of calls with one need each are
jumped by doubling: every round joins a call to the call its pointer has reached and adds the distances, so
a chain of n calls takes log2(n) rounds.  Calls with several needs are then relaxed by joins over the
distances, one round per such call on the longest path.  A call on a cycle, or after a missing call, never
gets a level.  Arguments are checked against the schema of the tool, and every message is one line of JSON
with sorted keys.

Schemas: a boolean, or an object with the keywords of ``KEYWORDS``; any other keyword is reported, not passed
over.  Numbers are equal by value (1.0 is an integer and equals 1), true and false are no numbers.  NaN,
infinite numbers and text nested deeper than Python reads are no arguments: the text is kept and reported.

Cases: null or unreadable arguments are reported, not dropped; of several calls or results with one
identifier the first (results: by ``at`` if there is such a column; then by content) is used, their number
reported and the other distinct ones written in order beside it; a null identifier links nothing, and each
such call is a row of its own; ``unlinked_results`` reports the results without a call; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.text import batch
from pathloom.session import save_shared

STRETCH = 1024  # turns of a conversation that one window orders
CALLS = "conv_id long, call_id string, name string, arguments string, after array<string>"
DEPTH = 200  # levels of nesting that arguments may have

_number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
TYPES: dict[str, Callable[[object], bool]] = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: _number(v) and v == int(v),
    "number": _number,
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}
# Keywords that say nothing about a value.
NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment", "deprecated", "readOnly", "writeOnly"}
# keyword -> (kind of value it speaks of, whether the value keeps it, what is wrong otherwise)
BOUNDS: dict[str, tuple[str, Callable, str]] = {
    "minLength": ("string", lambda v, x: len(v) >= x, "too short"),
    "maxLength": ("string", lambda v, x: len(v) <= x, "too long"),
    "pattern": ("string", lambda v, x: re.search(x, v) is not None, "not in pattern"),
    "minimum": ("number", lambda v, x: v >= x, "below minimum"),
    "maximum": ("number", lambda v, x: v <= x, "above maximum"),
    "exclusiveMinimum": ("number", lambda v, x: v > x, "not above minimum"),
    "exclusiveMaximum": ("number", lambda v, x: v < x, "not below maximum"),
    "multipleOf": ("number", lambda v, x: Fraction(str(v)) % Fraction(str(x)) == 0, "not a multiple"),
    "minItems": ("array", lambda v, x: len(v) >= x, "too few items"),
    "maxItems": ("array", lambda v, x: len(v) <= x, "too many items"),
    "uniqueItems": ("array", lambda v, x: not x or len({canonical(_plain(i)) for i in v}) == len(v), "repeated items"),
    "minProperties": ("object", lambda v, x: len(v) >= x, "too few properties"),
    "maxProperties": ("object", lambda v, x: len(v) <= x, "too many properties"),
}
KEYWORDS = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "allOf", "anyOf", "oneOf", "not", *BOUNDS, *NOTES}


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; ValueError for numbers that JSON cannot hold."""
    line = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    try:
        line.encode()
    except UnicodeEncodeError:  # half a surrogate pair stays an escape
        return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return line


def _plain(value):
    """Numbers without a fraction as integers, so that equal values are written alike."""
    if isinstance(value, float) and value == int(value):
        return int(value)
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return {k: _plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def _equal(a, b) -> bool:
    return canonical(_plain(a)) == canonical(_plain(b))


def violations(value, schema: dict | bool, at: str = "$") -> list[str]:
    """What of ``value`` breaks a JSON schema, and which of the schema's keywords are unknown."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    if not isinstance(schema, dict):
        return [f"{at}: schema is no schema"]
    out = [f"{at}: unknown keyword {k}" for k in sorted(schema.keys() - KEYWORDS)]
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        unknown = [str(k) for k in kinds if k not in TYPES]
        out += [f"{at}: unknown type {k}" for k in unknown]
        if not unknown and not any(TYPES[k](value) for k in kinds):
            return [*out, f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and not any(_equal(value, v) for v in schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and not _equal(value, schema["const"]):
        out.append(f"{at}: not the constant")
    out += [f"{at}: {wrong}" for k, (kind, keeps, wrong) in BOUNDS.items() if k in schema and TYPES[kind](value) and not keeps(value, schema[k])]
    for part in schema.get("allOf", ()):
        out += violations(value, part, at)
    if "anyOf" in schema and all(violations(value, part, at) for part in schema["anyOf"]):
        out.append(f"{at}: none of anyOf")
    if "oneOf" in schema and sum(not violations(value, part, at) for part in schema["oneOf"]) != 1:
        out.append(f"{at}: not one of oneOf")
    if "not" in schema and not violations(value, schema["not"], at):
        out.append(f"{at}: ruled out")
    if isinstance(value, dict):
        known, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k not in known and others is False:
                out.append(f"{at}.{k}: unknown")
            else:
                out += violations(value[k], known.get(k, others), f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    return out


def _no_number(name: str):
    raise ValueError(name)


def _depth(value) -> int:
    """Levels of nesting, counted without recursion."""
    level, depth = [value], 0
    while level := [x for v in level if isinstance(v, (list, dict)) for x in (v.values() if isinstance(v, dict) else v)]:
        depth += 1
    return depth


def read_arguments(text: str | None) -> tuple[object, str | None]:
    """The value of a JSON text, or the text itself and why it is none."""
    if text is None:
        return None, "$: missing"
    try:
        value = json.loads(text, parse_constant=_no_number)
        if _depth(value) > DEPTH:
            return text, "$: nested too deep"
        canonical(value)
    except RecursionError:
        return text, "$: nested too deep"
    except ValueError:
        return text, "$: not JSON"
    return value, "$: missing" if value is None else None


KEY = ["conv_id", "call_id"]
HAS_KEY = "conv_id IS NOT NULL AND call_id IS NOT NULL"
OUT = (
    "conv_id long, call_id string, level int, n_calls long, n_results long, valid boolean, problems string, messages string, "
    "other_calls string, other_results string"
)


def _ordered(results: DataFrame) -> DataFrame:
    at = F.col("at").cast("long") if "at" in results.columns else F.lit(0).cast("long")
    order = F.struct(at.alias("at"), F.col("content").isNull().alias("none"), F.col("content").cast("string").alias("content"))
    return results.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"), order.alias("r"))


def _linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each call identifier, and one for each call without; ``uid`` tells rows apart once written."""
    call = F.struct("name", "arguments", "after")
    known = calls.filter(HAS_KEY).groupBy(*KEY).agg(F.array_sort(F.collect_set(call)).alias("c"), F.count("*").alias("n_calls"))
    alone = calls.filter(f"NOT ({HAS_KEY})").select(*KEY, F.array(call).alias("c"), F.lit(1).cast("long").alias("n_calls"))
    results = _ordered(results).filter(HAS_KEY).groupBy(*KEY).agg(F.array_sort(F.collect_set("r")).alias("r"), F.count("*").alias("n_results"))
    linked = known.join(results, KEY, "left").unionByName(alone, allowMissingColumns=True)
    others = F.array_distinct(F.col("r.content"))
    linked = linked.select(
        F.monotonically_increasing_id().alias("uid"), *KEY, F.col("c")[0]["name"].alias("name"), F.col("c")[0]["arguments"].alias("arguments"),
        F.col("c")[0]["after"].alias("after"), "n_calls", F.get("r", F.lit(0))["content"].alias("result"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.slice("c", 2, F.size("c")).alias("other_calls"), F.slice(others, 2, F.size(others)).alias("other_results"),
    )
    return linked.withColumn("after", F.array_distinct(F.coalesce("after", F.array().cast("array<string>"))))


def _reached(linked: DataFrame) -> DataFrame:
    """(uid, conv_id, call_id, n, base, steps): the call without exactly one need that a chain of single needs ends at.

    Calls whose chain ends at a missing call or never ends have no row.
    """
    single = F.size("after") == 1
    rows = linked.select(
        "uid", *KEY, F.size("after").alias("n"), F.when(single, F.col("after")[0]).otherwise(F.col("call_id")).alias("base"),
        F.when(single, 1).otherwise(0).alias("steps"), (~single).alias("done"),
    )
    rows, before = save_shared(rows, "call-chains"), -1
    while True:
        n_done, n_open = rows.agg(F.count_if("done"), F.count_if(~F.col("done"))).first()
        # A chain that ends gains a call in every round; where none does, only cycles are left.
        if not n_open or n_done == before:
            return rows.filter("done")
        before = n_done
        ahead = rows.filter(HAS_KEY).select("conv_id", F.col("call_id").alias("base"), F.col("base").alias("to"), F.col("steps").alias("more"), F.col("done").alias("ends"))
        moved = rows.filter("NOT done").join(ahead, ["conv_id", "base"]).select("uid", *KEY, "n", F.col("to").alias("base"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("done"))
        rows = save_shared(rows.filter("done").unionByName(moved), "call-chains")


def _levels(linked: DataFrame) -> DataFrame:
    """(uid, level) of the calls that can be ordered."""
    reached = _reached(linked)
    several = linked.filter(F.size("after") > 1).select("uid", *KEY, F.size("after").alias("n"), F.explode("after").alias("need"))
    ends = reached.filter(HAS_KEY).select("conv_id", F.col("call_id").alias("need"), "base", "steps")
    # What a call with several needs waits for: the ends of their chains, and how far away those are.
    waits = save_shared(several.join(ends, ["conv_id", "need"]).select("uid", *KEY, "n", "base", "steps"), "call-needs")
    placed = reached.filter("n = 0").select("uid", *KEY, F.lit(0).alias("level"))
    if not waits.isEmpty():
        placed = _relaxed(waits, save_shared(placed, "call-levels"))
    # Other calls stand above the end of their chain; a call without an identifier may be one.
    own = placed.select("uid", "level")
    chained = reached.filter("n = 1").join(placed.filter(HAS_KEY).select("conv_id", F.col("call_id").alias("base"), "level"), ["conv_id", "base"])
    return own.unionByName(chained.select("uid", (F.col("level") + F.col("steps")).alias("level")))


def _relaxed(waits: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` levels and those of the calls that wait only for calls with a level."""
    named = lambda rows, *more: rows.select("conv_id", F.col("call_id").alias("base"), *more)
    front = known
    for turn in count(1):
        # Only calls after one of the last round can become ready.
        touched = waits.join(named(front), ["conv_id", "base"], "left_semi").select("uid").distinct()
        ready = waits.join(touched, "uid").join(named(known.filter(HAS_KEY), "level"), ["conv_id", "base"])
        ready = ready.groupBy("uid").agg(
            F.first("conv_id").alias("conv_id"), F.first("call_id").alias("call_id"), F.count("*").alias("met"), F.max("n").alias("n"),
            (F.max(F.col("level") + F.col("steps")) + 1).alias("level"),
        ).filter("met = n")
        front = save_shared(ready.select("uid", *KEY, "level"), "call-levels")
        if front.isEmpty():
            return known
        known = known.unionByName(front)
        if turn % 8 == 0:  # long paths: the plan stays short
            known = save_shared(known, "call-levels")


def _written(batches: Iterator[pa.RecordBatch], schemas: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        lines, problems, calls, results = [], [], [], []
        for row in rows.to_pylist():
            arguments, wrong = read_arguments(row["arguments"])
            found = [wrong] if wrong else violations(arguments, schemas[row["name"]]) if row["name"] in schemas else ["no schema"]
            problems.append("; ".join(found))
            call = {"id": row["call_id"], "type": "function", "function": {"name": row["name"], "arguments": arguments}}
            answer = {"role": "tool", "tool_call_id": row["call_id"], "content": row["result"]} if row["n_results"] else None
            messages = [{"role": "assistant", "tool_calls": [call]}, *([answer] if answer else [])]
            lines.append(canonical(messages))
            calls.append(canonical(row["other_calls"] or []))
            results.append(canonical(row["other_results"] or []))
        yield batch(
            **{c: rows.column(c) for c in ("conv_id", "call_id", "level", "n_calls", "n_results")},
            valid=pa.array([not p for p in problems], pa.bool_()), problems=pa.array(problems, pa.string()), messages=pa.array(lines, pa.string()),
            other_calls=pa.array(calls, pa.string()), other_results=pa.array(results, pa.string()),
        )


def format_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call: its level, link counts, validity of its arguments, and call and result as JSON."""
    linked = save_shared(_linked(calls, results), "linked-calls")
    placed = linked.join(_levels(linked), "uid", "left").select(linked["*"], "level")
    return placed.mapInArrow(lambda rows: _written(rows, schemas), OUT)


def _unlinked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        lines = [canonical([{"role": "tool", "tool_call_id": r["call_id"], "content": r["content"]}]) for r in rows.to_pylist()]
        n = len(lines)
        empty = pa.array(["[]"] * n, pa.string())
        yield batch(
            conv_id=rows.column("conv_id"), call_id=rows.column("call_id"), level=pa.nulls(n, pa.int32()), n_calls=pa.array([0] * n, pa.int64()), n_results=pa.array([1] * n, pa.int64()),
            valid=pa.array([False] * n, pa.bool_()), problems=pa.array(["no call"] * n, pa.string()), messages=pa.array(lines, pa.string()), other_calls=empty, other_results=empty,
        )


def unlinked_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row per result that has no call, or a null identifier, in the columns of ``format_calls``."""
    named = calls.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id")).filter(HAS_KEY).distinct()
    left = _ordered(results).join(named, KEY, "left_anti")  # a null equals nothing
    return left.select(*KEY, "r.content").mapInArrow(_unlinked, OUT)


# Schema of the call that a conversation's turns stand for.
REPLY = {
    "reply": {
        "type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "system": {"type": "boolean"}},
    }
}


def _latest(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, asked): the latest earlier turn with ``asks``, null where there is none.

    A long conversation is spread over stretches of turns; one row per stretch carries the latest turn over.
    """
    stretch = F.floor(F.col("turn") / STRETCH).alias("stretch")
    places = turns.groupBy("conv_id", stretch, "turn").agg(F.max(F.when(F.col("asks"), F.col("turn"))).alias("call"))
    earlier = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    inside = places.withColumn("near", F.max("call").over(earlier.partitionBy("conv_id", "stretch")))
    before = places.groupBy("conv_id", "stretch").agg(F.max("call").alias("call"))
    before = before.withColumn("far", F.max("call").over(Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)))
    return inside.join(before.select("conv_id", "stretch", "far"), ["conv_id", "stretch"]).select("conv_id", "turn", F.coalesce("near", "far").alias("asked"))


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the model are results of the latest earlier call; every other turn is a call.

    A call needs the call two turns earlier (the question before the last answer) where there is one.
    """
    place = F.col("turn").cast("long")
    name = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), place.alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    asked = turns.filter(~F.col("role").eqNullSafe("assistant"))
    system = F.col("role").eqNullSafe("system")
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), "turn", F.when(system, F.lit(True)).alias("system")))
    before = asked.select("conv_id", (F.col("turn") + 2).alias("turn")).distinct().withColumn("earlier", F.lit(True))
    asked = asked.join(before, ["conv_id", "turn"], "left")
    after = F.when(F.col("earlier"), F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    calls = asked.select("conv_id", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), after.alias("after"))
    # Without a null key: a null conversation or turn links nothing.
    known = turns.filter("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("asks", ~F.col("role").eqNullSafe("assistant"))
    placed = known.filter("NOT asks").join(_latest(known), ["conv_id", "turn"]).select(turns.columns + ["asked"])
    placed = placed.unionByName(turns.filter("conv_id IS NULL OR turn IS NULL"), allowMissingColumns=True)
    answers = placed.filter(F.col("role") == "assistant").select("conv_id", name(F.col("asked")).alias("call_id"), F.col("text").alias("content"), F.col("turn").alias("at"))
    return calls, answers
