"""Chat formatting: linking tool calls with their results.

Calls and results are joined by conversation and identifier. Calls are put in a topological order: a call's key is the
latest position among itself and all that it depends on, directly or not; among calls with the same key those come first
whose dependencies are out. If every call depends on earlier ones only, keys are positions, and one join proves it;
otherwise keys grow by joins until they are stable. Each round also follows a pointer to the best call found so far, so
that a chain of n calls takes about log n rounds. No conversation is gathered in one place: the order is given as
sortable columns. Arguments are checked against the tool's schema, and each linked call is written as canonical JSON
(sorted keys, no spaces, UTF-8).

Edge cases: of several calls with one identifier in a conversation the first by position counts, the others have status
"duplicate"; of several results the first after the call counts; a call without result has status "pending"; results
without call are rows with status "orphan", those that don't come after their call rows with status "early"; calls that
depend on each other in a circle, or lie on a path from one circle to another, have status "cyclic" (calls behind a circle
don't, and come after it); dependencies on unknown calls are ignored; rows without conversation or identifier are left out; null arguments count as
{}; arguments that aren't JSON, hold NaN, infinite numbers or lone surrogates, or are nested in more than DEPTH levels are
an error of that call alone, "arguments: not JSON"; repeated rows are one call. Rows come with these columns alone; others of the input are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import materialise

KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


#: Levels of arrays and objects in a call's arguments, well below what the parser takes.
DEPTH = 500


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def problem(value: Any, schema: dict, at: str = "") -> str | None:
    """The first way in which a value doesn't meet a JSON schema: type, enum, required, properties, additionalProperties, items."""
    where = at or "arguments"
    kind = schema.get("type")
    if kind and (not isinstance(value, KINDS[kind]) or kind in ("integer", "number") and isinstance(value, bool)):
        return f"{where}: not of type {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{where}: not one of the values allowed"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                return f"{where}: {name} is missing"
        for name in sorted(value):
            if name in known:
                if found := problem(value[name], known[name], f"{at}.{name}".lstrip(".")):
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{where}: {name} is not known"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if found := problem(x, schema["items"], f"{where}[{i}]"):
                return found
    return None


def deeper(value: Any, limit: int) -> bool:
    """Whether arrays and objects are nested in more than `limit` levels; without recursion."""
    level = [value] if isinstance(value, (dict, list)) else []
    for _ in range(limit):
        level = [x for v in level for x in (v.values() if isinstance(v, dict) else v) if isinstance(x, (dict, list))]
    return bool(level)


def checked(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[str | None, str | None]:
    """Canonical arguments (None if they aren't JSON) and what is wrong with them."""
    try:
        value = json.loads(arguments, parse_constant=_refuse) if arguments is not None else {}
        if deeper(value, DEPTH):
            raise ValueError("nested too deeply")
        text = canonical(value)
        text.encode("utf-8")
        return text, problem(value, schemas[name]) if name in schemas else "unknown tool"
    except (ValueError, RecursionError):
        return None, "arguments: not JSON"


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages (conv_id, turn, role, text) that hold tool calls as JSON, {"tool_calls": [{id, name, arguments, depends_on}]}
    of the assistant and {"tool_call_id", "content"} of the tool, to calls and results."""
    kind = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>,tool_call_id:string,content:string>"
    read = messages.select("conv_id", "turn", "role", F.from_json("text", kind).alias("m"))
    calls = read.filter("role = 'assistant'").select("conv_id", "turn", F.posexplode("m.tool_calls").alias("number", "c"))
    calls = calls.select("conv_id", (F.col("turn").cast("long") * 65536 + F.col("number")).alias("position"), F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"))
    results = read.filter("role = 'tool' and m.tool_call_id is not null")
    return calls, results.select("conv_id", (F.col("turn").cast("long") * 65536).alias("position"), F.col("m.tool_call_id").alias("call_id"), F.col("m.content").alias("content"))


def longest(edges: DataFrame) -> DataFrame:
    """Edges (conv_id, call_id, on, limit) to conv_id, call_id, steps: the length of the longest path from a call along
    edges, or `limit` if that is no more than the length (as it is where a circle is reached)."""
    state = materialise(edges.groupBy("conv_id", "call_id", "limit").agg(F.max("on").alias("far")).withColumn("steps", F.lit(1)))
    while True:
        hops = edges.withColumn("far_off", F.lit(1)).unionByName(state.select("conv_id", "call_id", F.col("far").alias("on"), "limit", F.col("steps").alias("far_off")))
        ahead = state.select("conv_id", F.col("call_id").alias("on"), F.col("steps").alias("more"), F.col("far").alias("next"))
        reach = F.struct(F.least(F.col("far_off") + F.coalesce("more", F.lit(0)), F.col("limit")).alias("steps"), F.coalesce("next", "on").alias("far"))
        best = hops.join(ahead, ["conv_id", "on"], "left").groupBy("conv_id", "call_id", "limit").agg(F.max(reach).alias("best"))
        grown = materialise(state.withColumnRenamed("steps", "was").drop("far", "limit").join(best, ["conv_id", "call_id"]).select("conv_id", "call_id", "limit", "best.far", "best.steps", (F.col("best.steps") > F.col("was")).alias("longer")))
        state = grown.drop("longer")
        if grown.filter("longer").isEmpty():
            return state.select("conv_id", "call_id", "steps", (F.col("steps") == F.col("limit")).alias("endless"))


def topological(calls: DataFrame) -> DataFrame:
    """Distinct calls (conv_id, call_id, position, depends_on), a written table, to conv_id, call_id, order_key,
    order_step, cyclic. Sorting by (order_key, order_step, position) is a topological order."""
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("on"))
    known = calls.select("conv_id", F.col("call_id").alias("on"))
    edges = materialise(edges.join(known, ["conv_id", "on"], "left_semi").select("conv_id", "call_id", "on"))
    keys = calls.select("conv_id", "call_id", F.col("position").alias("order_key"), F.col("call_id").alias("best"))
    while True:
        hops = edges.unionByName(keys.filter("best != call_id").select("conv_id", "call_id", F.col("best").alias("on")))
        later = hops.join(keys.withColumnRenamed("call_id", "on"), ["conv_id", "on"]).groupBy("conv_id", "call_id").agg(F.max(F.struct("order_key", "best")).alias("later"))
        moved = keys.join(later, ["conv_id", "call_id"], "left").withColumn("grows", F.coalesce(F.col("later.order_key") > F.col("order_key"), F.lit(False)))
        if moved.filter("grows").isEmpty():
            break
        chosen = F.when(F.col("grows"), F.col("later")).otherwise(F.struct("order_key", "best"))
        keys = materialise(moved.select("conv_id", "call_id", chosen.alias("k")).select("conv_id", "call_id", "k.order_key", "k.best"))
    steps = keys.select("conv_id", "call_id", "order_key")
    # Only edges between equal keys leave the order open; a dependency on itself is a circle.
    a, b = steps.alias("a"), steps.alias("b")
    tight = edges.join(a, ["conv_id", "call_id"]).select("conv_id", "call_id", "on", F.col("order_key").alias("key"))
    tight = materialise(tight.join(b.select("conv_id", F.col("call_id").alias("on"), F.col("order_key").alias("on_key")), ["conv_id", "on"]).filter("key = on_key").select("conv_id", "call_id", "on"))
    if tight.isEmpty():
        return steps.withColumn("order_step", F.lit(0)).withColumn("cyclic", F.lit(False))
    # No path has more edges than there are; a longer one goes through a circle.
    tight = materialise(tight.join(tight.groupBy("conv_id").agg((F.count("*") + 1).cast("int").alias("limit")), "conv_id"))
    depth = longest(tight)
    stuck = materialise(depth.filter("endless").select("conv_id", "call_id"))
    placed = depth.filter("not endless").select("conv_id", "call_id", F.col("steps").alias("order_step"), F.lit(False).alias("cyclic"))
    if not stuck.isEmpty():
        inside = tight.join(stuck, ["conv_id", "call_id"]).join(stuck.withColumnRenamed("call_id", "on"), ["conv_id", "on"])
        inside = materialise(inside.select("conv_id", "call_id", "on", "limit"))
        back = longest(inside.select("conv_id", F.col("on").alias("call_id"), F.col("call_id").alias("on"), "limit"))
        circles = materialise(back.filter("endless").select("conv_id", "call_id"))
        limits = tight.select("conv_id", "limit").distinct()
        behind = stuck.join(circles, ["conv_id", "call_id"], "left_anti").join(limits, "conv_id")
        beyond = inside.join(circles, ["conv_id", "call_id"], "left_anti").join(circles.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left_anti").select("conv_id", "call_id", "on", "limit")
        after = behind.join(longest(beyond), ["conv_id", "call_id"], "left")
        placed = placed.unionByName(circles.join(limits, "conv_id").select("conv_id", "call_id", F.col("limit").alias("order_step"), F.lit(True).alias("cyclic")))
        placed = placed.unionByName(after.select("conv_id", "call_id", (F.col("limit") + 1 + F.coalesce("steps", F.lit(0))).alias("order_step"), F.lit(False).alias("cyclic")))
    return steps.join(placed, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "order_key", F.coalesce("order_step", F.lit(0)).alias("order_step"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls (conv_id, position, call_id, name, arguments, depends_on) and results (conv_id, position, call_id, content) to
    rows conv_id, order_key, order_step, position, call_id, status, error, message (canonical JSON)."""
    calls = materialise(calls.filter("conv_id is not null and call_id is not null").select("conv_id", "position", "call_id", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")).distinct())
    content = F.struct("name", "arguments", F.array_sort("depends_on").alias("depends_on"))
    by_id = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("position", content.alias("c"))).alias("best"), F.count("*").alias("number"))
    first = materialise(by_id.select("conv_id", "call_id", F.col("best.position").alias("position"), F.col("best.c.name").alias("name"), F.col("best.c.arguments").alias("arguments"), F.col("best.c.depends_on").alias("depends_on"), "number"))
    results = results.filter("conv_id is not null and call_id is not null")
    here = results.join(first.select("conv_id", "call_id", F.col("position").alias("called")), ["conv_id", "call_id"], "left")
    answers = here.filter("position > called").groupBy("conv_id", "call_id").agg(F.min(F.struct("position", "content")).alias("answer"))
    order = topological(first)
    linked = first.join(order, ["conv_id", "call_id"]).join(answers, ["conv_id", "call_id"], "left")
    status = F.when(F.col("cyclic"), "cyclic").when(F.col("answer").isNull(), "pending").otherwise("linked")
    linked = linked.select("conv_id", "order_key", "order_step", "position", "call_id", status.alias("status"), "name", "arguments", "depends_on", F.col("answer.content").alias("content"))
    # Further calls with an identifier that is taken: all but one row of each.
    kept = first.filter("number > 1").select("conv_id", "call_id", F.struct("position", "name", "arguments", "depends_on").alias("kept"))
    again = calls.join(kept, ["conv_id", "call_id"]).filter(~F.struct("position", "name", "arguments", F.array_sort("depends_on").alias("depends_on")).eqNullSafe(F.col("kept")))
    again = again.select("conv_id", F.col("position").alias("order_key"), F.lit(0).alias("order_step"), "position", "call_id", F.lit("duplicate").alias("status"), "name", "arguments", "depends_on", F.lit(None).cast("string").alias("content"))
    without = here.filter("called is null or position <= called").select("conv_id", F.col("position").alias("order_key"), F.lit(0).alias("order_step"), "position", "call_id", F.when(F.col("called").isNull(), "orphan").otherwise("early").alias("status"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.array().cast("array<string>").alias("depends_on"), "content")
    rows = linked.unionByName(again).unionByName(without)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            errors, messages = [], []
            for r in f.itertuples():
                text, error = (None, None) if r.status in ("orphan", "early") else checked(r.name, r.arguments, schemas)
                errors.append(error)
                held = {"arguments": json.loads(text) if text is not None else r.arguments, "depends_on": list(r.depends_on), "id": r.call_id, "name": r.name, "result": r.content, "status": r.status}
                messages.append(canonical({k: v for k, v in held.items() if r.status not in ("orphan", "early") or k in ("id", "result", "status")}))
            out = f[["conv_id", "order_key", "order_step", "position", "call_id", "status"]].copy()
            out["error"], out["message"] = pd.Series(errors, index=f.index, dtype="object"), messages
            yield out

    kind = dict(rows.dtypes)["conv_id"]
    return rows.mapInPandas(write, f"conv_id {kind}, order_key long, order_step int, position long, call_id string, status string, error string, message string")
