"""Tool calls linked to their results.

Calls and results meet in a hash join on (conversation, identifier). Calls are put in an order in which each stands after
the calls whose results it needs. Where all needs point to earlier turns, as in a sound log, the order of turns is such an
order; only conversations with another need are sorted by levels. One of at most ``SORTED_ROWS`` calls and needs is sorted
within a task, which holds one conversation at a time; a longer one in rounds over all tasks, a level a round. Calls on a
cycle, or after one, are reported as such. Arguments are checked against the schema of their tool, and call and result are
written as canonical JSON: keys sorted, no white space, characters as they are.

Nothing is grouped by conversation as a whole: positions come from counts per part of a conversation.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from excerpta.llm.common import settle

TURNS_A_PART = 64
SORTED_ROWS = 100_000
PLAIN = {"string": str, "boolean": bool, "array": list, "object": dict}


def spelled(text: str) -> str:
    """The text with lone surrogates, which UTF-8 has no bytes for, as their JSON escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return spelled(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def faults(value, schema: dict, path="") -> list[str]:
    """What contradicts a schema: type, properties, required, additionalProperties, items, enum, minimum, maximum,
    minLength and maxLength are known."""
    kind, name = schema.get("type"), path or "value"
    if kind in ("integer", "number"):
        whole = isinstance(value, int) or isinstance(value, float) and math.isfinite(value) and value == int(value)
        right = not isinstance(value, bool) and (whole if kind == "integer" else isinstance(value, (int, float)))
    elif kind == "null":
        right = value is None
    else:
        right = kind is None or isinstance(value, PLAIN[kind])
    if not right:
        return [f"{name} is no {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{name} is none of the allowed values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{name} is out of range")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        out.append(f"{name} has a wrong length")
    if isinstance(value, list) and "items" in schema:
        out += [f for n, v in enumerate(value) for f in faults(v, schema["items"], f"{path}[{n}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}".lstrip(".") + " is missing" for k in schema.get("required", ()) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{path}.{k}".lstrip(".") + " is unknown" for k in sorted(value.keys() - known.keys())]
        out += [f for k in sorted(value.keys() & known.keys()) for f in faults(value[k], known[k], f"{path}.{k}".lstrip("."))]
    return out


def checked(name, arguments, schemas: dict) -> tuple[object, list[str]]:
    """The arguments as a value (None if they are no JSON) and their faults."""
    try:
        value = json.loads(arguments or "", parse_constant=lambda c: float("nan"))
        canonical(value)
    except (ValueError, RecursionError):
        return None, ["arguments are no JSON"]
    if name not in schemas:
        return value, ["the tool is unknown"]
    return value, faults(value, schemas[name])


def sorted_levels(pairs: list[tuple]) -> dict:
    """Level by call of (call, need or None): 0 without needs, else one more than the highest of its needs; calls on a cycle
    or after one have none."""
    waits, after = {}, {}
    for call, need in pairs:
        waits.setdefault(call, 0)
        if need is not None:
            waits[call] += 1
            after.setdefault(need, []).append(call)
    level = {c: 0 for c, n in waits.items() if not n}
    ready = list(level)
    for call in ready:
        for later in after.get(call, ()):
            waits[later] -= 1
            if not waits[later]:
                level[later] = level[call] + 1
                ready.append(later)
    return level


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls of conversations in which a need does not point to an earlier turn; null
    for calls on a cycle or after one. Other conversations are not among the rows."""
    needs = calls.select("conv_id", "call_id", "turn", F.explode("needs").alias("need"))
    known = calls.select("conv_id", F.col("call_id").alias("need"), F.col("turn").alias("before"))
    edges = needs.join(known, ["conv_id", "need"])
    bent = edges.groupBy("conv_id").agg(
        F.bool_or(~F.coalesce(F.col("before") < F.col("turn"), F.lit(False))).alias("bent"), F.count("*").alias("needs")
    ).where("bent")
    sizes = calls.groupBy("conv_id").agg(F.count("*").alias("calls")).join(bent, "conv_id")
    sizes = settle(sizes.select("conv_id", (F.col("calls") + F.col("needs")).alias("size")), "calls-bent")
    edges = settle(edges.join(sizes, "conv_id").select("conv_id", "call_id", "need", "size"), "call-needs")
    nodes = calls.join(sizes, "conv_id").select("conv_id", "call_id", F.lit(None).cast("string").alias("need"), "size")
    kind = dict(calls.dtypes)["conv_id"]

    def sort(it):
        held, name = [], None
        for batch in it:
            for conv, *pair in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if conv != name and held:
                    yield placed_batch(name, held)
                    held = []
                name = conv
                held.append(pair)
        if held:
            yield placed_batch(name, held)

    def placed_batch(conv, pairs):
        found = sorted_levels(pairs)
        ids = list(dict.fromkeys(c for c, _ in pairs))
        columns = [pa.array([conv] * len(ids), conv_type), pa.array(ids), pa.array([found.get(c) for c in ids], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "call_id", "level"])

    conv_type = to_arrow_type(calls.schema["conv_id"].dataType)
    short = nodes.union(edges).where(F.col("size") <= SORTED_ROWS).select("conv_id", "call_id", "need")
    short = short.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(sort, f"conv_id {kind}, call_id string, level int")
    if sizes.where(F.col("size") > SORTED_ROWS).isEmpty():
        return short
    long = F.col("size") > SORTED_ROWS
    return short.union(_levels_in_rounds(nodes.where(long).select("conv_id", "call_id"), edges.where(long).drop("size")))


def _levels_in_rounds(open_calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels of whole conversations, the calls without an open need being placed in each round."""
    edges, open_calls = settle(edges, "call-needs"), settle(open_calls, "calls-open")
    placed, level = [], 0
    while True:
        waiting = edges.select("conv_id", "call_id").distinct()
        now = settle(open_calls.join(waiting, ["conv_id", "call_id"], "left_anti"), "calls-placed")
        placed.append(now.withColumn("level", F.lit(level)))
        if now.isEmpty():
            placed[-1] = open_calls.withColumn("level", F.lit(None).cast("int"))
            break
        open_calls = settle(open_calls.join(waiting, ["conv_id", "call_id"]), "calls-open")
        edges = settle(edges.join(now.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left_anti"), "call-needs")
        level += 1
    out = placed[0]
    for part in placed[1:]:
        out = out.union(part)
    return out


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row per identifier: conv_id, call_id, call_turn, result_turn, status, position, valid, faults, message.

    ``calls`` has conv_id, call_id, turn, name, arguments (JSON) and needs (identifiers of the same conversation);
    ``results`` has conv_id, call_id, turn, content. status is linked, unanswered (no result) or orphan (no call).
    position, from 0, is the call's place in its conversation; it is null for an orphan and for calls on or after a cycle,
    whose status is cyclic. A need that names no call is no need. Of rows that repeat an identifier the first counts (by
    turn, then content). Rows without conversation or identifier link nothing and are left out. message is canonical JSON;
    arguments that are no JSON appear in it as the string they are. Other columns are ignored.
    """
    keyed = "conv_id is not null and call_id is not null"
    rest = F.struct("turn", "name", "arguments", F.array_distinct(F.coalesce("needs", F.array().cast("array<string>"))).alias("needs"))
    calls = calls.where(keyed).groupBy("conv_id", "call_id").agg(F.min(rest).alias("c")).select("conv_id", "call_id", "c.*")
    calls = settle(calls, "calls")
    first = F.min(F.struct("turn", "content")).alias("r")
    results = results.where(keyed).groupBy("conv_id", "call_id").agg(first)

    own = ["conv_id", "call_id"]
    ordered = calls.join(levels(calls).withColumn("bent", F.lit(True)), own, "left")
    ordered = ordered.withColumn("cyclic", F.col("bent").isNotNull() & F.col("level").isNull())
    ordered = ordered.withColumn("level", F.coalesce("level", F.lit(0))).withColumn("part", F.expr(f"turn div {TURNS_A_PART}"))
    sizes = ordered.where("not cyclic").groupBy("conv_id", "level", "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("level", "part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("conv_id", "level", F.col("part").alias("_part"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("conv_id", "level", "part", "cyclic").orderBy("turn", "call_id")
    ranked = ordered.withColumn("rank", F.row_number().over(within) - 1)
    same = (ranked.conv_id == firsts.conv_id) & (ranked.level == firsts.level) & ranked.part.eqNullSafe(firsts._part)
    ranked = ranked.join(firsts.hint("shuffle_hash"), same, "left").select(
        ranked.conv_id, ranked.call_id, ranked.turn, ranked.name, ranked.arguments, "cyclic",
        F.when(~F.col("cyclic"), F.col("first") + F.col("rank")).alias("position"),
    )
    linked = ranked.join(results, own, "full").select(
        *own, F.col("turn").alias("call_turn"), F.col("r.turn").alias("result_turn"),
        F.when(F.col("cyclic").isNull(), "orphan").when(F.col("cyclic"), "cyclic").when(F.col("r").isNull(), "unanswered").otherwise("linked").alias("status"),
        "position", "name", "arguments", F.col("r.content").alias("content"),
    )

    def write(it):
        for batch in it:
            rows = batch.select(["call_id", "status", "name", "arguments", "content"]).to_pylist()
            valid, wrong, messages = [], [], []
            for row in rows:
                message = {"id": row["call_id"], "status": row["status"], "result": row["content"]}
                found = []
                if row["status"] != "orphan":
                    value, found = checked(row["name"], row["arguments"], schemas)
                    message |= {"name": row["name"], "arguments": row["arguments"] if value is None else value}
                valid.append(None if row["status"] == "orphan" else not found)
                wrong.append(spelled("; ".join(found)))
                messages.append(canonical(message))
            columns = [*batch.columns[:6], pa.array(valid, pa.bool_()), pa.array(wrong, pa.string()), pa.array(messages, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:6], "valid", "faults", "message"])

    kind = dict(linked.dtypes)["conv_id"]
    return linked.mapInArrow(
        write,
        f"conv_id {kind}, call_id string, call_turn long, result_turn long, status string, position long, valid boolean, faults string, message string",
    )
