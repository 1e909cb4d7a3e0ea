"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Calls and results are hash-joined on (conversation, call id). Calls are put in topological
order of what they depend on: each conversation by one task, or, if it has very many calls,
by rounds of joins. Arguments are validated against the schema of the named tool, and each
linked call becomes canonical JSON: keys in order, no blanks, text as it is.

Statuses: ok; invalid (the errors are listed); no_result; orphan (a result without a call);
unlinked (a turn that is neither). Every input row is in one row of the output: n_copies counts
calls, or unlinked turns, and n_results results.
Defined results: of calls, or results, alike in conversation and id the least (turn, name,
arguments) counts; calls on a cycle, or that depend on one, and calls without an id or a
conversation have a null level; a dependency that is no call is ignored; arguments that are
null or no JSON object are invalid and appear as null; a null content is a null result; null
ids never link.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import discard, ship, written

#: Tool of the query over plain conversations: a user's turn asks, the assistant's next turn is the result.
REPLY_SCHEMA = {"reply": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 300}, "turn": {"type": "integer", "minimum": 0}}}}
#: Calls and dependencies of a conversation that one task puts in order.
GROUP_CALLS = 100_000
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def validate(value, schema: dict, at: str = "$") -> list[str]:
    """Errors of value under a JSON schema of type, required, properties, additionalProperties, items, enum, and bounds."""
    kind = schema.get("type")
    if kind and (not isinstance(value, _TYPES[kind]) or (isinstance(value, bool) and kind in ("integer", "number"))):
        return [f"{at}: not {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        known = schema.get("properties", {})
        for k in sorted(value):
            if k in known:
                out += validate(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += validate(x, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: too small"] * (value < schema.get("minimum", value)) + [f"{at}: too large"] * (value > schema.get("maximum", value))
    return out


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def depths(depends: dict[str, set[str]]) -> dict[str, int | None]:
    """Level of each call of one conversation: 0 without dependencies, else 1 more than the deepest of them; None on and behind cycles."""
    waiting, users, level = {}, {}, dict.fromkeys(depends)
    for call, on in depends.items():
        known = [x for x in on if x in depends]
        waiting[call] = len(known)
        for x in known:
            users.setdefault(x, []).append(call)
    ready, at = [c for c, n in waiting.items() if not n], 0
    while ready:
        following = []
        for c in ready:
            level[c] = at
            for u in users.get(c, ()):
                waiting[u] -= 1
                if not waiting[u]:
                    following.append(u)
        ready, at = following, at + 1
    return level


def _levels_in_groups(calls: DataFrame) -> DataFrame:
    """Levels of conversations that fit a task each."""

    def run(table: pa.Table) -> pa.Table:
        depends: dict[str, set[str]] = {}
        for call, on in zip(table.column("call_id").to_pylist(), table.column("depends_on").to_pylist()):
            depends.setdefault(call, set()).update(on or ())
        level = depths(depends)
        conv = table.column("conv_id").slice(0, 1).combine_chunks()
        return pa.table({"conv_id": conv.take(pa.array([0] * len(level))), "call_id": pa.array(list(level), pa.string()), "level": pa.array(list(level.values()), pa.int32())})

    return calls.groupBy("conv_id").applyInArrow(run, calls.select("conv_id", "call_id").schema.add("level", "integer"))


def _levels_in_rounds(calls: DataFrame) -> DataFrame:
    """Levels of conversations of any size, by rounds of joins over a table that each round replaces.

    A call has a least level and edges (call, weight) still open. Each round, an edge to a settled
    call becomes part of the least level; one to a call with a single open edge is replaced by
    that edge, weights added, so a chain is settled in as many rounds as its length has bits.
    """
    nodes = calls.select("conv_id", "call_id").distinct()
    edges = calls.select("conv_id", "call_id", F.explode("depends_on").alias("on")).distinct()
    edges = edges.join(nodes.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left_semi").withColumn("w", F.lit(1).cast("long"))
    mine = ["conv_id", "call_id"]
    state = nodes.withColumn("least", F.lit(0).cast("long")).join(edges.groupBy(*mine).agg(F.collect_list(F.struct("on", "w")).alias("open")), mine, "left")
    state = written(state.withColumn("open", F.coalesce("open", F.array().cast("array<struct<on:string,w:bigint>>"))))
    settled = -1
    while True:
        now = state.agg(F.count_if(F.size("open") == 0).alias("n"), F.count("*").alias("all")).first()
        if now.n in (settled, now["all"]):
            level = F.when(F.size("open") == 0, F.col("least").cast("int"))
            out = written(state.select(*mine, level.alias("level")))
            discard(state)
            return out
        settled = now.n
        edge = state.select(*mine, F.explode("open").alias("e")).select(*mine, F.col("e.on").alias("on"), F.col("e.w").alias("w"))
        other = state.select("conv_id", F.col("call_id").alias("on"), F.col("least").alias("its"), F.when(F.size("open") == 1, F.col("open")[0]).alias("next"), (F.size("open") == 0).alias("done"))
        met = edge.join(other, ["conv_id", "on"])
        far = F.least(F.col("w") + F.col("next.w"), F.lit(1 << 40))  # only on cycles so large
        kept = F.when(~F.col("done"), F.when(F.col("next").isNotNull(), F.struct(F.col("next.on").alias("on"), far.alias("w"))).otherwise(F.struct("on", "w")))
        met = met.select(*mine, (F.col("its") + F.col("w")).alias("reached"), kept.alias("e"))
        one = met.groupBy(*mine, F.col("e.on").alias("on")).agg(F.max("reached").alias("reached"), F.max("e.w").alias("w"))
        new = one.groupBy(*mine).agg(F.max("reached").alias("reached"), F.collect_list(F.when(F.col("on").isNotNull(), F.struct("on", "w"))).alias("still"))
        after = state.join(new, mine, "left").select(*mine, F.least(F.greatest("least", F.coalesce("reached", F.lit(0))), F.lit(1 << 40)).alias("least"), F.coalesce("still", "open").alias("open"))
        after = written(after)
        discard(state)
        state = after


def levels(calls: DataFrame, limit: int = GROUP_CALLS) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, depends_on array) with both ids.

    limit: calls and dependencies that a conversation may have to be put in order by one task; those with more go in rounds.
    """
    own = calls.where("conv_id is not null and call_id is not null").select("conv_id", "call_id", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    large = own.groupBy("conv_id").agg(F.sum(F.size("depends_on") + 1).alias("w")).where(F.col("w") > limit).select("conv_id")
    if large.isEmpty():
        return _levels_in_groups(own)
    large = written(large)
    return _levels_in_groups(own.join(large, "conv_id", "left_anti")).unionByName(_levels_in_rounds(own.join(large, "conv_id", "left_semi")))


def link(calls: DataFrame, results: DataFrame, schemas: dict, others: DataFrame | None = None, limit: int = GROUP_CALLS) -> DataFrame:
    """conv_id, call_id, turn, level, n_copies, n_results, status, errors, json for each call, each result without one, and each other turn.

    calls: conv_id, call_id, turn, name, arguments (JSON), depends_on (array of call ids).
    results: conv_id, call_id, turn, content. others: conv_id, turn, role, text.
    """
    ship(calls.sparkSession)
    call = F.min(F.struct("turn", "name", "arguments")).alias("c")
    one = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(call, F.count("*").alias("n_copies"))
    one = one.unionByName(calls.where("call_id is null").select("conv_id", "call_id", F.struct("turn", "name", "arguments").alias("c"), F.lit(1).cast("long").alias("n_copies")))
    got = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    both = one.join(levels(calls, limit), ["conv_id", "call_id"], "left").join(got, ["conv_id", "call_id"], "full")
    flat = both.select(
        "conv_id", "call_id", F.coalesce("c.turn", "r.turn").alias("turn"), "level", F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("r.content").alias("content"),
        F.col("c").isNotNull().alias("called"), F.col("r").isNotNull().alias("answered"),
    )
    if others is not None:
        none, one, zero = (F.lit(x) for x in (None, 1, 0))
        flat = flat.unionByName(others.select(
            "conv_id", none.cast("string").alias("call_id"), "turn", none.cast("int").alias("level"), one.cast("long").alias("n_copies"), zero.cast("long").alias("n_results"),
            F.col("role").alias("name"), none.cast("string").alias("arguments"), F.col("text").alias("content"), F.lit(False).alias("called"), F.lit(False).alias("answered"),
        ))
    kept = ["conv_id", "call_id", "turn", "level", "n_copies", "n_results"]
    schema = flat.select(*kept).schema

    def run(batches):
        for batch in batches:
            status, errors, out = [], [], []
            for x in batch.select(["call_id", "turn", "name", "arguments", "content", "called", "answered"]).to_pylist():
                if not x["called"] and not x["answered"]:
                    status.append("unlinked")
                    errors.append("")
                    out.append(canonical({"content": x["content"], "role": x["name"], "turn": x["turn"]}))
                    continue
                try:
                    arguments = json.loads(x["arguments"]) if x["arguments"] is not None else None
                except ValueError:
                    arguments = None
                found = []
                if x["called"]:
                    found = validate(arguments, {"type": "object", **schemas[x["name"]]}) if x["name"] in schemas else ["$: unknown tool"]
                status.append("orphan" if not x["called"] else "invalid" if found else "ok" if x["answered"] else "no_result")
                errors.append(";".join(found))
                out.append(canonical({"arguments": arguments, "id": x["call_id"], "name": x["name"], "result": x["content"]}))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(v, pa.string()) for v in (status, errors, out)], names=[*kept, "status", "errors", "json"])

    return flat.mapInArrow(run, schema.add("status", "string").add("errors", "string").add("json", "string"))


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and other turns of plain conversations: a user's turn t calls reply, and depends on the call at turn t - 2;
    the assistant's turn t + 1 is the result; turns of other roles, or without a conversation or a number, are neither."""
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    asks, answers = placed & F.col("role").eqNullSafe("user"), placed & F.col("role").eqNullSafe("assistant")
    name = lambda turn: F.concat_ws(":", F.lit("call"), "conv_id", turn)
    calls = conversations.where(asks).select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"),
        F.to_json(F.struct("text", "turn")).alias("arguments"), F.array(name(F.col("turn") - 2)).alias("depends_on"),
    )
    results = conversations.where(answers).select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results, conversations.where(~asks & ~answers).select("conv_id", "turn", "role", "text")


REPLY_SQL = """
WITH calls AS (SELECT conv_id, 'call:' || conv_id || ':' || turn AS call_id, turn, min(text) AS text, count(*) AS n_copies FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
results AS (SELECT conv_id, 'call:' || conv_id || ':' || (turn - 1) AS call_id, turn, CASE WHEN count(*) = count(text) THEN min(text) END AS content, count(*) AS n_results FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
runs AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> turn - 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run
         FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS before FROM calls)),
levelled AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS level FROM runs)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS turn, c.level::INTEGER AS level, coalesce(c.n_copies, 0)::BIGINT AS n_copies, coalesce(r.n_results, 0)::BIGINT AS n_results,
       CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN length(c.text) < 1 OR length(c.text) > 300 OR c.text IS NULL THEN 'invalid' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'ok' END AS status,
       CASE WHEN c.call_id IS NULL THEN '' WHEN c.text IS NULL THEN '$.text: missing' WHEN length(c.text) < 1 THEN '$.text: too short' WHEN length(c.text) > 300 THEN '$.text: too long' ELSE '' END AS errors,
       json_object('arguments', CASE WHEN c.call_id IS NULL THEN NULL WHEN c.text IS NULL THEN json_object('turn', c.turn) ELSE json_object('text', c.text, 'turn', c.turn) END, 'id', coalesce(c.call_id, r.call_id),
                   'name', CASE WHEN c.call_id IS NULL THEN NULL ELSE 'reply' END, 'result', r.content)::VARCHAR AS json
FROM levelled c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
UNION ALL
SELECT conv_id, NULL, turn, NULL, 1, 0, 'unlinked', '', json_object('content', text, 'role', role, 'turn', turn)::VARCHAR
FROM conversations WHERE conv_id IS NULL OR turn IS NULL OR role IS NULL OR role NOT IN ('user', 'assistant')
"""
