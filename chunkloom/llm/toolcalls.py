"""Chat formatting by tool-call linking, in DataFrame operations only.

Results are hash-joined to calls by identifier, events are put in topological order, calls' arguments are validated against
JSON schemas, and every event is serialised as canonical JSON (keys sorted at every depth, no white space).

An event depends on one other at most: a linked result on its call, anything else on its parent. The order is the depth in
that forest, found by pointer doubling: each round joins events to the events they point to, and rounds grow with the
logarithm of the longest chain. Nothing is gathered by conversation, so one that holds a third of all events is spread like
any other; keys of all joins and aggregations are single events or calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table

#: The schema of the call that a user turn stands for: something to answer, of up to 300 characters.
RESPOND = {
    "respond": {
        "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 300}, "length": {"type": "integer", "minimum": 0}},
        "required": ["length", "text"],
        "additionalProperties": False,
    }
}
_KINDS = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID$"}


def _json(*fields: Column | str) -> Column:
    """A JSON object of the fields; null fields are written, whatever the session says."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def valid_arguments(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """Does the JSON text fit the schema of its function? Null arguments, texts that are no JSON object, and functions without a
    schema do not. Understands type, minLength, maxLength, minimum, maximum, enum, required and additionalProperties."""
    parsed = F.try_parse_json(arguments)
    checks = F.lit(False)
    for function, schema in schemas.items():
        ok = F.coalesce(F.schema_of_variant(parsed).rlike(_KINDS["object"]), F.lit(False))
        properties = schema.get("properties", {})
        for key, rule in properties.items():
            path = f"$['{key}']"
            value = F.try_variant_get(parsed, path, "variant")
            fits = F.schema_of_variant(value).rlike(_KINDS[rule["type"]]) if "type" in rule else F.lit(True)
            if "minLength" in rule or "maxLength" in rule:
                n = F.length(F.try_variant_get(parsed, path, "string"))
                fits = fits & n.between(rule.get("minLength", 0), rule.get("maxLength", (1 << 31) - 1))
            if "minimum" in rule or "maximum" in rule:
                number = F.try_variant_get(parsed, path, "double")
                fits = fits & (number >= rule.get("minimum", float("-inf"))) & (number <= rule.get("maximum", float("inf")))
            if "enum" in rule:
                fits = fits & F.try_variant_get(parsed, path, "string").isin([str(x) for x in rule["enum"]])
            there = value.isNotNull()
            ok = ok & (F.coalesce(fits, F.lit(False)) if key in schema.get("required", []) else F.coalesce(~there | fits, F.lit(False)))
        if schema.get("additionalProperties") is False:
            known = F.array(*(F.lit(k) for k in properties)) if properties else F.array().cast("array<string>")
            ok = ok & F.coalesce(F.size(F.array_except(F.json_object_keys(arguments), known)) == 0, F.lit(False))
        checks = F.when(name == function, ok).otherwise(checks)
    return checks


def levels(nodes: DataFrame) -> DataFrame:
    """(conv_id, event_id, level) from distinct (conv_id, event_id, up), ``up`` an event_id of the same conversation or null.

    The level is the number of events it depends on, directly or not. Unknown ``up``: as null. On or behind a cycle: null.
    """
    known = nodes.select(F.col("conv_id").alias("c"), F.col("event_id").alias("e"))
    state = nodes.join(known, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("e")), "left").select("conv_id", "event_id", F.col("e").alias("up"))
    state = cut(state.withColumn("level", F.col("up").isNotNull().cast("long")))
    total, open_ = state.count(), state.where("up is not null").count()
    for _ in range(max(1, total).bit_length() + 1):
        if not open_:
            break
        there = state.select(F.col("conv_id").alias("c"), F.col("event_id").alias("e"), F.col("up").alias("next"), F.col("level").alias("more"))
        moved = state.where("up is not null").join(there, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("e")))
        state = cut(state.where("up is null").unionByName(moved.select("conv_id", "event_id", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"))))
        open_ = state.where("up is not null").count()
    return state.select("conv_id", "event_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link(events: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per event: conv_id, event_id, kind, call_id, level, linked, valid, json.

    ``events``: conv_id long, event_id string, kind (call, result; anything else is a message), parent_id, call_id, name,
    arguments (JSON text), role, content. ``linked``: a call with a result, a result with a call, and null for messages.
    ``valid``: of calls only. Several calls of one id: results depend on the one with the smallest event_id; all count as
    linked. Repeated rows are returned each. Null call ids link with nothing, null conversations or event ids depend on
    nothing (level 0). By level and then event_id, the events of a conversation are in topological order. Null fields are written
    as null. Arguments that are no JSON are serialised as a string. An empty table gives an empty table.
    """
    e = events.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        *(F.col(c).cast("string").alias(c) for c in ("event_id", "kind", "parent_id", "call_id", "name", "arguments", "role", "content")),
    )
    with_id = e.where("conv_id is not null and call_id is not null")
    calls = with_id.where("kind = 'call'").groupBy("conv_id", "call_id").agg(F.min("event_id").alias("_call_event"))
    results = with_id.where("kind = 'result'").groupBy("conv_id", "call_id").agg(F.lit(True).alias("_answered"))
    e = e.join(calls.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(results.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    is_call, is_result = F.coalesce(F.col("kind") == "call", F.lit(False)), F.coalesce(F.col("kind") == "result", F.lit(False))
    linked = F.when(is_call, F.coalesce("_answered", F.lit(False))).when(is_result, F.col("_call_event").isNotNull())
    up = F.when(is_result & F.col("_call_event").isNotNull(), F.col("_call_event")).otherwise(F.col("parent_id"))
    e = e.withColumns({"_linked": linked, "_up": F.when(up != F.col("event_id"), up)})
    # Of repeated events the smallest thing depended on counts.
    nodes = e.where("conv_id is not null and event_id is not null").groupBy("conv_id", "event_id").agg(F.min("_up").alias("up"))
    depth = levels(nodes)
    e = e.join(depth, ["conv_id", "event_id"], "left")
    level = F.when(F.col("conv_id").isNull() | F.col("event_id").isNull(), F.lit(0)).otherwise(F.col("level"))
    parsed = F.try_parse_json("arguments")
    as_call = _json(parsed.alias("arguments"), "call_id", "name", F.lit("call").alias("type"))
    as_raw_call = _json("arguments", "call_id", "name", F.lit("call").alias("type"))
    as_result = _json("call_id", "content", F.lit("result").alias("type"))
    as_message = _json("content", "role", F.lit("message").alias("type"))
    return e.select(
        "conv_id",
        "event_id",
        "kind",
        "call_id",
        level.cast("long").alias("level"),
        F.col("_linked").alias("linked"),
        F.when(is_call, valid_arguments(F.col("name"), F.col("arguments"), schemas)).alias("valid"),
        F.when(is_call, F.when(parsed.isNull(), as_raw_call).otherwise(as_call)).when(is_result, as_result).otherwise(as_message).alias("json"),
    )


def events_of(conversations: DataFrame) -> DataFrame:
    """Turns as events: a user turn calls ``respond``, the assistant turn after it is the call's result, other roles are
    messages; every turn follows the one before it."""
    turn, conv = F.col("turn").cast("long"), F.col("conv_id").cast("long")
    ident = lambda t: F.concat(conv.cast("string"), F.lit(":"), t.cast("string"))
    kind = F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("message")
    return conversations.select(
        conv.alias("conv_id"),
        ident(turn).alias("event_id"),
        kind.alias("kind"),
        ident(turn - 1).alias("parent_id"),
        F.when(kind == "call", ident(turn)).when(kind == "result", ident(turn - 1)).alias("call_id"),
        F.when(kind == "call", "respond").alias("name"),
        F.when(kind == "call", _json(F.col("text").alias("text"), F.length("text").alias("length"))).alias("arguments"),
        F.col("role").alias("role"),
        F.col("text").alias("content"),
    )


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(events_of(read_table(spark, sf_dir, "conversations")), RESPOND)


#: The forest of turns is made of runs of consecutive turns, so that the level is a turn's place in its run.
OP10_SQL = """
WITH t AS (SELECT conv_id, turn, role, text, conv_id || ':' || turn AS event_id, conv_id || ':' || (turn - 1) AS before_id FROM conversations),
runs AS (SELECT conv_id, turn, turn - min(turn) OVER (PARTITION BY conv_id, run) AS level
         FROM (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT DISTINCT conv_id, turn FROM conversations)))
SELECT t.conv_id, t.event_id,
       CASE t.role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
       CASE t.role WHEN 'user' THEN t.event_id WHEN 'assistant' THEN t.before_id END AS call_id,
       r.level::bigint AS level,
       CASE t.role WHEN 'user' THEN EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = t.conv_id AND a.turn = t.turn + 1 AND a.role = 'assistant')
                   WHEN 'assistant' THEN EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = t.conv_id AND a.turn = t.turn - 1 AND a.role = 'user') END AS linked,
       CASE t.role WHEN 'user' THEN coalesce(length(t.text) BETWEEN 1 AND 300, false) END AS valid,
       CASE t.role WHEN 'user' THEN json_object('arguments', json_object('length', length(t.text), 'text', t.text), 'call_id', t.event_id, 'name', 'respond', 'type', 'call')
                   WHEN 'assistant' THEN json_object('call_id', t.before_id, 'content', t.text, 'type', 'result')
                   ELSE json_object('content', t.text, 'role', t.role, 'type', 'message') END::varchar AS json
FROM t JOIN runs r ON r.conv_id = t.conv_id AND r.turn = t.turn
"""
