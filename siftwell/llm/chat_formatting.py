"""Chat formatting: link tool calls to results, order them, validate arguments, write canonical JSON.

DataFrame functions only.  The steps:

* ``explicit_calls`` reads calls from assistant messages that are a JSON object with
  ``tool_calls`` (``id``, ``name``, ``arguments``, optional ``depends_on``) and results from
  messages of role ``tool`` (``tool_call_id``).  ``implied_calls`` reads plain chats: each
  user turn asks for a reply, and an assistant message in the next turn is its result.
* ``link`` hash-joins results and calls on (conv_id, call_id).  The first call of an id counts.
* ``ordered`` sorts topologically: a call comes after the results it depends on, a result
  after its call.  ``place`` is the least turn at which a message can stand so, ``depth``
  breaks ties; sorting by (conv_id, place, depth, turn, call_id) is a topological order that
  moves nothing that stood well.  Calls resolve in rounds, in each of which chains of
  dependencies halve; calls on a cycle never resolve and are marked.
* ``validated`` checks arguments against a registry of schemas (types, required, enum,
  minimum, maximum, unexpected names).  The registry is code, hence small.
* ``canonical`` writes one line of JSON a message: keys sorted at every level, no blanks.

Scale: every join is on a message key, never on a conversation alone, so a conversation
that holds a third of all messages spreads over all tasks; nothing is gathered per
conversation.

Defined cases: null text gives null arguments (invalid, "arguments are missing"); malformed
JSON is invalid; results without a call and calls without a result stay, linked false;
repeated calls of one id are marked duplicates and link like the first; repeated results
each link; null ids link with nothing; of calls of one id in one turn the first listed counts;
dependencies on unknown ids do not order; a very long text is one string, whole; an empty table gives an empty result; columns named like ours are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Shared, read

#: Schemas by tool: each parameter has a type, and may have required, enum, minimum and maximum.
REGISTRY: dict[str, dict[str, dict[str, Any]]] = {
    "reply": {"prompt": {"type": "string", "required": True}, "words": {"type": "integer", "required": True, "minimum": 3}},
}
#: JSON types as the prefix of the type that Spark reports for a variant.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT", "null": "VOID"}
OWN = ("kind", "call_id", "tool", "arguments", "depends_on", "linked", "duplicate", "place", "depth", "cyclic", "valid", "errors", "canonical_json")


def quoted(text: Column) -> Column:
    """The string as JSON, null as null."""
    made = F.to_json(F.struct(text.alias("v")))
    return F.coalesce(F.when(text.isNotNull(), F.substring(made, F.lit(6), F.length(made) - 6)), F.lit("null"))


def implied_calls(messages: DataFrame) -> DataFrame:
    """Plain chats: kind call (user turns), result (assistant turns that follow) or message. A call depends on the call two turns before, if there is one."""
    here, size = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.regexp_count("text", F.lit(WORD))
    before, earlier = (F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - k).cast("string")) for k in (1, 2))
    kind = F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("message")
    call = kind == "call"
    return messages.drop(*OWN).select(
        "*", kind.alias("kind"), F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.when(call, here).when(kind == "result", before)).alias("call_id"), F.when(call, F.lit("reply")).alias("tool"),
        F.when(call & F.col("text").isNotNull(), F.to_json(F.struct(size.alias("words"), F.col("text").alias("prompt")))).alias("arguments"), F.when(call, F.array(earlier)).otherwise(F.array().cast("array<string>")).alias("depends_on"), F.lit(0).alias("_pos"),
    )


def explicit_calls(messages: DataFrame) -> DataFrame:
    """Messages that carry calls become a row a call; tool messages become results; others stay."""
    body = F.when(F.col("role").isin("assistant", "tool") & F.col("text").rlike(r"^\s*\{"), F.try_parse_json("text"))
    rows = messages.drop(*OWN).withColumn("_body", body)
    calls = F.when(F.col("role") == "assistant", F.try_variant_get("_body", "$.tool_calls", "array<struct<id: string, name: string, arguments: variant, depends_on: array<string>>>"))
    rows = rows.select("*", F.posexplode_outer(calls).alias("_pos", "_call"))
    result = F.when(F.col("role") == "tool", F.try_variant_get("_body", "$.tool_call_id", "string"))
    kind = F.when(F.col("_call").isNotNull(), "call").when(F.col("role") == "tool", "result").otherwise("message")
    out = rows.withColumn("kind", kind).withColumn("call_id", F.coalesce(F.col("_call.id"), result)).withColumn("tool", F.col("_call.name"))
    # arguments may be an object or, as some chats have it, a string of JSON
    given = F.col("_call.arguments")
    out = out.withColumn("arguments", F.coalesce(F.when(F.schema_of_variant(given) == "STRING", F.try_variant_get(given, "$", "string")), F.to_json(given)))
    return out.withColumn("depends_on", F.coalesce(F.col("_call.depends_on"), F.array().cast("array<string>"))).drop("_body", "_call")


def link(rows: DataFrame, shared: Shared) -> DataFrame:
    """rows with linked, duplicate and _first (turn of the id's first call); joins are on (conv_id, call_id)."""
    keyed = rows.where("kind in ('call', 'result') and call_id is not null and conv_id is not null")
    ids = keyed.groupBy(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i")).agg(F.min(F.when(F.col("kind") == "call", F.struct("turn", F.coalesce("_pos", F.lit(0)).alias("_pos")))).alias("_earliest"), F.min(F.when(F.col("kind") == "result", F.col("turn"))).alias("_result"))
    ids = shared.save(ids, "ids")
    out = rows.join(ids.hint("shuffle_hash"), (F.col("conv_id") == F.col("_c")) & (F.col("call_id") == F.col("_i")), "left")
    both = F.col("_earliest").isNotNull() & F.col("_result").isNotNull()
    out = out.withColumn("linked", F.coalesce(both, F.lit(False))).withColumn("duplicate", F.coalesce((F.col("kind") == "call") & (F.struct("turn", F.coalesce("_pos", F.lit(0)).alias("_pos")) > F.col("_earliest")), F.lit(False)))
    return out.withColumn("_first", F.col("_earliest.turn")).drop("_c", "_i", "_pos", "_earliest")


def ordered(rows: DataFrame, shared: Shared) -> DataFrame:
    """Linked rows with place, depth and cyclic."""
    calls = rows.where("kind = 'call' and not duplicate and call_id is not null").groupBy("conv_id", "call_id").agg(F.first("_first").alias("turn"), F.first("_result").alias("result"), F.array_distinct(F.flatten(F.collect_set("depends_on"))).alias("deps"))
    own = calls.select("conv_id", F.explode("deps").alias("dep"), "call_id", "turn", "result")
    known = calls.select("conv_id", F.col("call_id").alias("dep"))
    waits = own.join(known, ["conv_id", "dep"], "left_semi").select("conv_id", "call_id", "dep", "turn", "result", F.lit(None).cast("long").alias("over"), F.lit(1).alias("steps"))
    edges = shared.save(waits, "order-0")
    end = F.greatest(F.col("turn"), F.col("result"))
    free = calls.join(edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
    done = shared.save(free.select("conv_id", "call_id", F.col("turn").alias("at"), end.alias("end"), F.lit(0).alias("level")), "done-0")
    turn = 0
    while edges.limit(1).count():
        turn += 1
        seen = edges.join(done.select("conv_id", F.col("call_id").alias("dep"), F.col("end").alias("before"), "level"), ["conv_id", "dep"], "left")
        ready = seen.groupBy("conv_id", "call_id").agg(F.first("turn").alias("turn"), F.first("result").alias("result"), F.max(F.greatest("before", "over")).alias("before"), F.max(F.col("level") + F.col("steps")).alias("level"), F.count_if(F.col("level").isNull()).alias("open")).where("open = 0")
        at = F.greatest("turn", "before")
        fresh = shared.save(ready.select("conv_id", "call_id", at.alias("at"), F.greatest(at, F.col("result")).alias("end"), "level"), f"fresh-{turn}")
        if not fresh.limit(1).count():
            break
        done = shared.save(done.unionAll(fresh), f"done-{turn}")
        left = edges.join(fresh.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
        # whoever waits for a call that waits for one other call waits for that one: chains halve
        single = left.groupBy("conv_id", F.col("call_id").alias("dep")).agg(F.count("*").alias("n"), F.first("dep").alias("to"), F.max(F.greatest("over", "turn", "result")).alias("past"), F.max("steps").alias("more")).where("n = 1").drop("n")
        hops = left.join(single, ["conv_id", "dep"], "left").select("conv_id", "call_id", F.coalesce("to", "dep").alias("dep"), "turn", "result", F.greatest("over", "past").alias("over"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        edges = shared.save(hops, f"order-{turn}")
        for name in (f"order-{turn - 1}", f"done-{turn - 1}"):
            shared.drop(name)
    stuck = edges.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i")).distinct().withColumn("_stuck", F.lit(True))
    out = rows.join(done.select(F.col("conv_id").alias("_dc"), F.col("call_id").alias("_di"), "at", "level"), (F.col("conv_id") == F.col("_dc")) & (F.col("call_id") == F.col("_di")), "left")
    out = out.join(stuck, (F.col("conv_id") == F.col("_c")) & (F.col("call_id") == F.col("_i")), "left")
    return out.withColumn("place", F.greatest("turn", "at")).withColumn("depth", F.coalesce(2 * F.col("level") + F.when(F.col("kind") == "result", 1).otherwise(0), F.lit(0))).withColumn("cyclic", F.coalesce("_stuck", F.lit(False))).drop("_first", "_result", "_dc", "_di", "_c", "_i", "_stuck", "at", "level")


def parameter_errors(body: Column, name: str, rule: Mapping[str, Any]) -> list[Column]:
    path = f"$['{name}']"
    value = F.try_variant_get(body, path, "variant")
    kind = F.schema_of_variant(value)
    there = value.isNotNull() & (kind != "VOID") if rule["type"] != "null" else value.isNotNull()
    errors = [F.when(there & ~kind.rlike(f"^{TYPES[rule['type']]}"), F.lit(f"{name} is no {rule['type']}"))]
    if rule.get("required"):
        errors.append(F.when(~F.coalesce(there, F.lit(False)), F.lit(f"{name} is missing")))
    if rule.get("enum"):
        errors.append(F.when(there & ~F.coalesce(F.try_variant_get(body, path, "string").isin(*map(str, rule["enum"])), F.lit(False)), F.lit(f"{name} is none of the allowed values")))
    number = F.try_variant_get(body, path, "double")
    if "minimum" in rule:
        errors.append(F.when(number < rule["minimum"], F.lit(f"{name} is below {rule['minimum']}")))
    if "maximum" in rule:
        errors.append(F.when(number > rule["maximum"], F.lit(f"{name} is above {rule['maximum']}")))
    return errors


def validated(rows: DataFrame, registry: Mapping[str, Mapping[str, Mapping[str, Any]]] = REGISTRY) -> DataFrame:
    """Rows with errors (an array, empty for messages and results), valid, and _canonical, the arguments with sorted keys."""
    rows = rows.withColumn("_body", F.try_parse_json("arguments"))
    body = F.col("_body")
    found = F.when(F.col("arguments").isNull(), F.array(F.lit("arguments are missing"))).when(body.isNull() | ~F.schema_of_variant(body).startswith("OBJECT"), F.array(F.lit("arguments are no JSON object")))
    for tool, schema in registry.items():
        parts = [e for name, rule in schema.items() for e in parameter_errors(body, name, rule)]
        names = F.array_sort(F.array_except(F.json_object_keys("arguments"), F.array(*[F.lit(x) for x in schema])))
        found = found.when(F.col("tool") == tool, F.concat(F.array_compact(F.array(*parts)), F.transform(names, lambda x: F.concat(x, F.lit(" is unexpected")))))
    found = found.otherwise(F.array(F.lit("the tool is unknown")))
    rows = rows.withColumn("errors", F.when(F.col("kind") == "call", found).otherwise(F.array().cast("array<string>")))
    # a variant keeps the fields of an object sorted by name, at every level
    return rows.withColumn("valid", F.size("errors") == 0).withColumn("_canonical", F.to_json("_body")).drop("_body")


def canonical(rows: DataFrame) -> DataFrame:
    """Rows with canonical_json; its keys are in order here too."""
    call = F.concat(F.lit('{"arguments":'), F.coalesce("_canonical", quoted(F.col("arguments"))), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("tool")), F.lit(',"role":'), quoted(F.col("role")), F.lit(',"type":"call"}'))
    result = F.concat(F.lit('{"content":'), quoted(F.col("text")), F.lit(',"id":'), quoted(F.when(F.col("linked"), F.col("call_id"))), F.lit(',"role":'), quoted(F.col("role")), F.lit(',"type":"result"}'))
    plain = F.concat(F.lit('{"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit(',"type":"message"}'))
    return rows.withColumn("canonical_json", F.when(F.col("kind") == "call", call).when(F.col("kind") == "result", result).otherwise(plain)).drop("_canonical")


def format_chats(rows: DataFrame, shared: Shared, registry: Mapping[str, Mapping[str, Mapping[str, Any]]] = REGISTRY) -> DataFrame:
    """All steps, for rows of explicit_calls or implied_calls."""
    return canonical(validated(ordered(link(rows, shared), shared), registry))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = format_chats(implied_calls(chats), Shared(spark))
    return out.select("conv_id", "turn", "role", "kind", "call_id", "linked", "duplicate", F.col("place").cast("long").alias("place"), F.col("depth").cast("long").alias("depth"), "valid", F.array_join("errors", ";").alias("errors"), F.sha2(F.col("canonical_json").cast("binary"), 256).alias("canonical_sha256"))


ORACLE = r"""
WITH rows AS (SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM conversations),
ids AS (SELECT *, CASE kind WHEN 'call' THEN concat(conv_id, ':', turn) WHEN 'result' THEN concat(conv_id, ':', turn - 1) END AS call_id FROM rows),
calls AS (SELECT conv_id, call_id, min(turn) AS first FROM ids WHERE kind = 'call' GROUP BY conv_id, call_id),
results AS (SELECT conv_id, call_id, min(turn) AS result FROM ids WHERE kind = 'result' GROUP BY conv_id, call_id),
chains AS (SELECT *, row_number() OVER (PARTITION BY conv_id, first % 2, chain ORDER BY first) - 1 AS level FROM (SELECT *, first - 2 * row_number() OVER (PARTITION BY conv_id, first % 2 ORDER BY first) AS chain FROM calls)),
joined AS (SELECT i.*, c.first, c.level, c.first IS NOT NULL AND r.result IS NOT NULL AS linked FROM ids i LEFT JOIN chains c ON i.conv_id = c.conv_id AND i.call_id = c.call_id LEFT JOIN results r ON i.conv_id = r.conv_id AND i.call_id = r.call_id)
SELECT conv_id, turn, role, kind, call_id, linked, coalesce(kind = 'call' AND turn > first, false) AS duplicate,
  CAST(CASE WHEN kind = 'result' AND first IS NOT NULL THEN greatest(turn, first) ELSE turn END AS BIGINT) AS place, CAST(CASE WHEN first IS NULL THEN 0 ELSE 2 * level + CASE WHEN kind = 'result' THEN 1 ELSE 0 END END AS BIGINT) AS depth,
  kind <> 'call' OR words >= 3 AS valid, CASE WHEN kind = 'call' AND words < 3 THEN 'words is below 3' ELSE '' END AS errors,
  sha256(CASE kind WHEN 'call' THEN concat('{"arguments":{"prompt":', CAST(to_json(text) AS VARCHAR), ',"words":', words, '},"id":', CAST(to_json(call_id) AS VARCHAR), ',"name":"reply","role":"user","type":"call"}')
    WHEN 'result' THEN concat('{"content":', CAST(to_json(text) AS VARCHAR), ',"id":', CASE WHEN linked THEN CAST(to_json(call_id) AS VARCHAR) ELSE 'null' END, ',"role":"assistant","type":"result"}')
    ELSE concat('{"content":', CAST(to_json(text) AS VARCHAR), ',"role":', CAST(to_json(role) AS VARCHAR), ',"type":"message"}') END) AS canonical_sha256
FROM joined
"""
