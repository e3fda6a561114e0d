"""Chat formatting: tool calls linked with their results, ordered, validated and written as canonical JSON.

DataFrame and SQL functions only.  Calls and results are each reduced to one row an identifier
(conv_id, call_id), which is aggregated before the shuffle, and then hash-joined on it, so a frequent
identifier is one row on either side.  The order is topological: a call's level is the longest chain of
calls that it comes after.  Chains of calls with one predecessor are followed by pointer doubling, so a chain of n calls takes
log2(n) rounds, and calls that have arrived at the chain's begin take no part in later ones; calls with several predecessors take a round
for each level of such calls, in which only calls that have become known, and edges from them, are handled.  Within a conversation
(level, seq, call_id) is a topological order.  Arguments are parsed as variants and compared with the
schema of their tool within the row.  Very long arguments and contents are used whole, within their row.

The table `conversations` of the test data has no calls of its own; `turns` takes its turns as calls and results.

Canonical JSON has its keys in order at every depth and no white space; absent values are left out.

Defined results.  status is linked, no_result, orphan_result (a result without a call), cycle (the call is
on a cycle or comes after one; level is null) or no_id (conv_id or call_id is null; such rows are kept
one by one and linked with nothing).  Of calls, or results, that repeat an identifier the first by
seq and then by content counts; the others are counted in `repeats`.  Errors name arguments that are no
JSON object (null or empty ones as well), missing, unknown and wrongly typed fields, tools without a schema and predecessors that do not exist.
Empty tables give an empty one.  Other columns of the inputs, of any names, are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import cut, read

_KEY = ["conv_id", "call_id"]


def _type_of(value: Column) -> Column:
    """JSON type of a variant: integer is a number without a fraction."""
    said = F.schema_of_variant(value)
    whole = (said == "BIGINT") | (said.startswith("DECIMAL") & F.to_json(value).rlike("^-?[0-9]+$"))
    return (
        F.when(said == "STRING", "string").when(whole, "integer").when(said.startswith("DECIMAL") | (said == "DOUBLE"), "number")
        .when(said == "BOOLEAN", "boolean").when(said.startswith("OBJECT"), "object").when(said.startswith("ARRAY"), "array").otherwise("null")
    )


def _argument_errors(parsed: Column, fields: Column, schema: Column) -> Column:
    """fields: map of name to variant; schema: map of name to struct(type, required)."""
    said = lambda text, entries: F.transform(F.array_sort(F.transform(entries, lambda e: e["key"])), lambda k: F.concat(F.lit(text), k))
    missing = F.filter(F.map_entries(schema), lambda e: e["value"]["required"] & ~F.map_contains_key(fields, e["key"]))
    unknown = F.filter(F.map_entries(fields), lambda e: ~F.map_contains_key(schema, e["key"]))

    def wrong(e: Column) -> Column:
        have, want = _type_of(e["value"]), F.try_element_at(schema, e["key"])["type"]
        return F.map_contains_key(schema, e["key"]) & (have != want) & ~((have == "integer") & (want == "number"))

    found = F.concat(said("missing ", missing), said("unknown ", unknown), said("wrong type ", F.filter(F.map_entries(fields), wrong)))
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    return (
        F.when(parsed.isNull() | ~is_object, F.array(F.lit("arguments are no JSON object")))
        .when(schema.isNull(), F.array(F.lit("no schema")))
        .otherwise(found)
    )


def _jump(nodes: DataFrame) -> DataFrame:
    """nodes: conv_id, call_id, up (the only predecessor, else null), many (whether there are several).  conv_id, call_id,
    anchor, steps, many: the first ancestor without exactly one predecessor, how far it is, and whether it has several;
    without the nodes that meet a cycle instead.  Nodes that have arrived take no part in later rounds."""
    now = cut(nodes.select(*_KEY, F.coalesce("up", "call_id").alias("anchor"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("steps"), F.col("up").isNull().alias("end"), "many"))
    arrived, reach, count = [now.where("end")], 1, now.count()
    every = now
    now = now.where("not end")
    while reach <= count and not now.isEmpty():
        ahead = every.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("steps").alias("more"), F.col("end").alias("there"), F.col("many").alias("several"))
        now = cut(now.join(ahead, ["conv_id", "anchor"]).select(*_KEY, F.col("next").alias("anchor"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("end"), F.col("several").alias("many")))
        arrived.append(now.where("end"))
        every = reduce(DataFrame.union, arrived).union(now.where("not end"))
        now = now.where("not end")
        reach *= 2
    return reduce(DataFrame.union, arrived).select(*_KEY, "anchor", "steps", "many")


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes: conv_id, call_id (unique).  edges: conv_id, call_id, dep (distinct, both ends among nodes).
    conv_id, call_id, level: null for what is on a cycle or after one."""
    only = edges.groupBy(*_KEY).agg(F.count("*").alias("n"), F.min("dep").alias("dep"))
    nodes = cut(nodes.join(only, _KEY, "left").select(*_KEY, F.when(F.col("n") == 1, F.col("dep")).alias("up"), (F.coalesce("n", F.lit(0)) > 1).alias("many"), F.coalesce("n", F.lit(0)).alias("n")))
    jumps = cut(_jump(nodes.drop("n")))
    # A call with several predecessors waits until all their chains begin at a call of known level; where one begins at a call
    # without predecessors, the chain's length is that level.  Each call becomes known once, so each edge is met once.
    chain = jumps.select("conv_id", F.col("call_id").alias("dep"), "anchor", "steps", F.col("many").alias("later"))
    several = nodes.where("many").select(*_KEY, "n")
    waiting = cut(edges.join(several, _KEY).join(chain, ["conv_id", "dep"]).select(*_KEY, "n", "anchor", (F.col("steps") + 1).alias("far"), "later"))
    reached = lambda met, level: met.groupBy(*_KEY, "n").agg(F.count("*").alias("met"), F.max(level).alias("level"))
    pending = cut(reached(waiting.where("not later"), F.col("far")))
    known: list[DataFrame] = []
    while True:
        fresh = cut(pending.where("met = n").select(*_KEY, "level"))
        if fresh.isEmpty():
            break
        known.append(fresh)
        at = fresh.select("conv_id", F.col("call_id").alias("anchor"), F.col("level").alias("start"))
        more = reached(waiting.where("later").join(at, ["conv_id", "anchor"]), F.col("start") + F.col("far"))
        pending = cut(pending.where("met < n").union(more).groupBy(*_KEY, "n").agg(F.sum("met").alias("met"), F.max("level").alias("level")))
    found = jumps.where("not many").select(*_KEY, F.col("steps").alias("level"))
    if known:
        at = reduce(DataFrame.union, known).select("conv_id", F.col("call_id").alias("anchor"), F.col("level").alias("start"))
        found = found.union(jumps.where("many").join(at, ["conv_id", "anchor"]).select(*_KEY, F.col("start") + F.col("steps")))
    return nodes.select(*_KEY).join(found, _KEY, "left").select(*_KEY, F.col("level").cast("int").alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls: conv_id, call_id, seq, name, arguments (JSON), after (array of call ids of the conversation).
    results: conv_id, call_id, seq, content.  schemas: name, field, type, required.
    One row a call or orphan result: conv_id, call_id, name, seq, level, status, errors, repeats, json."""
    no_id = lambda df: df.where("conv_id is null or call_id is null")
    has_id = lambda df: df.where("conv_id is not null and call_id is not null")
    first = lambda df, *cols: has_id(df).groupBy(*_KEY).agg(F.min(F.struct(*cols)).alias("x"), F.count("*").alias("n")).select(*_KEY, *(F.col("x")[c].alias(c) for c in cols), (F.col("n") - 1).alias("extra"))
    one_call = cut(first(calls, "seq", "name", "arguments", "after"))
    one_result = first(results, "seq", "content").select(*_KEY, F.col("seq").alias("result_seq"), "content", F.col("extra").alias("result_extra"), F.lit(True).alias("has_result"))
    nodes = one_call.select(*_KEY)
    asked = one_call.select(*_KEY, F.explode(F.array_distinct(F.filter("after", lambda a: a.isNotNull()))).alias("dep"))
    there = nodes.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("there"))
    edges = cut(asked.join(there, ["conv_id", "dep"], "left"))
    level = levels(edges.where("there").select(*_KEY, "dep"), nodes)
    lost = edges.where("there is null").groupBy(*_KEY).agg(F.array_sort(F.collect_set(F.concat(F.lit("no call "), "dep"))).alias("lost"))
    entry = F.struct("field", F.struct(F.col("type"), F.coalesce("required", F.lit(False)).alias("required")))
    one_schema = schemas.where("name is not null and field is not null").groupBy("name", "field").agg(F.min("type").alias("type"), F.max("required").alias("required"))
    one_schema = one_schema.groupBy("name").agg(F.map_from_entries(F.collect_list(entry)).alias("schema"))
    rows = one_call.join(one_schema, "name", "left").join(level, _KEY, "left").join(lost, _KEY, "left").join(one_result, _KEY, "full")
    parsed = F.try_parse_json("arguments")
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    rows = rows.withColumn("parsed", parsed).withColumn("fields", F.when(is_object, F.from_json("arguments", "map<string,variant>")))
    none = F.array().cast("array<string>")
    errors = F.concat(_argument_errors(F.col("parsed"), F.col("fields"), F.col("schema")), F.coalesce("lost", none))
    is_call = F.col("extra").isNotNull()
    status = F.when(~is_call, "orphan_result").when(F.col("level").isNull(), "cycle").when(F.col("has_result"), "linked").otherwise("no_result")
    found = rows.select(
        *_KEY, "name", F.coalesce("seq", "result_seq").alias("seq"), "level", status.alias("status"),
        F.when(is_call, errors).otherwise(none).alias("errors"), (F.coalesce("extra", F.lit(0)) + F.coalesce("result_extra", F.lit(0))).alias("repeats"), "parsed", "arguments", "content",
    )
    bare = no_id(calls).select(*_KEY, "name", "seq", F.lit(None).cast("int").alias("level"), F.lit("no_id").alias("status"), none.alias("errors"), F.lit(0).cast("long").alias("repeats"), parsed.alias("parsed"), "arguments", F.lit(None).cast("string").alias("content"))
    bare_results = no_id(results).select(*_KEY, F.lit(None).cast("string").alias("name"), "seq", F.lit(None).cast("int").alias("level"), F.lit("no_id").alias("status"), none.alias("errors"), F.lit(0).cast("long").alias("repeats"), F.try_parse_json(F.lit(None).cast("string")).alias("parsed"), F.lit(None).cast("string").alias("arguments"), "content")
    found = found.unionByName(bare).unionByName(bare_results)
    text = F.to_json(F.struct(
        F.col("parsed").alias("arguments"), "content", F.when(F.size("errors") > 0, F.col("errors")).alias("errors"), F.col("call_id").alias("id"), "level", "name",
        F.when(F.col("parsed").isNull(), F.col("arguments")).alias("raw_arguments"), "status",
    ))
    return found.select(*_KEY, "name", "seq", "level", "status", "errors", "repeats", text.alias("json"))


def turns(chat: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A chat as calls, results and schemas: each user turn calls `reply` after the user turn before
    the reply to that, and the assistant turn that follows at once is its result."""
    name = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    turn = F.col("turn")
    calls = chat.where("role = 'user'").select(
        "conv_id", name(turn).alias("call_id"), turn.alias("seq"), F.lit("reply").alias("name"),
        F.to_json(F.struct(turn.alias("turn"), "text")).alias("arguments"), F.when(turn >= 2, F.array(name(turn - 2))).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    results = chat.where("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), turn.alias("seq"), F.col("text").alias("content"))
    schemas = chat.sparkSession.sql("SELECT * FROM VALUES ('reply', 'text', 'string', true), ('reply', 'turn', 'integer', true) AS t(name, field, type, required)")
    return calls, results, schemas


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = link(*turns(read(spark, sf_dir, "conversations")))
    return rows.withColumn("errors", F.array_join("errors", "; "))


SQL = """
WITH RECURSIVE call_ AS (SELECT conv_id, turn AS seq, 'c' || turn AS call_id, min(text) AS text, count(*) - 1 AS extra FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
result_ AS (SELECT conv_id, turn AS seq, 'c' || (turn - 1) AS call_id, min(text) AS content, count(*) - 1 AS extra FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
level_ AS (
  SELECT c.conv_id, c.seq, 0 AS level FROM call_ c WHERE NOT EXISTS (SELECT 1 FROM call_ p WHERE p.conv_id = c.conv_id AND p.seq = c.seq - 2 AND c.seq >= 2)
  UNION ALL SELECT c.conv_id, c.seq, l.level + 1 FROM level_ l JOIN call_ c ON c.conv_id = l.conv_id AND c.seq = l.seq + 2 AND c.seq >= 2),
all_ AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, CASE WHEN c.seq IS NOT NULL THEN 'reply' END AS name,
         coalesce(c.seq, r.seq) AS seq, CAST(l.level AS INTEGER) AS level,
         CASE WHEN c.seq IS NULL THEN 'orphan_result' WHEN r.seq IS NULL THEN 'no_result' ELSE 'linked' END AS status,
         concat_ws('; ', CASE WHEN c.seq IS NOT NULL AND c.text IS NULL THEN 'missing text' END, CASE WHEN c.seq >= 2 AND l.level = 0 THEN 'no call c' || (c.seq - 2) END) AS errors,
         coalesce(c.extra, 0) + coalesce(r.extra, 0) AS repeats, c.seq AS call_seq, c.text, r.content
  FROM call_ c LEFT JOIN level_ l ON l.conv_id = c.conv_id AND l.seq = c.seq FULL JOIN result_ r ON r.conv_id = c.conv_id AND r.call_id = c.call_id)
SELECT conv_id, call_id, name, seq, level, status, errors, repeats,
  '{' || concat_ws(',', CASE WHEN call_seq IS NOT NULL THEN '"arguments":{' || concat_ws(',', '"text":' || CAST(to_json(text) AS VARCHAR), '"turn":' || call_seq) || '}' END,
    '"content":' || CAST(to_json(content) AS VARCHAR), CASE WHEN errors <> '' THEN '"errors":["' || replace(errors, '; ', '","') || '"]' END,
    '"id":"' || call_id || '"', '"level":' || level, '"name":"' || name || '"', '"status":"' || status || '"') || '}' AS json
FROM all_
"""
