"""Tool-call linking for chat formatting.

Calls and results are hash-joined by identifier. A call may name calls after which it came; its place in the topological order is the length
of the longest path to it. Chains are found by pointer doubling, so that a chain of n calls takes log2(n) joins; calls that come after
several take a round for each layer of such calls. No conversation is gathered in one task. Arguments are validated against schemas, and
each link is serialised as canonical JSON (keys in order, no white space). Only DataFrame operations are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import Scratch, table

#: Names of JSON kinds, by what the type of a variant begins with. An integer is a number without a fraction, however it is written: 3.0 is 3.
NUMBER = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
KINDS = {"string": ("STRING",), "integer": NUMBER, "number": NUMBER, "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}


@dataclass(frozen=True)
class Param:
    """A parameter of a tool; least bounds a number's value or a string's length in characters, choices are all strings that it may be,
    inside are the parameters of an object."""

    name: str
    kind: str
    required: bool = True
    least: int | None = None
    choices: tuple[str, ...] = ()
    inside: tuple[Param, ...] = ()


#: The tools of the registered query.
TOOLS = {
    "configure": (Param("text", "string", least=1),),
    "reply": (Param("text", "string", least=1), Param("turn", "integer", least=0), Param("words", "integer", required=False, least=1)),
}


def found(args: Column, params: tuple[Param, ...], above: str = "") -> list[Column]:
    """What is wrong with the parameters of an object, each null where it is right."""
    out = []
    for p in params:
        at, name = "$" + "".join(f"['{x}']" for x in f"{above}{p.name}".split(".")), f"{above}{p.name}"
        value = F.try_variant_get(args, at, "variant")
        kind = F.schema_of_variant(value)
        absent = value.isNull() | F.is_variant_null(value)
        fits = F.lit(False)
        for k in KINDS[p.kind]:
            fits = fits | kind.startswith(k)
        if p.kind == "integer":
            number = F.try_variant_get(args, at, "double")
            fits = fits & (number == F.floor(number))
        out.append(F.when(absent, F.lit(f"missing {name}") if p.required else F.lit(None)).when(~fits, f"kind of {name}"))
        if p.least is not None:
            size = F.char_length(F.try_variant_get(args, at, "string")).cast("double") if p.kind == "string" else F.try_variant_get(args, at, "double")
            out.append(F.when(~absent & fits & (size < p.least), f"least {name}"))
        if p.choices:
            out.append(F.when(~absent & fits & ~F.try_variant_get(args, at, "string").isin(*p.choices), f"choice of {name}"))
        out += [F.when(~absent & fits, x) for x in found(args, p.inside, f"{name}.")]
    return out


def errors(name: Column, args: Column, raw: Column, tools: dict[str, tuple[Param, ...]], closed: bool = False) -> Column:
    """What is wrong with the arguments, in the order of the schema; args is the variant of raw, null if that isn't JSON or repeats a key.
    Where tools are closed, keys that the schema doesn't name are wrong too."""
    known, keys = F.lit(None).cast("array<string>"), F.json_object_keys(raw)
    for tool, params in sorted(tools.items()):
        wrong = F.filter(F.array(*found(args, params)), lambda x: x.isNotNull())
        if closed:
            wrong = F.concat(wrong, F.transform(F.array_sort(F.array_except(keys, F.array(*(F.lit(p.name) for p in params)))), lambda x: F.concat(F.lit("unknown "), x)))
        known = F.when(name == tool, wrong).otherwise(known)
    shape = F.schema_of_variant(args).startswith("OBJECT")
    unread = F.when(keys.isNotNull(), F.array(F.lit("repeated key"))).otherwise(F.array(F.lit("not an object")))
    return F.when(args.isNull(), unread).when(~shape, F.array(F.lit("not an object"))).otherwise(F.coalesce(known, F.array(F.lit("unknown tool"))))


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """call_id, level for the distinct identifiers of calls(call_id, after), after being an identifier or an array of them.

    level is the number of calls before it on the longest path; a call that names no call that is there begins one. It is null in a
    cycle, and behind one. Where an identifier is repeated with one `after` each, the least counts.
    """
    named = calls.where("call_id IS NOT NULL")
    if dict(calls.dtypes)["after"] == "string":
        named = named.groupBy("call_id").agg(F.array_compact(F.array(F.min("after"))).alias("after"))
    edges = named.select("call_id", F.explode_outer("after").alias("up")).distinct()
    there = named.select(F.col("call_id").alias("_id")).distinct()
    edges = scratch.write(edges.join(there, F.col("up") == F.col("_id"), "left").select("call_id", F.col("_id").alias("up")).distinct(), "edges")
    # a call with several before it, as one with none, is where chains begin
    state = edges.groupBy("call_id").agg(F.count("up").alias("k"), F.max("up").alias("up"))
    alone = F.col("k") == 1
    state = state.select("call_id", F.when(alone, F.col("up")).alias("up"), F.when(alone, F.col("up")).otherwise(F.col("call_id")).alias("top"), F.when(alone, 1).otherwise(0).cast("bigint").alias("n"), (F.col("k") > 1).alias("joint"))
    step, open_before = 0, -1
    state = scratch.write(state, "state-0")
    while True:
        # a chain of up to 2**step calls has reached its beginning; where nothing more does, only cycles are left
        open_now = state.where("up IS NOT NULL").count()
        if open_now in (0, open_before):
            break
        open_before = open_now
        above = state.select(F.col("call_id").alias("_id"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("n").alias("_n"))
        moved = state.where("up IS NOT NULL").join(above, F.col("up") == F.col("_id")).select("call_id", F.col("_up").alias("up"), F.col("_top").alias("top"), (F.col("n") + F.col("_n")).alias("n"), "joint")
        state = scratch.write(state.where("up IS NULL").unionByName(moved), f"state-{step + 1}")
        scratch.drop(f"state-{step}")
        step += 1
    reached = state.where("up IS NULL")
    tops = reached.where("n = 0 AND NOT joint").select(F.col("call_id").alias("top"), F.lit(0).cast("bigint").alias("base"))
    waiting = state.where("joint").count()
    if waiting:
        # each of these waits until the beginnings of all chains that lead to it have their level
        chains = state.select(F.col("call_id").alias("_id"), F.when(F.col("up").isNull(), F.col("top")).alias("_from"), (F.col("n") + 1).alias("_more"))
        leads = edges.join(state.where("joint").select(F.col("call_id").alias("_j")), F.col("call_id") == F.col("_j"), "left_semi").join(chains, F.col("up") == F.col("_id"))
        leads, k = scratch.write(leads.select(F.col("call_id").alias("joint"), "_from", "_more"), "leads"), 0
        tops = scratch.write(tops, "tops-0")
        while waiting:
            known = leads.join(tops.toDF("_top", "_base"), F.col("_from") == F.col("_top"), "left").groupBy("joint").agg(F.max(F.col("_base") + F.col("_more")).alias("base"), F.count(F.lit(1)).alias("all"), F.count("_base").alias("some"))
            ready = known.where("all = some").select(F.col("joint").alias("top"), "base")
            fresh = scratch.write(ready.join(tops.select(F.col("top").alias("_t")), F.col("top") == F.col("_t"), "left_anti"), f"fresh-{k}")
            count = fresh.count()
            if not count:
                break
            tops, k, waiting = scratch.write(tops.unionByName(fresh), f"tops-{k + 1}"), k + 1, waiting - count
            scratch.drop(f"tops-{k - 1}", f"fresh-{k - 1}")
    out = state.join(tops.withColumnRenamed("top", "_top"), (F.col("top") == F.col("_top")) & F.col("up").isNull(), "left")
    return out.select("call_id", (F.col("base") + F.col("n")).alias("level"))


def link(calls: DataFrame, results: DataFrame, scratch: Scratch, tools: dict[str, tuple[Param, ...]] = TOOLS, closed: bool = False) -> DataFrame:
    """conv_id, turn, call_id, name, level, n_results, errors, valid, json: one row for each call, and one for each identifier of results
    without a call (name, level and turn null).

    calls(conv_id, turn, call_id, after, name, arguments), results(conv_id, turn, call_id, content). Of several results the
    earliest counts, by turn (null last), then content. A call without identifier links nothing and has no level; a result
    without one is left out, there is nothing that it could answer. Calls repeated under one identifier are linked each. A
    conversation's calls are in topological order when sorted by level, turn and call_id.

    Arguments that can't be read, as they aren't JSON, repeat a key or are above a variant's size, are in the JSON as the string that came. A
    content of any length is only copied. Other columns are ignored.
    """
    first = F.min(F.struct(F.col("turn").isNull().alias("_z"), "turn", "content", "conv_id"))
    answers = results.where("call_id IS NOT NULL").groupBy(F.col("call_id").alias("_id")).agg(first.alias("_first"), F.count(F.lit(1)).alias("_n"))
    answers = scratch.write(answers, "answers")
    place = scratch.write(levels(calls, scratch).toDF("_call", "level"), "levels")
    held = scratch.write(calls.select("conv_id", "turn", "call_id", "name", "arguments"), "calls")
    linked = held.join(place, F.col("call_id") == F.col("_call"), "left").join(answers, F.col("call_id") == F.col("_id"), "left")
    linked = linked.select("conv_id", "turn", "call_id", "name", "level", "arguments", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_results"), F.col("_first.content").alias("_content"))
    ids = held.select("call_id").where("call_id IS NOT NULL").distinct()
    alone = answers.join(ids, F.col("_id") == F.col("call_id"), "left_anti")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    alone = alone.select(F.col("_first.conv_id").alias("conv_id"), null("bigint", "turn"), F.col("_id").alias("call_id"), null("string", "name"), null("bigint", "level"), null("string", "arguments"), F.col("_n").alias("n_results"), F.col("_first.content").alias("_content"))
    parsed = linked.withColumn("_args", F.try_parse_json("arguments")).withColumn("errors", F.array_join(errors(F.col("name"), F.col("_args"), F.col("arguments"), tools, closed), ","))
    parsed = parsed.unionByName(alone.withColumn("_args", F.try_parse_json("arguments")).withColumn("errors", F.lit("no call")))
    # keys of a variant are kept in order, and those of the struct are in order; only one of the two forms of arguments is there
    result = F.when(F.col("n_results") > 0, F.struct(F.col("_content").alias("content"))).alias("result")
    form = lambda args: F.to_json(F.struct(args.alias("arguments"), "call_id", "name", result))
    json = F.when(F.col("_args").isNull(), form(F.col("arguments"))).otherwise(form(F.col("_args")))
    return parsed.select("conv_id", "turn", "call_id", "name", "level", "n_results", "errors", (F.col("errors") == "").alias("valid"), json.alias("json"))


def of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of turns(conv_id, turn, role, text): a user's turn calls `reply` and a system's `configure`, each after the last but
    one turn; an assistant's turn is the result of the turn before it."""
    name = F.concat_ws(":", "conv_id", "turn")
    asked = turns.where("role IN ('user', 'system')")
    after = F.when(F.col("role") == "user", F.concat_ws(":", "conv_id", F.col("turn") - 2))
    reply = F.to_json(F.struct("turn", "text", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words")))
    calls = asked.select("conv_id", "turn", name.alias("call_id"), after.alias("after"), F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name"), F.when(F.col("role") == "user", reply).otherwise(F.to_json(F.struct("text"))).alias("arguments"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = of_conversations(table(spark, sf_dir, "conversations"))
    return link(calls, results, Scratch(spark, "op6"))


OP6_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, text, role, conv_id || ':' || turn AS call_id, CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS name,
         CASE role WHEN 'user' THEN conv_id || ':' || (turn - 2) END AS after, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE role IN ('user', 'system')),
r AS (SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
lv AS (
  SELECT call_id, 0 AS level FROM c WHERE after IS NULL OR after NOT IN (SELECT call_id FROM c)
  UNION ALL SELECT c.call_id, lv.level + 1 FROM c JOIN lv ON c.after = lv.call_id),
f AS (SELECT call_id, arg_min(content, turn) AS content, min(conv_id) AS conv_id, count(*) AS n FROM r GROUP BY call_id),
j AS (
  SELECT coalesce(c.conv_id, f.conv_id) AS conv_id, c.turn, coalesce(c.call_id, f.call_id) AS call_id, c.name, lv.level, coalesce(f.n, 0) AS n_results,
         CASE WHEN c.call_id IS NULL THEN 'no call' WHEN coalesce(length(c.text), 0) = 0 THEN CASE WHEN c.text IS NULL THEN 'missing text' ELSE 'least text' END || CASE WHEN c.role = 'user' THEN ',least words' ELSE '' END
              WHEN c.role = 'user' AND words < 1 THEN 'least words' ELSE '' END AS errors,
         CASE WHEN c.role = 'user' THEN '"arguments":{"text":' || to_json(c.text) || ',"turn":' || c.turn || ',"words":' || c.words || '},' WHEN c.role = 'system' THEN '"arguments":{"text":' || to_json(c.text) || '},' ELSE '' END AS args, f.content
  FROM c FULL JOIN f ON c.call_id = f.call_id LEFT JOIN lv ON lv.call_id = c.call_id)
SELECT conv_id, turn, call_id, name, CAST(level AS BIGINT) AS level, CAST(n_results AS BIGINT) AS n_results, errors, errors = '' AS valid,
       '{' || args || '"call_id":"' || call_id || '"' || CASE WHEN name IS NOT NULL THEN ',"name":"' || name || '"' ELSE '' END || CASE WHEN n_results > 0 THEN ',"result":{"content":' || to_json(content) || '}' ELSE '' END || '}' AS json
FROM j
"""
