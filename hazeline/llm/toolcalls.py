"""Chat formatting by linking tool calls and results (operator 8), DataFrame functions only.

Calls and results meet in a hash join on conversation and call id. A call may need the results of others: its level is
the longest way down to a call that needs none. Chains are contracted by pointer doubling, the rest is placed in rounds
of joins, each of which counts down the needs that the round before met; what is never placed is in a cycle or behind one. Arguments are checked against the tool's schema. A call becomes one line of
canonical JSON: keys sorted, no spare white space.

Defined results: calls and results without conversation or id are left out. Of calls that repeat an id the least by
(name, arguments) stays, and "repeated id" is a problem if they differ; of repeated results the least content stays.
Results without a call are listed as orphans. Needs that name no call of the conversation are a problem and are not
waited for. Arguments that are no JSON object, fields that are unknown, missing or of another type are problems; for
tools without schema that is the only problem. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hazeline.session import materialized

KEY = ["conv_id", "call_id"]


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as tool use: every user turn calls the tool "answer", and an assistant turn is the result of the
    turn before it. A call needs the result of the user turn two turns earlier, if there is one."""
    turns = conversations.where("conv_id is not null and turn is not null")
    name = F.concat_ws(":", "conv_id", "turn")
    earlier = F.concat_ws(":", "conv_id", F.col("turn") - 2)
    asked = turns.where("role = 'user'")
    before = asked.select(F.col("conv_id"), (F.col("turn") + 2).alias("turn"), F.lit(True).alias("follows")).distinct()
    calls = asked.join(before, ["conv_id", "turn"], "left").select(
        "conv_id", name.alias("call_id"), F.lit("answer").alias("name"),
        F.to_json(F.struct("turn", "text", F.when(F.col("follows"), earlier).alias("after"))).alias("arguments"),
        F.when(F.col("follows"), F.array(earlier)).otherwise(F.array().cast("array<string>")).alias("needs"))
    results = turns.where("role = 'assistant'").select(
        "conv_id", F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def answer_schema(calls: DataFrame) -> DataFrame:
    """The schema of the tool "answer": name, fields with their types, and the required ones.

    It is written as a table, as schemas of real tools would be: a literal name would turn the join into a nested loop.
    """
    schema = calls.sparkSession.range(1).select(
        F.lit("answer").alias("name"), F.expr("map('turn', 'BIGINT', 'text', 'STRING', 'after', 'STRING')").alias("fields"),
        F.array(F.lit("turn"), F.lit("text")).alias("required"))
    return materialized(schema, "schema")


def plain_turns(conversations: DataFrame) -> DataFrame:
    """Turns that are neither call nor result (other roles, no role, no conversation or turn), as ``linked`` rows."""
    known = F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    line = F.to_json(F.struct("role", "text", "turn"), {"ignoreNullFields": "false"})
    return conversations.where(~known).select(
        "conv_id", F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("call_id"),
        F.lit("plain").alias("status"), F.lit(None).cast("long").alias("level"),
        F.array().cast("array<string>").alias("problems"), line.alias("json"))


def _ends_of_chains(single: DataFrame) -> DataFrame:
    """Calls with one need (conv_id, call_id, need): where the chain of such calls ends, and how far that is.

    Pointers are doubled: every round a call takes over the pointer of the call that it points to, so a chain of n calls
    takes log n rounds, each over one written table. Calls whose chain never ends are in a cycle or behind one; their
    pointers stay within it.
    """
    at = materialized(single.select(*KEY, F.col("need").alias("end"), F.lit(1).cast("long").alias("steps")), "chains")
    reach, total = 1, at.count()
    while reach <= total:
        ahead = at.select("conv_id", F.col("call_id").alias("end"), F.col("end").alias("further"), F.col("steps").alias("more"))
        jumped = materialized(
            at.join(ahead, ["conv_id", "end"], "left").select(
                *KEY, F.coalesce("further", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
                F.col("further").isNotNull().alias("moved")), "chains")
        at, reach = jumped.drop("moved"), 2 * reach
        if jumped.where("moved").isEmpty():
            break
    return at


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of every call that can be placed; edges: (conv_id, call_id, need), each once.

    Chains of calls with one need are contracted first. What is left are calls with several needs: a round meets their
    edges with the calls placed in the round before only and counts unmet needs down. Every round reads and writes
    tables, so its plan is of one size, and there are as many rounds as calls with several needs lie behind one another.
    """
    needs = edges.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need"))
    needs = materialized(needs, "needs")
    chains = _ends_of_chains(needs.where("n = 1").select(*KEY, "need"))
    roots = calls.join(needs, KEY, "left_anti").select(*KEY, F.lit(0).cast("long").alias("level"))
    placed = [materialized(roots, "level")]
    waiting = materialized(needs.where("n > 1").select(*KEY, F.col("n").alias("unmet"), F.lit(0).cast("long").alias("level")), "waiting")
    if not waiting.isEmpty():
        shortened = chains.select("conv_id", F.col("call_id").alias("need"), "end", "steps")
        several = materialized(
            edges.join(waiting.select(KEY), KEY, "left_semi").join(shortened, ["conv_id", "need"], "left").select(
                *KEY, F.coalesce("end", "need").alias("need"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")), "edges")
        while not placed[-1].isEmpty() and not waiting.isEmpty():
            news = placed[-1].select("conv_id", F.col("call_id").alias("need"), F.col("level").alias("below"))
            met = several.join(news, ["conv_id", "need"]).groupBy(KEY).agg(
                F.count(F.lit(1)).alias("met"), F.max(F.col("below") + F.col("steps")).alias("above"))
            left = materialized(
                waiting.join(met, KEY, "left").select(
                    *KEY, (F.col("unmet") - F.coalesce("met", F.lit(0))).alias("unmet"),
                    F.greatest("level", F.coalesce("above", F.lit(0))).alias("level")), "waiting")
            placed.append(materialized(left.where("unmet = 0").select(*KEY, "level"), "level"))
            waiting = materialized(left.where("unmet > 0"), "waiting")
    found = reduce(DataFrame.unionAll, placed)
    ends = found.select("conv_id", F.col("call_id").alias("end"), F.col("level").alias("below"))
    behind = chains.join(ends, ["conv_id", "end"]).select(*KEY, (F.col("below") + F.col("steps")).alias("level"))
    return found.unionAll(behind)


def _problems(arguments: Column) -> Column:
    """Problems of a call's arguments against ``fields`` and ``required``."""
    fields = F.when(F.col("fields").isNotNull(), F.array_except(F.map_keys(arguments), F.map_keys("fields")))
    unknown = F.transform(fields, lambda f: F.concat(F.lit("unknown field "), f))
    missing = F.transform(F.filter("required", lambda f: ~F.map_contains_key(arguments, f)),
                          lambda f: F.concat(F.lit("missing field "), f))
    wrong = F.transform(
        F.filter(F.map_keys(arguments), lambda f: F.schema_of_variant(F.element_at(arguments, f)) != F.try_element_at("fields", f)),
        lambda f: F.concat(F.lit("wrong type of "), f))
    none = F.array().cast("array<string>")
    return F.when(arguments.isNull(), F.array(F.lit("no JSON object"))).otherwise(
        F.concat(*[F.coalesce(x, none) for x in (unknown, missing, wrong)]))


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call and each orphan result: conv_id, call_id, status, level, problems and json.

    calls: conv_id, call_id, name, arguments (JSON text), needs (ids); results: conv_id, call_id, content; schemas:
    name, fields (map from field to type as ``schema_of_variant`` writes it), required. Status is linked, open (no
    result), orphan (no call) or cyclic.
    """
    known = "conv_id is not null and call_id is not null"
    one = F.struct("name", "arguments")
    calls = materialized(calls.where(known).groupBy(KEY).agg(
        F.min(one).alias("call"), F.max(one).alias("other"), F.min("needs").alias("needs"))
        .select(*KEY, "call.name", "call.arguments", "needs", (~F.col("call").eqNullSafe(F.col("other"))).alias("repeated")), "calls")
    results = results.where(known).groupBy(KEY).agg(F.min("content").alias("content"), F.lit(True).alias("answered"))
    wanted = calls.select(*KEY, F.explode("needs").alias("need")).distinct()
    edges = materialized(wanted.join(calls.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"])
                         .select(*KEY, "need"), "edges")
    lost = wanted.join(edges, [*KEY, "need"], "left_anti").select(KEY).distinct().withColumn("lost", F.lit(True))
    both = (calls.join(results.hint("shuffle_hash"), KEY, "left").join(levels(calls, edges), KEY, "left")
            .join(lost, KEY, "left").join(schemas, "name", "left"))
    both = both.withColumn("parsed", F.try_parse_json("arguments"))
    arguments = F.expr("try_variant_get(parsed, '$', 'map<string,variant>')")
    problems = F.concat(
        F.when(F.col("repeated"), F.array(F.lit("repeated id"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("lost"), F.array(F.lit("unknown need"))).otherwise(F.array().cast("array<string>")),
        _problems(F.col("args")))
    line = F.to_json(F.struct(F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), "level", "name",
                              F.col("content").alias("result")), {"ignoreNullFields": "false"})
    status = F.when(F.col("level").isNull(), "cyclic").when(F.col("answered"), "linked").otherwise("open")
    rows = both.withColumn("args", arguments).select(
        *KEY, status.alias("status"), "level", problems.alias("problems"), line.alias("json"))
    orphans = results.join(calls.select(KEY), KEY, "left_anti").select(
        *KEY, F.lit("orphan").alias("status"), F.lit(None).cast("long").alias("level"),
        F.array(F.lit("no call")).alias("problems"),
        F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result")), {"ignoreNullFields": "false"}).alias("json"))
    return rows.unionAll(orphans)


def digests(rows: DataFrame) -> DataFrame:
    """The rows with their lists and lines as short values."""
    return rows.select(*KEY, "status", F.col("level").cast("long").alias("level"),
                       F.size("problems").cast("long").alias("n_problems"), F.sha2("json", 256).alias("json_sha256"))
