"""Chat records with tool calls: link results to calls, order, validate, serialise canonical JSON.

Calls and results are joined by hash of their conversation and identifier. A call may name calls whose
results its arguments use; the order that follows comes from joins, so a conversation of any size is
ordered by many tasks. Arguments are parsed once to a variant, whose JSON has its keys in
order and no spare blanks, and checked field by field against the tool's schema.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tellsift.llm.common import cut_lineage, written

_KINDS = {"string": r"^STRING$", "integer": r"^(BIGINT|INT|SMALLINT|TINYINT)$", "number": r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": r"^BOOLEAN$", "array": r"^ARRAY.*$", "object": r"^OBJECT.*$"}


@dataclass(frozen=True)
class Field:
    """One argument: its JSON type, whether it must be there, and limits of its value or length."""

    name: str
    kind: str
    required: bool = True
    least: float | None = None
    most: float | None = None


Schemas = dict[str, tuple[Field, ...]]


def argument_errors(tool: Column, parsed: Column, schemas: Schemas) -> Column:
    """Sorted names of what is wrong with a call's arguments: unknown tool, bad JSON, or ``field: fault``."""

    def of(fields: tuple[Field, ...]) -> Column:
        faults = []
        for f in fields:
            path = f"$['{f.name}']"
            value = F.variant_get(parsed, path, "variant")
            kind = F.schema_of_variant(value)
            there = value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(False))
            fits = kind.rlike(_KINDS[f.kind])
            measure = F.char_length(F.try_variant_get(parsed, path, "string")) if f.kind == "string" else F.try_variant_get(parsed, path, "double")
            outside = F.lit(False)
            if f.least is not None:
                outside = outside | (measure < f.least)
            if f.most is not None:
                outside = outside | (measure > f.most)
            fault = F.when(~there, F.lit(f"{f.name}: missing") if f.required else F.lit(None)).when(~fits, F.lit(f"{f.name}: type"))
            faults.append(fault.when(F.coalesce(outside, F.lit(False)), F.lit(f"{f.name}: range")))
        found = F.sort_array(F.array_compact(F.array(*faults))) if faults else F.array().cast("array<string>")
        allowed = F.array(*[F.lit(f.name) for f in fields]) if fields else F.array().cast("array<string>")
        keys = F.map_keys(F.from_json(F.to_json(parsed), "map<string,string>"))
        extra = F.transform(F.sort_array(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), allowed)), lambda k: F.concat(k, F.lit(": unknown")))
        return F.concat(found, extra)

    checked = F.when(parsed.isNull() | ~F.schema_of_variant(parsed).rlike("^OBJECT"), F.array(F.lit("arguments: not an object")))
    for name, fields in schemas.items():
        checked = checked.when(tool == name, of(fields))
    return checked.otherwise(F.array(F.lit("tool: unknown")))


def call_order(calls: DataFrame) -> DataFrame:
    """(conv, call, anchor, level) of calls (conv, call, at, needs): by anchor, then level, needs come first.

    anchor is the latest turn among a call and all calls it needs, directly or not. Most calls need earlier
    ones and stand at their own turn; only those that need a later one, and those that need these, move, one
    join a round, and there are as many rounds as the longest chain of moves. level orders calls of one anchor:
    0 needs none of them, others come after the highest they need; -1 is in a circle, or needs a call of one,
    directly or not. Needs that name no call count as met. Calls behind a circle take a round for each step.
    """
    anchors = written(calls.select("conv", "call", F.col("at").alias("anchor")))
    edges = calls.select("conv", "call", F.explode("needs").alias("need")).distinct()
    edges = written(edges.join(anchors.select("conv", F.col("call").alias("need")), ["conv", "need"], "left_semi"))
    needed = lambda: anchors.select("conv", F.col("call").alias("need"), F.col("anchor").alias("need_anchor"))
    while True:
        both = edges.join(needed(), ["conv", "need"]).join(anchors, ["conv", "call"])
        moved = written(both.where("need_anchor > anchor").groupBy("conv", "call").agg(F.max("need_anchor").alias("to")))
        if moved.limit(1).count() == 0:
            break
        anchors = written(anchors.join(moved, ["conv", "call"], "left").select("conv", "call", F.coalesce("to", "anchor").alias("anchor")))
    ties = written(both.where("need_anchor = anchor").select("conv", "call", "need"))
    waiting = ties.select("conv", "call").union(ties.select("conv", "need")).distinct()
    levels, level = None, 0
    while ties.limit(1).count():
        ready = written(waiting.join(ties.select("conv", "call"), ["conv", "call"], "left_anti").withColumn("level", F.lit(level)))
        if ready.limit(1).count() == 0:
            break
        levels = ready if levels is None else levels.unionByName(ready)
        done = ready.select("conv", "call")
        waiting = written(waiting.join(done, ["conv", "call"], "left_anti"))
        ties = written(ties.join(done.withColumnRenamed("call", "need"), ["conv", "need"], "left_anti"))
        level += 1
    stuck = waiting.join(ties.select("conv", "call"), ["conv", "call"], "left_semi").withColumn("level", F.lit(-1))
    last = waiting.join(ties.select("conv", "call"), ["conv", "call"], "left_anti").withColumn("level", F.lit(level))
    rest = stuck.unionByName(last)
    levels = written(rest if levels is None else levels.unionByName(rest))
    circular = fresh = written(levels.where("level < 0").select("conv", "call"))
    while fresh.limit(1).count():
        behind = edges.join(fresh.withColumnRenamed("call", "need"), ["conv", "need"], "left_semi").select("conv", "call").distinct()
        fresh = written(behind.join(circular, ["conv", "call"], "left_anti"))
        circular = circular.unionByName(fresh)
    levels = levels.join(circular, ["conv", "call"], "left_anti").unionByName(circular.withColumn("level", F.lit(-1)))
    return anchors.join(levels, ["conv", "call"], "left").withColumn("level", F.coalesce("level", F.lit(0)))


def link_tool_calls(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per message, in an order that puts every call before its result and what needs it.

    Input: conv_id, turn, role, text, call_id, tool, arguments (JSON text), needs (array of call ids), result_of.
    A row with a call_id is a call, one with a result_of a result; others are plain messages.
    Output: conv_id, turn, kind, call_id (a result's: its call's), level, anchor (the turn a message is
    ordered by), rank, status, errors and json. The order within a conversation is (anchor, level, call_id, rank,
    turn): plain messages stand at their own turn; calls as ``call_order`` says; a result right after its
    call, whatever its turn.
    status: ``ok``, ``invalid`` (a call with errors), ``unanswered``, ``circular``, ``repeated`` (a call whose id came at an
    earlier turn, or a result after the first of its call), ``orphan`` (a result without a call), ``plain``.
    Null conversations and ids link with nothing. Rows that are equal keep their number. Empty table: no rows.
    """
    base = messages.select(
        F.col("conv_id").alias("conv"), "turn", "role", "text", F.col("call_id").alias("call"), "tool", "arguments",
        F.coalesce("needs", F.array().cast("array<string>")).alias("needs"), F.col("result_of").alias("of"),
    )
    base = cut_lineage(base.withColumn("row", F.monotonically_increasing_id()))
    calls = base.where(F.col("call").isNotNull())
    named = calls.where(F.col("conv").isNotNull())
    first = cut_lineage(named.groupBy("conv", "call").agg(F.min(F.struct("turn", "row")).alias("f")).select("conv", "call", F.col("f.turn").alias("at"), F.col("f.row").alias("first_row")))
    results = base.where(F.col("call").isNull() & F.col("of").isNotNull())
    answers = results.groupBy("conv", "of").agg(F.min(F.struct("turn", "row")).alias("f")).select("conv", F.col("of").alias("call"), F.col("f.row").alias("answer_row"))
    own = named.join(first.select(F.col("first_row").alias("row")), "row", "left_semi")
    order = call_order(own.select("conv", "call", F.col("turn").alias("at"), "needs"))
    known = cut_lineage(first.join(order, ["conv", "call"]).join(answers, ["conv", "call"], "left"))
    linked = base.withColumn("is_call", F.col("call").isNotNull()).withColumn("call", F.coalesce("call", "of"))
    linked = linked.join(known, ["conv", "call"], "left")
    parsed = linked.withColumn("args", F.when(F.col("is_call"), F.try_parse_json("arguments")))
    errors = F.when(F.col("is_call"), argument_errors(F.col("tool"), F.col("args"), schemas)).otherwise(F.array().cast("array<string>"))
    judged = parsed.withColumn("errors", errors)
    kind = F.when(F.col("is_call"), "call").when(F.col("of").isNotNull(), "result").otherwise("message")
    status = (
        F.when(F.col("is_call") & (F.col("row") != F.coalesce("first_row", "row")), "repeated")
        .when(F.col("is_call") & (F.col("level") < 0), "circular")
        .when(F.col("is_call") & (F.size("errors") > 0), "invalid")
        .when(F.col("is_call") & F.col("answer_row").isNull(), "unanswered")
        .when(F.col("is_call"), "ok")
        .when(F.col("of").isNull(), "plain")
        .when(F.col("first_row").isNull(), "orphan")
        .when(F.col("row") != F.col("answer_row"), "repeated").otherwise("ok")
    )
    # keys in order of code points at every level; absent values are left out
    body = F.to_json(F.struct(F.col("call").alias("call_id"), F.coalesce("text", F.lit("")).alias("content"), F.col("role")))
    call_json = F.to_json(F.struct(
        F.col("args").alias("arguments"), F.struct(F.col("call").alias("id"), F.col("tool").alias("name")).alias("call"),
        F.when(F.col("args").isNull(), F.col("arguments")).alias("raw"), F.col("role"),
    ))
    return judged.select(
        F.col("conv").alias("conv_id"), "turn", kind.alias("kind"), F.col("call").alias("call_id"),
        F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("anchor", "turn").alias("anchor"),
        F.when(kind == "result", 1).otherwise(0).alias("rank"), status.alias("status"), F.concat_ws("; ", "errors").alias("errors"),
        F.when(F.col("is_call"), call_json).otherwise(body).alias("json"),
    )
