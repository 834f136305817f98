"""Tool calls of conversations: linked to their results, checked, ordered and written as canonical JSON.

Everything here is a DataFrame operation. A call may use the result of one earlier call of its
conversation, `after`; a call comes behind the one it uses, and a result behind its call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fileledger.llm.rows import table
from fileledger.operators.heavy_keys import join_groups
from fileledger.operators.ordering import number_in_groups
from fileledger.session import cut_lineage

_KEY = ["conv_id", "call_id"]


def link_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each call once, with `result` and `result_turn`; null where there is none.

    Of repeated calls or results of one identifier the one with the smallest turn counts, and with the
    smallest name, arguments or content on ties. They are reduced before they meet, so the join is
    one to one, by hash, however often an identifier is repeated.
    """
    first_call = F.min(F.struct("turn", "name", "arguments", "after")).alias("c")
    first_result = F.min(F.struct("turn", "content")).alias("r")
    own = calls.groupBy(*_KEY).agg(first_call).select(*_KEY, "c.*")
    told = results.dropna(subset=_KEY).groupBy(*_KEY).agg(first_result)
    told = told.select(*_KEY, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("result"))
    return own.join(told.hint("shuffle_hash"), _KEY, "left")


def levels(calls: DataFrame) -> DataFrame:
    """Add `level`, how many calls go before a call, one using the other; null in or behind a circle.

    A call that uses none, or one that is not there, has level 0; the latter is `dangling`. Each round
    a call takes over the way of the call at the end of its own, so ways double: a chain of n calls
    takes about log2 n rounds. Each round is written down.
    """
    nodes = cut_lineage(calls.select(*_KEY, "after"))
    there = nodes.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("there"))
    state = cut_lineage(
        nodes.join(there, ["conv_id", "after"], "left").select(
            *_KEY,
            F.when(F.col("there"), F.col("after")).alias("ahead"),
            F.when(F.col("there"), 1).otherwise(0).cast("bigint").alias("level"),
            (F.col("after").isNotNull() & F.col("there").isNull()).alias("dangling"),
        )
    )
    rounds = nodes.count().bit_length() + 1
    for _ in range(rounds):
        going = state.filter("ahead is not null")
        if going.isEmpty():
            break
        ends = state.select(
            "conv_id", F.col("call_id").alias("ahead"), F.col("ahead").alias("further"), F.col("level").alias("more")
        )
        moved = going.join(ends, ["conv_id", "ahead"]).select(
            *_KEY, F.col("further").alias("ahead"), (F.col("level") + F.col("more")).alias("level"), "dangling"
        )
        state = cut_lineage(state.filter("ahead is null").unionByName(moved))
    # After so many rounds only ways in circles have not ended.
    ended = F.when(F.col("ahead").isNull(), F.col("level"))
    return calls.join(state.select(*_KEY, ended.alias("level"), "dangling"), _KEY)


def _kind(of: Column) -> Column:
    """JSON type of a variant."""
    name = F.regexp_extract(F.schema_of_variant(of), "^[A-Z]+", 0)
    return (
        F.when(name == "BIGINT", "integer")
        .when(name.isin("DECIMAL", "DOUBLE", "FLOAT"), "number")
        .when(name == "VOID", "null")
        .otherwise(F.lower(name))
    )


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Add `errors`, sorted texts of what is wrong with `arguments`; empty if nothing is.

    `schemas` has rows (name, parameter, type, required), types being string, integer, number,
    boolean, object and array; of repeated rows for a parameter the smallest holds. A decimal number is no integer, an integer is a number. A null argument
    counts as missing. Names without schema are an error, and so is what is no JSON object.
    """
    one_each = (
        schemas.dropna(subset=["name", "parameter"])
        .groupBy("name", "parameter")
        .agg(F.min(F.struct("type", "required")).alias("rule"))
    )
    rules = one_each.groupBy("name").agg(
        F.map_from_entries(F.collect_list(F.struct("parameter", "rule"))).alias("__rules")
    )
    parsed = F.from_json("arguments", "map<string,variant>")
    is_object = F.schema_of_variant(F.try_parse_json("arguments")).startswith("OBJECT")
    given = F.transform(F.map_entries(parsed), lambda e: F.struct(e["key"].alias("key"), _kind(e["value"]).alias("kind")))
    given = F.filter(given, lambda e: e["kind"] != "null")

    def fits(kind: Column, wanted: Column) -> Column:
        return (kind == wanted) | ((wanted == "number") & (kind == "integer"))

    def wrong(e: Column) -> Column:
        rule = F.col("__rules")[e["key"]]
        return (
            F.when(rule.isNull(), F.concat(F.lit("unknown: "), e["key"]))
            .when(~fits(e["kind"], rule["type"]), F.concat(F.lit("type: "), e["key"]))
        )

    missing = F.transform(
        F.filter(
            F.map_entries("__rules"),
            lambda e: e["value"]["required"] & ~F.array_contains(F.transform("__given", lambda g: g["key"]), e["key"]),
        ),
        lambda e: F.concat(F.lit("missing: "), e["key"]),
    )
    found = F.concat(F.filter(F.transform("__given", wrong), lambda x: x.isNotNull()), missing)
    return (
        calls.join(rules, "name", "left")
        .withColumn("__given", given)
        .withColumn(
            "errors",
            F.when(F.col("__rules").isNull(), F.array(F.lit("no such tool")))
            .when(~F.coalesce(is_object, F.lit(False)), F.array(F.lit("no JSON object")))
            .otherwise(F.array_sort(found)),
        )
        .drop("__given", "__rules")
    )


def canonical(**fields: Column) -> Column:
    """A JSON object with its keys sorted, at every depth, and no white space; nulls are written."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, linked, ordered, checked and serialised.

    `calls` has conv_id, call_id, turn, name, arguments and after; `results` conv_id, call_id, turn
    and content; other columns are not used. `place` counts a conversation's calls from 1 in the order
    of (level, turn, call_id), in which each call follows the one it uses; calls in circles come last
    and have no level. `status` is ok, invalid (see `errors`), unanswered, dangling, circular, or
    early if the result's turn is not behind the call's; the first that holds of circular, dangling,
    invalid, unanswered, early. `json` is the canonical form; arguments that are no JSON become null.

    Calls without conversation or identifier can't be linked: they are kept as they are, `unnamed`,
    without place. Results without a call are left out. Empty tables give no rows. A conversation of
    any length is numbered in sorted ranges, not in one task.
    """
    named = calls.dropna(subset=_KEY)
    linked = cut_lineage(validate(levels(link_results(named, results)), schemas))
    late = F.col("result_turn") <= F.col("turn")
    status = (
        F.when(F.col("level").isNull(), "circular")
        .when(F.col("dangling"), "dangling")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("result_turn").isNull(), "unanswered")
        .when(late, "early")
        .otherwise("ok")
    )
    ordered = number_in_groups(
        linked.withColumns({"status": status, "__order": F.coalesce("level", F.lit(2**62))}),
        "conv_id",
        ["__order", "turn", "call_id"],
        "place",
        "call_id",
    )
    unnamed = calls.filter(F.col("conv_id").isNull() | F.col("call_id").isNull())
    columns = [*_KEY, "turn", "name", "level", "place", "status", "errors", "json"]
    json = canonical(
        after=F.col("after"),
        arguments=F.try_parse_json("arguments"),
        id=F.col("call_id"),
        name=F.col("name"),
        result=F.col("result"),
    )
    kept = unnamed.withColumns(
        {
            "level": F.lit(None).cast("bigint"),
            "place": F.lit(None).cast("bigint"),
            "status": F.lit("unnamed"),
            "errors": F.array().cast("array<string>"),
            "result": F.lit(None).cast("string"),
        }
    )
    return ordered.withColumn("json", json).select(*columns).unionByName(kept.withColumn("json", json).select(*columns))


def calls_of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read from a plain conversation: what a user says calls a tool, what the
    assistant says next answers it.

    The tool depends on the turn. Every call uses the one two turns before, the first none. Each
    third text of a length divisible by three makes a slip: a limit as text, no query, or a
    parameter too many.
    """
    size = F.length("text")
    name = F.element_at(F.array(F.lit("search"), F.lit("summarise"), F.lit("translate")), (F.col("turn") % 3 + 1).cast("int"))
    call_id = F.concat(F.lit("call_"), F.col("turn"))
    slip = F.when(size % 3 == 0, size % 9)
    plain = F.to_json(F.struct(F.col("text").alias("query"), size.alias("limit")))
    arguments = (
        F.when(slip == 0, F.to_json(F.struct(F.col("text").alias("query"), size.cast("string").alias("limit"))))
        .when(slip == 3, F.to_json(F.struct(size.alias("limit"))))
        .when(slip == 6, F.to_json(F.struct(F.lit(True).alias("safe"), F.col("text").alias("query"), size.alias("limit"))))
        .otherwise(plain)
    )
    calls = conversations.filter("role = 'user' and text is not null").select(
        "conv_id",
        call_id.alias("call_id"),
        "turn",
        name.alias("name"),
        arguments.alias("arguments"),
        F.when(F.col("turn") >= 2, F.concat(F.lit("call_"), F.col("turn") - 2)).alias("after"),
    )
    results = conversations.filter("role = 'assistant'").select(
        "conv_id", F.concat(F.lit("call_"), F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content")
    )
    return calls, results


def tool_schemas(spark: SparkSession) -> DataFrame:
    """Parameters of the tools that the query's calls name."""
    rows = [
        (name, parameter, kind, True)
        for name in ("search", "summarise", "translate")
        for parameter, kind in (("query", "string"), ("limit", "integer"))
    ]
    return spark.createDataFrame(rows, "name string, parameter string, type string, required boolean")


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of the conversations, linked to its result, ordered and checked, as canonical JSON."""
    calls, results = calls_of_conversations(table(spark, sf_dir, "conversations"))
    found = link_tool_calls(calls, results, tool_schemas(spark))
    return found.withColumn("errors", F.array_join("errors", ", "))


#: The same in SQL.
SQL = r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, 'call_' || turn AS call_id, text, length(text) AS size,
    (['search', 'summarise', 'translate'])[turn % 3 + 1] AS name,
    CASE WHEN length(text) % 3 = 0 THEN length(text) % 9 END AS slip,
    CASE WHEN turn >= 2 THEN turn - 2 END AS before
  FROM conversations WHERE role = 'user' AND text IS NOT NULL
), linked AS (
  SELECT c.*, b.turn IS NOT NULL AS has_before, r.turn IS NOT NULL AS answered, r.text AS result
  FROM calls c LEFT JOIN calls b ON b.conv_id = c.conv_id AND b.turn = c.before
  LEFT JOIN conversations r ON r.conv_id = c.conv_id AND r.role = 'assistant' AND r.turn - 1 = c.turn
), levels AS (
  SELECT conv_id, turn, 0 AS level FROM linked WHERE NOT has_before
  UNION ALL
  SELECT l.conv_id, l.turn, p.level + 1 FROM levels p
  JOIN linked l ON l.conv_id = p.conv_id AND l.before = p.turn AND l.has_before
), marked AS (
  SELECT l.*, v.level,
    CASE slip WHEN 0 THEN 'type: limit' WHEN 3 THEN 'missing: query' WHEN 6 THEN 'unknown: safe' ELSE '' END AS errors,
    CASE slip
      WHEN 0 THEN '{"limit":"' || size || '","query":' || to_json(text)::VARCHAR || '}'
      WHEN 3 THEN '{"limit":' || size || '}'
      WHEN 6 THEN '{"limit":' || size || ',"query":' || to_json(text)::VARCHAR || ',"safe":true}'
      ELSE '{"limit":' || size || ',"query":' || to_json(text)::VARCHAR || '}' END AS arguments
  FROM linked l LEFT JOIN levels v USING (conv_id, turn)
)
SELECT conv_id, call_id, turn, name, level::BIGINT AS level,
  row_number() OVER (PARTITION BY conv_id ORDER BY level, turn, call_id) AS place,
  CASE WHEN before IS NOT NULL AND NOT has_before THEN 'dangling' WHEN errors <> '' THEN 'invalid'
    WHEN NOT answered THEN 'unanswered' ELSE 'ok' END AS status,
  errors,
  '{"after":' || coalesce('"call_' || before || '"', 'null') || ',"arguments":' || arguments || ',"id":"' || call_id
    || '","name":"' || name || '","result":' || coalesce(to_json(result)::VARCHAR, 'null') || '}' AS json
FROM marked
"""
