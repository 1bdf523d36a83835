"""One row a tool call, with its result beside it: the flat table for ad-hoc questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.columns import text_length
from colloquy.schema import MESSAGE

COLUMNS = ("source", "sourceVersion", "cwd", "gitBranch", "threadId", "timestamp", "model", "provider", "toolCallId", "tool", "arguments", "parsedArguments", "derived", "isError", "resultChars")
CSV_COLUMNS = ("source", "threadId", "timestamp", "model", "provider", "tool", "operation", "command", "isError", "resultChars", "cwd", "gitBranch")


def pair(calls: DataFrame, results: DataFrame, scope: list[str]) -> DataFrame:
    """calls (scope, call_id, pos, ...) with the results (scope, call_id, pos, is_error, chars) of the same call.

    The first of several calls with one id in a scope stays; the last of several results does. A call without a
    result has null is_error and chars, which is not a success; a result without an error flag is one.
    """
    first = Window.partitionBy(*scope, "call_id").orderBy("pos")
    kept = calls.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    last = results.groupBy(*scope, "call_id").agg(F.max_by(F.struct(F.coalesce("is_error", F.lit(False)).alias("is_error"), "chars"), "pos").alias("r"))
    # both sides are dealt by the same keys: one exchange each
    return kept.join(last, [*scope, "call_id"], "left").select(*kept.columns, F.col("r.is_error").alias("is_error"), F.col("r.chars").alias("chars"))


def tool_call_rows(imported: DataFrame, since: int | None = None) -> DataFrame:
    """COLUMNS for each call of imported conversations, and _file_ord, _file, _conversation_ord, _pos to order by.

    since filters by the call's time. resultChars counts the text of the result in UTF-16 units.
    """
    scope = ["_file_ord", "_file", "_conversation_ord"]
    t = imported.where("conversation is not null").select(F.col("file_ord").alias("_file_ord"), F.col("file").alias("_file"), F.col("conversation_ord").alias("_conversation_ord"), "conversation", F.posexplode("messages").alias("_seq", "m"))
    # calls and results leave the importers in one pass, as rows of one shape
    chars = lambda r: F.aggregate(F.filter(r["content"], lambda p: p["type"] == "text"), F.lit(0).cast("long"), lambda n, p: n + text_length(p["text"]))
    item = lambda i, call, call_id, r: F.struct(i.alias("part"), call.alias("c"), call_id.alias("call_id"), r.alias("r"))
    types = {f.name: f.dataType for f in MESSAGE.fields}
    no_call = F.lit(None).cast(types["content"].elementType["tool_call"].dataType)
    no_result = F.lit(None).cast("struct<is_error:boolean,chars:bigint>")
    calls = F.filter(F.transform("m.content", lambda p, i: F.when(p["type"] == "tool_call", item(i, p["tool_call"], p["tool_call"]["id"], no_result))), lambda x: x.isNotNull())
    results = F.transform("m.tool_results", lambda r, i: item(i, no_call, r["tool_call_id"], F.struct(F.coalesce(r["is_error"], F.lit(False)).alias("is_error"), chars(r).alias("chars"))))
    # calls of one id stand for their first: filtering must not promote a later one
    inside = F.lit(True) if since is None else F.col("m.ts_ms") >= since
    said = t.where("m.role in ('assistant', 'tool')").select(*scope, "conversation", "_seq", F.col("m.ts_ms").alias("ts_ms"), F.col("m.model").alias("model"), F.col("m.provider").alias("provider"), inside.alias("_in"), F.explode(F.when(F.col("m.role") == "tool", results).otherwise(calls)).alias("x"))
    met = said.select(*scope, "_in", "ts_ms", "model", "provider", F.when(F.col("x.r").isNull(), F.col("conversation")).alias("conversation"), "x.c", "x.call_id", "x.r", F.struct("_seq", F.col("x.part").alias("_part")).alias("pos"))
    own = Window.partitionBy(*scope, "call_id").orderBy(F.col("r").isNotNull(), "pos")  # calls come before results
    last = F.last("r").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    paired = met.withColumn("_n", F.row_number().over(own)).withColumn("_last", F.when(F.col("call_id").isNotNull(), last))
    rows = paired.where("_n = 1 and r is null and _in").select("*", F.col("_last.is_error").alias("is_error"), F.col("_last.chars").alias("chars"))
    return rows.select(
        *scope, F.col("pos").alias("_pos"), "conversation.source", F.col("conversation.source_version").alias("sourceVersion"), "conversation.cwd", F.col("conversation.git.branch").alias("gitBranch"),
        F.col("conversation.conversation_id").alias("threadId"), F.col("ts_ms").alias("timestamp"), "model", "provider", F.col("call_id").alias("toolCallId"), F.col("c.name").alias("tool"),
        F.col("c.arguments").alias("arguments"), F.col("c.parsed_arguments").alias("parsedArguments"), F.col("c.derived").alias("derived"), F.col("is_error").alias("isError"), F.col("chars").alias("resultChars"),
    )


def rows_jsonl(rows: DataFrame) -> DataFrame:
    """rows with line: a JSON object a row; absent values have no key, arguments that were parsed are objects."""
    plain = F.to_json(F.struct(*(F.col(c) for c in COLUMNS[:11])))
    inner = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f',"{c}":'), F.col(c))).otherwise("")
    tail = F.to_json(F.struct("isError", "resultChars"))
    tail = F.when(F.col("isError").isNotNull(), F.concat(F.lit(","), F.substring(tail, F.lit(2), F.length(tail) - 2))).otherwise("")
    return rows.withColumn("line", F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), inner("parsedArguments"), inner("derived"), tail, F.lit("}")))


def csv_cell(c: Column) -> Column:
    """Quoted where it holds a quote, comma or line break; empty for null. Nothing else is escaped."""
    text = c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.isNull(), "").when(text.rlike('[",\n\r]'), quoted).otherwise(text)


def command() -> Column:
    """The first derived command, else the command among the arguments (a list is joined by spaces)."""
    given = F.get_json_object("parsedArguments", "$.command")
    is_text = F.schema_of_variant(F.try_variant_get(F.try_parse_json("parsedArguments"), "$.command", "variant")) == "STRING"
    items = F.from_json(given, "array<string>")
    return F.coalesce(F.get_json_object("derived", "$.codexExec.commands[0]"), F.when(is_text, given), F.when(F.startswith(given, F.lit("[")), F.array_join(items, " ")))


def rows_csv(rows: DataFrame) -> DataFrame:
    """rows with line: CSV_COLUMNS as one CSV record, which may hold line breaks. csv_header() is its header."""
    lifted = rows.withColumn("operation", F.get_json_object("derived", "$.codexExec.operation")).withColumn("command", command())
    return lifted.withColumn("line", F.concat_ws(",", *(csv_cell(F.col(c)) for c in CSV_COLUMNS))).select(*rows.columns, "line")


def csv_header() -> str:
    return ",".join(CSV_COLUMNS)
