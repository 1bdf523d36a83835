"""The engine's operators over the driver's tables, by name, and SQL that gives the same rows.

The tables hold no transcripts. Queries derive canonical rows from events and conversations, or write transcripts
in each source format from them, import those again and compare with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.columns import iso, json_text
from colloquy.operators import inspect as summaries
from colloquy.operators import sequence
from colloquy.operators import tool_calls as calls
from colloquy.operators.usage import DIMENSIONS, UsageFold, usage
from colloquy.plans import export
from colloquy.schema import CANONICAL, CONVERSATION_DDL, MESSAGE_DDL
from colloquy.shared import new_folder
from colloquy.sources import scan
from colloquy.sources.detect import FORMATS
from colloquy.streaming import importer as streaming

#: Times that synthesized transcripts carry: one second a turn from here on.
BASE_MS = 1_700_000_000_000


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- usage ----------------------------------------------------------------------------------------------------


def usage_messages(spark: SparkSession, sf_dir: str, thinking: bool = False) -> DataFrame:
    """Events as assistant messages; errors report no usage, and every seventh event is in a second file too."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("us"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    usage_of = F.struct(
        (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 77).alias("output_tokens"), F.when((F.col("event_id") % 3 == 0) & F.lit(thinking), F.col("event_id") % 11).alias("reasoning_tokens"),
        F.when(F.col("event_id") % 2 == 0, F.col("k")).alias("cache_read_tokens"), F.when(F.col("event_id") % 5 == 0, F.lit(3).cast("long")).alias("cache_write_tokens"),
    )
    m = e.select(
        F.col("user_id").cast("string").alias("conversation_id"), F.when(F.col("k") % 4 > 0, F.concat(F.lit("s"), (F.col("k") % 4).cast("string"))).alias("source"), F.col("event_id").cast("string").alias("message_id"),
        F.lit("assistant").alias("role"), F.floor(F.col("us") / 1000).cast("long").alias("ts_ms"), F.when(F.col("event_type") != "purchase", F.col("event_type")).alias("model"),
        F.when(F.col("event_type") != "error", usage_of).alias("usage"), F.lit(0).alias("file_ord"), F.lit(0).alias("conversation_ord"), F.col("event_id").alias("seq"),
    )
    again = m.where("seq % 7 = 0").withColumn("file_ord", F.lit(1)).withColumn("model", F.when(F.col("seq") % 14 == 0, F.lit("other")).otherwise(F.col("model")))
    return m.unionByName(again)


_USAGE_SQL = """
with e as (select event_id, user_id, event_type, epoch_us(ts) // 1000 as ts_ms, cast(json_extract_string(props, '$.k') as bigint) as k from events),
m as (select cast(user_id as varchar) as conv, case when k % 4 > 0 then 's' || cast(k % 4 as varchar) end as source, event_id, ts_ms, case when event_type <> 'purchase' then event_type end as model, event_type <> 'error' as has,
    event_id % 1000 as i, event_id % 77 as o, case when {thinking} and event_id % 3 = 0 then event_id % 11 end as r, case when event_id % 2 = 0 then k end as cr, case when event_id % 5 = 0 then 3 end as cw, 0 as f from e),
a as (select * from m union all select conv, source, event_id, ts_ms, case when event_id % 14 = 0 then 'other' else model end, has, i, o, r, cr, cw, 1 from m where event_id % 7 = 0),
d as (select *, {key} as key, row_number() over (partition by conv, event_id order by f) = 1 as fst from a where ts_ms >= {since})
select key, count(*) filter (fst and has) as messages, count(*) filter (fst and not has) as messages_without_usage, cast(coalesce(sum(i) filter (fst and has), 0) as bigint) as input_tokens, cast(coalesce(sum(o) filter (fst and has), 0) as bigint) as output_tokens,
  cast(coalesce(sum(cr) filter (fst and has), 0) as bigint) as cache_read_tokens, cast(coalesce(sum(cw) filter (fst and has), 0) as bigint) as cache_write_tokens, cast(sum(r) filter (fst and has) as bigint) as reasoning_tokens,
  nullif(count(r) filter (fst and has), 0) as reasoning_messages, count(*) filter (not fst) as duplicates_skipped
from d group by key
"""
_KEYS = {"model": "coalesce(model, 'unknown')", "day": "strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d')", "conversation": "conv", "source": "coalesce(source, '(no source)')"}
SINCE = 1_705_000_000_000


def _usage_query(by: str, since: int | None = None, thinking: bool = False):
    return lambda spark, sf_dir: usage(usage_messages(spark, sf_dir, thinking), by, since)


def _usage_sql(by: str, since: int = 0, thinking: bool = False) -> str:
    return _USAGE_SQL.format(key=_KEYS[by], since=since, thinking=str(thinking).lower())


# --- tool calls -----------------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are calls and views are results of the calls of the same user that have the same k."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props", F.get_json_object("props", "$.k").alias("call_id"))
    c = e.where("event_type = 'click'").select("user_id", "call_id", F.col("event_id").alias("pos"), "props")
    r = e.where("event_type = 'view'").select("user_id", "call_id", F.col("event_id").alias("pos"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3 == 1).alias("is_error"), (F.col("event_id") % 1000).alias("chars"))
    return calls.pair(c, r, ["user_id"])


_PAIRS_SQL = """
with e as (select event_id, user_id, event_type, props, json_extract_string(props, '$.k') as call_id from events),
c as (select user_id, call_id, event_id as pos, props, row_number() over (partition by user_id, call_id order by event_id) as n from e where event_type = 'click'),
r as (select user_id, call_id, coalesce(case when event_id % 3 > 0 then event_id % 3 = 1 end, false) as is_error, event_id % 1000 as chars, row_number() over (partition by user_id, call_id order by event_id desc) as n from e where event_type = 'view'),
p as (select c.user_id, c.call_id, c.pos, c.props, r.is_error, r.chars from c left join r on c.user_id = r.user_id and c.call_id = r.call_id and r.n = 1 where c.n = 1)
"""


def tool_call_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def tool_call_rows_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ["user_id", "call_id", "props", "is_error", "chars"]
    return _pairs(spark, sf_dir).select("pos", F.concat_ws(",", *(calls.csv_cell(F.col(c)) for c in cells)).alias("line"))


def tool_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.groupBy("call_id").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if("is_error").alias("n_errors"), F.count_if(F.col("is_error").isNull()).alias("n_unpaired"), F.sum("chars").cast("long").alias("chars"))


# --- conversations --------------------------------------------------------------------------------------------


def repeated_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table with every third turn spoken by the user, so that turns of one role meet."""
    return _t(spark, sf_dir, "conversations").withColumn("role", F.when((F.col("turn") % 3 == 1) & (F.col("role") != "system"), "user").otherwise(F.col("role")))


_REPEATED_SQL = "(select conv_id, turn, case when turn % 3 = 1 and role <> 'system' then 'user' else role end as role, text from conversations)"


def conversations(spark: SparkSession, sf_dir: str, table: DataFrame | None = None) -> DataFrame:
    """The conversations table, or one like it, as imported conversations: no transcript in between."""
    c = _t(spark, sf_dir, "conversations") if table is None else table
    part = F.from_json(F.concat(F.lit('{"type":"text","text":'), json_text(F.col("text")), F.lit("}")), MESSAGE_DDL.split("content:array<", 1)[1].split(">,tool_results", 1)[0])
    m = F.from_json(F.lit("{}"), MESSAGE_DDL)
    for name, value in (("message_id", F.col("turn").cast("string")), ("conversation_id", F.col("conv_id").cast("string")), ("role", F.col("role")), ("ts_ms", F.lit(BASE_MS) + F.col("turn") * 1000), ("model", F.when(F.col("role") == "assistant", "m1")), ("content", F.array(part))):
        m = m.withField(name, value)
    rows = c.select("conv_id", F.struct("turn", m.alias("m")).alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    t = F.from_json(F.lit("{}"), CONVERSATION_DDL)
    first, last = F.get("messages", F.lit(0))["ts_ms"], F.element_at("messages", -1)["ts_ms"]
    rows = rows.select(F.col("conv_id").cast("string").alias("file"), F.lit(0).alias("file_ord"), F.lit("table").alias("format"), F.lit("ok").alias("status"), F.lit(0).alias("conversation_ord"), F.transform("xs", lambda x: x["m"]).alias("messages"))
    return rows.withColumn("conversation", t.withField("conversation_id", F.col("file")).withField("source", F.lit("table")).withField("created_at", first).withField("updated_at", last))


def inspect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summaries.summaries(conversations(spark, sf_dir))
    n = lambda role: F.coalesce(F.get(F.filter("by_role", lambda r: r["role"] == role), F.lit(0))["n"], F.lit(0)).alias(f"n_{role}")
    return s.select("conversation_id", "messages", n("user"), n("assistant"), n("system"), "tool_calls", "preview", "created", "updated")


_INSPECT_SQL = f"""
select cast(conv_id as varchar) as conversation_id, count(*) as messages, count(*) filter (role = 'user') as n_user, count(*) filter (role = 'assistant') as n_assistant, count(*) filter (role = 'system') as n_system,
  cast(0 as bigint) as tool_calls, nullif(substr(replace(arg_min(text, turn) filter (role = 'user'), chr(10), ' '), 1, 100), '') as preview,
  strftime(make_timestamp(({BASE_MS} + min(turn) * 1000) * 1000), '%Y-%m-%dT%H:%M:%S.000Z') as created, strftime(make_timestamp(({BASE_MS} + max(turn) * 1000) * 1000), '%Y-%m-%dT%H:%M:%S.000Z') as updated
from conversations group by conv_id
"""


def _export_query(form: str):
    merging = form in ("anthropic-messages", "gemini")
    return lambda spark, sf_dir: export.export(conversations(spark, sf_dir, repeated_roles(spark, sf_dir) if merging else None), form).select("conversation_id", "body")


_MERGED_SQL = """
with c as (select conv_id, turn, case when role = 'assistant' then '{other}' else 'user' end as role, text, row_number() over (partition by conv_id order by turn) as n from {table} where role <> 'system'{nonempty}),
b as (select *, coalesce(lag(role) over (partition by conv_id order by turn) <> role, true) as begins from c),
i as (select *, sum(cast(begins as int)) over (partition by conv_id order by turn) as island from b),
t as (select conv_id, island, any_value(role) as role, string_agg('{before}' || to_json(text) || '}}', ',' order by turn) as parts from i group by conv_id, island),
m as (select conv_id, string_agg('{{"role":"' || role || '","{key}":[' || parts || ']}}', ',' order by island) as body from t group by conv_id),
s as (select conv_id, string_agg(text, chr(10) || chr(10) order by turn) filter (role = 'system' and text <> '') as system from conversations group by conv_id)
select cast(s.conv_id as varchar) as conversation_id, '{{' || coalesce({system} || ',', '') || '"{name}":[' || coalesce(body, '') || ']}}' as body from s left join m using (conv_id)
"""
_ANTHROPIC_SQL = _MERGED_SQL.format(table=_REPEATED_SQL, other="assistant", nonempty=" and text <> ''", before='{"type":"text","text":', key="content", system="""'"system":' || to_json(system)""", name="messages")
_GEMINI_SQL = _MERGED_SQL.format(table=_REPEATED_SQL, other="model", nonempty="", before='{"text":', key="parts", system="""'"systemInstruction":{"parts":[{"text":' || to_json(system) || '}]}'""", name="contents")
_OPENAI_SQL = """
select cast(conv_id as varchar) as conversation_id, '[' || coalesce(string_agg('{"role":"' || role || '","content":' || to_json(text) || '}', ',' order by turn) filter (text <> ''), '') || ']' as body from conversations group by conv_id
"""
_CANONICAL_SQL = f"""
select cast(conv_id as varchar) as conversation_id, '{{"schemaVersion":"1.1.0","id":"' || conv_id || '","messages":[' || string_agg('{{"id":"' || turn || '","threadId":"' || conv_id || '","role":"' || role || '","timestamp":' || ({BASE_MS} + turn * 1000) || ',"content":[{{"type":"text","text":' || to_json(text) || '}}]' || case when role = 'assistant' then ',"model":"m1"' else '' end || '}}', ',' order by turn)
  || '],"metadata":{{"source":"table"}},"createdAt":' || ({BASE_MS} + min(turn) * 1000) || ',"updatedAt":' || ({BASE_MS} + max(turn) * 1000) || '}}' as body
from conversations group by conv_id
"""
_ISO_SQL = "strftime(make_timestamp(({} * 1000 + %d) * 1000), '%%Y-%%m-%%dT%%H:%%M:%%S.000Z')" % BASE_MS
_MARKDOWN_SQL = f"""
select cast(conv_id as varchar) as conversation_id, '---' || chr(10) || 'title: "Thread ' || conv_id || '"' || chr(10) || 'id: "' || conv_id || '"' || chr(10) || 'created: ' || {_ISO_SQL.format("min(turn)")} || chr(10) || 'updated: ' || {_ISO_SQL.format("max(turn)")} || chr(10) || 'source: "table"' || chr(10) || '---' || chr(10) || chr(10)
  || string_agg('## ' || case role when 'user' then 'User' when 'system' then 'System' else 'Assistant (m1)' end || ' — ' || {_ISO_SQL.format("turn")} || chr(10) || chr(10) || text || chr(10), chr(10) order by turn) as body
from conversations group by conv_id
"""


def system_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir)
    return c.select(F.col("file").alias("conversation_id"), export.system_prompt(F.col("messages")).alias("system"))


_SYSTEM_SQL = "select cast(conv_id as varchar) as conversation_id, string_agg(text, chr(10) || chr(10) order by turn) filter (role = 'system' and text <> '') as system from conversations group by conv_id"


def role_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = repeated_roles(spark, sf_dir).where("role <> 'system'")
    i = sequence.islands(c, "role", ["conv_id"], ["turn"])
    return i.groupBy("conv_id", "island").agg(F.first("role").alias("role"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))


_ISLAND_SQL = f"""
with b as (select *, coalesce(lag(role) over (partition by conv_id order by turn) <> role, true) as begins from {_REPEATED_SQL} where role <> 'system'),
i as (select *, cast(sum(cast(begins as int)) over (partition by conv_id order by turn) as bigint) as island from b)
select conv_id, island, any_value(role) as role, count(*) as n, string_agg(text, chr(10) order by turn) as text from i group by conv_id, island
"""


# --- sequences ------------------------------------------------------------------------------------------------


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return e.withColumn("v", F.when(F.col("event_id") % 5 == 2, F.col("event_id") * 10)).withColumn("model", F.when(F.col("event_id") % 7 == 3, F.col("event_type")))


def ts_fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gappy(spark, sf_dir).select("event_id", sequence.fill_forward("v", ["user_id"], ["event_id"]).alias("v"), sequence.as_of("v", ["user_id"], ["event_id"]).alias("v_before"))


def model_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gappy(spark, sf_dir).select("event_id", sequence.fill_leading("model", ["user_id"], ["event_id"]).alias("model"))


def consumed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").where("event_type in ('click', 'view')").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"), F.col("event_id").cast("string").alias("name"))
    name = sequence.consumed(e, "k", F.col("event_type") == "click", "name", ["user_id"], ["event_id"])
    return e.select("event_id", "event_type", name.alias("name")).where("event_type = 'view'").select("event_id", F.coalesce("name", F.lit("")).alias("name"))


_SEQUENCE_SQL = {
    "ts_fill_forward": """select event_id, last_value(v ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as v,
  last_value(v ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as v_before from (select *, case when event_id % 5 = 2 then event_id * 10 end as v from events)""",
    "model_backfill": """select event_id, case when seen is null then nxt else model end as model from (select event_id, model, last_value(model ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as seen,
  first_value(model ignore nulls) over (partition by user_id order by event_id rows between current row and unbounded following) as nxt from (select *, case when event_id % 7 = 3 then event_type end as model from events))""",
    "consumed_names": """with e as (select event_id, event_type, lag(event_type) over w as before, lag(event_id) over w as id from (select *, json_extract_string(props, '$.k') as k from events where event_type in ('click', 'view')) window w as (partition by user_id, k order by event_id))
select event_id, case when before = 'click' then cast(id as varchar) else '' end as name from e where event_type = 'view'""",
}


# --- transcripts written and read again -------------------------------------------------------------------------


def _iso_of_turn() -> Column:
    return iso(F.lit(BASE_MS) + F.col("turn") * 1000)


def _doc(df: DataFrame, line: Column, head: Column | None = None, join: str = "\n", wrap: tuple[str, str] = ("", "")) -> DataFrame:
    """(file, file_ord, content): the lines of a conversation's turns in order."""
    rows = df.select("conv_id", F.struct("turn", line.alias("line")).alias("x")).groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list("x"))["line"], join).alias("body"))
    body = F.concat(F.lit(wrap[0]), F.col("body"), F.lit(wrap[1]))
    if head is not None:
        body = F.concat(head, body)
    return rows.select(F.concat(F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file"), F.lit(0).alias("file_ord"), body.alias("content"))


def _cat(*xs) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))


def transcripts(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """Every conversation as a transcript of one format, with its system turns where the format has such."""
    c = _t(spark, sf_dir, "conversations")
    c = c if form in WITH_SYSTEM else c.where("role <> 'system'")
    text, conv, turn, role = json_text(F.col("text")), F.col("conv_id"), F.col("turn"), F.col("role")
    ms = F.lit(BASE_MS) + turn * 1000
    assistant = role == "assistant"
    if form == "claude-code":
        return _doc(c, _cat('{"type":"', role, '","uuid":"u', turn, '","sessionId":"', conv, '","timestamp":"', _iso_of_turn(), '","message":{"role":"', role, '","content":[{"type":"text","text":', text, "}]}}"))
    if form == "codex":
        kind = F.when(assistant, "output_text").otherwise("input_text")
        line = _cat('{"timestamp":"', _iso_of_turn(), '","type":"response_item","payload":{"type":"message","role":"', role, '","content":[{"type":"', kind, '","text":', text, "}]}}")
        counts = _cat('\n{"timestamp":"', _iso_of_turn(), '","type":"event_msg","payload":{"type":"token_count","info":{"last_token_usage":{"input_tokens":', turn + 10, ',"cached_input_tokens":4,"output_tokens":', turn, "}}}}")
        return _doc(c, F.concat(line, F.when(assistant, counts).otherwise("")), head=_cat('{"type":"session_meta","payload":{"id":"', conv, '","cwd":"/w"}}\n{"type":"turn_context","payload":{"model":"m1"}}\n'))
    if form == "opencode":
        line = _cat('{"info":{"id":"u', turn, '","role":"', role, '","time":{"created":', ms, '}},"parts":[{"type":"text","text":', text, "}]}")
        return _doc(c, line, head=_cat('{"info":{"id":"', conv, '"},"messages":['), join=",", wrap=("", "]}"))
    if form == "kiro":
        prompt = _cat('{"version":"v1","kind":"Prompt","data":{"message_id":"u', turn, '","meta":{"timestamp":', (F.lit(BASE_MS) + turn * 1000) / 1000, '},"content":[{"kind":"text","data":', text, "}]}}")
        reply = _cat('{"version":"v1","kind":"AssistantMessage","data":{"message_id":"u', turn, '","content":[{"kind":"text","data":', text, "}]}}")
        return _doc(c, F.when(assistant, reply).otherwise(prompt))
    if form == "pi":
        line = _cat('{"type":"message","id":"u', turn, '","parentId":null,"timestamp":', ms, ',"message":{"role":"', role, '","content":[{"type":"text","text":', text, "}]}}")
        return _doc(c, line, head=_cat('{"type":"session","id":"', conv, '","cwd":"/w","version":3}\n'))
    if form == "muse":
        event = lambda i, body: _cat('{"kind":"record","envelope":{"id":"u', turn, i, '","recorded_at":', ms * 1000, ',"payload_type":"run","payload":{"kind":"run","event":', body, "}}}")
        ask = event("", _cat('{"kind":"started","prompt":', text, "}"))
        reply = F.concat(event("c", _cat('{"kind":"model_response_created","response_id":"u', turn, '"}')), F.lit(","), event("m", _cat('{"kind":"assistant_message_committed","text":', text, "}")))
        return _doc(c, F.when(assistant, reply).otherwise(ask), head=_cat('{"export_schema_version":1,"sessions":[{"session_id":"', conv, '"}],"events":['), join=",", wrap=("", "]}"))
    if form == "chatgpt-export":
        node = _cat('"n', turn, '":{"id":"n', turn, '","parent":"', F.coalesce(F.concat(F.lit("n"), F.lag("turn").over(_by_conv()).cast("string")), F.lit("root")), '","children":[],"message":{"id":"u', turn, '","author":{"role":"', role, '"},"create_time":', ms / 1000, ',"content":{"content_type":"text","parts":[', text, "]}}}")
        last = F.max("turn").over(_by_conv().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        # a branch that was left, and a root without a message
        left = F.when(turn == last, _cat(',"x":{"parent":"n', turn, '","children":[],"message":{"id":"x","author":{"role":"user"},"content":{"content_type":"text","parts":["left"]}}},"root":{"parent":null,"children":[]}},"current_node":"n', turn, '"}')).otherwise("")
        c = c.withColumn("_line", F.concat(node, left))
        return _doc(c, F.col("_line"), head=_cat('{"id":"', conv, '","mapping":{'), join=",")
    return export.export(conversations(spark, sf_dir), CANONICAL).select(F.concat("conversation_id", F.lit(".json")).alias("file"), F.lit(0).alias("file_ord"), F.col("body").alias("content"))


def _by_conv():
    return Window.partitionBy("conv_id").orderBy("turn")


#: Formats whose transcripts can hold system turns.
WITH_SYSTEM = ("codex", "chatgpt-export", CANONICAL)


def _name(form: str) -> str:
    return "canonical" if form == CANONICAL else form.replace("-", "_")


def _import_query(form: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = scan.messages(scan.import_docs(transcripts(spark, sf_dir, form), "auto", now_ms=0))
        text = F.array_join(F.transform("content", lambda p: p["text"]), "\n")
        return m.select("conversation_id", F.col("seq").cast("long").alias("seq"), "role", "ts_ms", text.alias("text"), F.col("usage.input_tokens").alias("input_tokens"), F.col("usage.output_tokens").alias("output_tokens"))

    return query


def _import_sql(form: str) -> str:
    # only prompts carry a time there; what follows inherits it
    ts = f"{BASE_MS} + max(case when role = 'user' then turn end) over (partition by conv_id order by turn rows unbounded preceding) * 1000" if form == "kiro" else f"{BASE_MS} + turn * 1000"
    usage = ("case when role = 'assistant' then turn + 6 end", "case when role = 'assistant' then turn end") if form == "codex" else ("cast(null as bigint)", "cast(null as bigint)")
    return f"select cast(conv_id as varchar) as conversation_id, row_number() over (partition by conv_id order by turn) - 1 as seq, role, {ts} as ts_ms, text, {usage[0]} as input_tokens, {usage[1]} as output_tokens from conversations" + ("" if form in WITH_SYSTEM else " where role <> 'system'")


def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation written in every format; the name of its file says which."""
    docs = None
    for form in FORMATS:
        part = transcripts(spark, sf_dir, form).withColumn("file", F.concat(F.lit(form + "/"), F.substring_index("file", ".", 1)))
        docs = part if docs is None else docs.unionByName(part)
    return scan.detect_formats(docs).select(F.substring_index("file", "/", -1).cast("long").alias("conv_id"), F.substring_index("file", "/", 1).alias("written"), "format")


_DETECT_SQL = "select conv_id, form as written, form as format from (select conv_id, bool_or(role <> 'system') as spoken, unnest([" + ", ".join(f"'{f}'" for f in FORMATS) + "]) as form from conversations group by conv_id) where spoken or form in (" + ", ".join(f"'{f}'" for f in WITH_SYSTEM) + ")"


def claude_merge_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn written as two lines that share a message id; usage stands on the first, corrected on the second."""
    c = _t(spark, sf_dir, "conversations").where("role = 'assistant'")
    half = F.ceil(F.length("text") / 2).cast("int")
    line = lambda body, n: _cat('{"type":"assistant","sessionId":"', F.col("conv_id"), '","message":{"role":"assistant","id":"a', F.col("turn"), '","content":[{"type":"text","text":', json_text(body), '}],"usage":{"input_tokens":', F.col("turn"), ',"output_tokens":', F.lit(n), "}}}")
    docs = _doc(c, F.concat(line(F.substring("text", F.lit(1), half), 1), F.lit("\n"), line(F.substring(F.col("text"), half + 1, F.length("text")), 2)))
    m = scan.messages(scan.import_docs(docs, "claude-code", now_ms=1))
    return m.select("conversation_id", "message_id", F.array_join(F.transform("content", lambda p: p["text"]), "").alias("text"), F.size("content").cast("long").alias("n_parts"), F.col("usage.output_tokens").alias("output_tokens"))


_SPLIT_SQL = "select cast(conv_id as varchar) as conversation_id, 'a' || turn as message_id, text, cast(2 as bigint) as n_parts, cast(2 as bigint) as output_tokens from conversations where role = 'assistant'"


def codex_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every import of the transcripts rolled up by the usage operator."""
    m = scan.messages(scan.import_docs(transcripts(spark, sf_dir, "codex"), "codex", now_ms=0))
    return usage(m, "model").select("key", "messages", "messages_without_usage", "input_tokens", "output_tokens", "cache_read_tokens", "duplicates_skipped")


_ATTRIBUTION_SQL = "select 'm1' as key, count(*) as messages, cast(0 as bigint) as messages_without_usage, cast(sum(turn + 6) as bigint) as input_tokens, cast(sum(turn) as bigint) as output_tokens, cast(sum(4) as bigint) as cache_read_tokens, cast(0 as bigint) as duplicates_skipped from conversations where role = 'assistant' having count(*) > 0"


def chatgpt_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk up the tree as an operator: each turn's parent is the turn before it, and odd turns have a side branch."""
    c = _t(spark, sf_dir, "conversations")
    node = lambda t: F.concat(F.lit("n"), t.cast("string"))
    main = c.select("conv_id", node(F.col("turn")).alias("node"), node(F.lag("turn").over(_by_conv())).alias("parent"))
    side = c.where("turn % 2 = 1").select("conv_id", F.concat(F.lit("x"), F.col("turn").cast("string")).alias("node"), node(F.col("turn")).alias("parent"))
    leaves = c.groupBy("conv_id").agg(node(F.max("turn")).alias("node"))
    return sequence.path_to_root(main.unionByName(side), leaves, "conv_id").select("conv_id", "node", F.col("depth").cast("long").alias("depth"))


_PATH_SQL = "select conv_id, 'n' || turn as node, row_number() over (partition by conv_id order by turn desc) - 1 as depth from conversations"


def derive_exec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs that run a shell command each, read off their text."""
    e = _t(spark, sf_dir, "events").where("event_type = 'click'")
    program = _cat("const r = await tools.", F.when(F.col("event_id") % 2 == 0, "exec_command").otherwise("write_stdin"), '({cmd: "run ', F.col("event_id"), '"});')
    line = _cat('{"type":"response_item","payload":{"type":"custom_tool_call","name":"exec","call_id":"c', F.col("event_id"), '","input":', json_text(program), "}}")
    rows = e.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), line.alias("line"))
    imported = scan.import_docs(_doc(rows, F.col("line")), "codex", now_ms=1)
    t = calls.tool_call_rows(imported).withColumn("operation", F.get_json_object("derived", "$.codexExec.operation")).withColumn("command", calls.command())
    return t.select(F.substring(F.col("toolCallId"), F.lit(2), F.lit(20)).cast("long").alias("event_id"), "tool", "operation", "command")


_EXEC_SQL = "select event_id, 'exec' as tool, case when event_id % 2 = 0 then 'exec_command' else 'write_stdin' end as operation, 'run ' || event_id as command from events where event_type = 'click'"


# --- transcripts with tool calls ----------------------------------------------------------------------------------


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as turns of one session a user, with the click that comes last before each."""
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), "event_type")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.withColumn("call", F.coalesce(F.concat(F.lit("c"), F.max(F.when(F.col("event_type") == "click", F.col("turn"))).over(before).cast("string")), F.lit("none")))


def tool_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claude Code sessions: clicks think, speak and call; views are results with an image and a word of the user;
    errors are sidechains; the rest are prompts."""
    turn, kind = F.col("turn"), F.col("event_type")
    line = lambda role, body, *rest: _cat(f'{{"type":"{role}","sessionId":"', F.col("conv_id"), '"', *rest, f',"message":{{"role":"{role}",', *body, "}}")
    calls_ = line("assistant", ('"id":"a', turn, '","usage":{"input_tokens":', turn % 100, ',"output_tokens":2},"content":[{"type":"thinking","thinking":"t', turn, '","signature":"g"},{"type":"text","text":"x', turn, '"},{"type":"tool_use","id":"c', turn, '","name":"Run","input":{"n":', turn, "}}]"))
    gave = line("user", ('"content":[{"type":"tool_result","tool_use_id":"', F.col("call"), '","is_error":', F.when(turn % 2 == 0, "true").otherwise("false"), ',"content":[{"type":"text","text":"r', turn, '"},{"type":"image","source":{"type":"base64","media_type":"image/gif","data":"AAAA"}}]},{"type":"text","text":"u', turn, '"}]'))
    asked = line("user", ('"content":"p', turn, '"'), F.when(kind == "error", ',"isSidechain":true').otherwise(""))
    return _doc(_sessions(spark, sf_dir), F.when(kind == "click", calls_).when(kind == "view", gave).otherwise(asked))


_SESSIONS_SQL = """
with e as (select cast(user_id as varchar) as conv, event_id, event_type, max(case when event_type = 'click' then event_id end) over (partition by user_id order by event_id rows unbounded preceding) as click from events),
v as (select *, coalesce('c' || click, 'none') as call_id, row_number() over (partition by conv, event_type, click order by event_id) as nth from e),
"""
_TOOLS_SQL = _SESSIONS_SQL + """
m as (
  select conv, event_id, 0 as sub, 'assistant' as role, 'reasoning,text,tool_call' as kinds, 't' || event_id as thought, 'x' || event_id as text, 'c' || event_id as call_id, 'Run' as tool, '{"n":' || event_id || '}' as arguments, null as is_error, event_id % 100 as input_tokens from v where event_type = 'click'
  union all select conv, event_id, 0, 'tool', 'text,image', null, 'r' || event_id, call_id, case when nth = 1 and click is not null then 'Run' else '' end, null, event_id % 2 = 0, null from v where event_type = 'view'
  union all select conv, event_id, 1, 'user', 'text', null, 'u' || event_id, null, null, null, null, null from v where event_type = 'view'
  union all select conv, event_id, 0, 'user', 'text', null, 'p' || event_id, null, null, null, null, null from v where event_type not in ('click', 'view', 'error'))
"""


def import_tools(spark: SparkSession, sf_dir: str, form: str = "claude-code", docs=tool_transcripts) -> DataFrame:
    """Messages with calls, results, images, reasoning and usage, a row each."""
    m = scan.messages(scan.import_docs(docs(spark, sf_dir), form, now_ms=1))
    parts = F.coalesce(F.get("tool_results", F.lit(0))["content"], F.col("content"))
    joined = lambda c: F.nullif(F.array_join(c, ","), F.lit(""))
    call = F.get(F.filter("content", lambda p: p["type"] == "tool_call"), F.lit(0))["tool_call"]
    given = F.get("tool_results", F.lit(0))
    return m.select(
        "conversation_id", F.col("seq").cast("long").alias("seq"), "role", joined(F.transform(parts, lambda p: p["type"])).alias("kinds"), joined(F.transform(parts, lambda p: p["reasoning"]["text"])).alias("thought"), joined(F.transform(parts, lambda p: p["text"])).alias("text"),
        F.coalesce(call["id"], given["tool_call_id"]).alias("call_id"), F.coalesce(call["name"], given["name"]).alias("tool"), call["arguments"].alias("arguments"), given["is_error"].alias("is_error"), F.col("usage.input_tokens").alias("input_tokens"),
    )


_IMPORT_TOOLS_SQL = _TOOLS_SQL + "select conv as conversation_id, row_number() over (partition by conv order by event_id, sub) - 1 as seq, role, kinds, thought, text, call_id, tool, arguments, is_error, input_tokens from m"


def codex_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts: clicks reason, run programs of two tools and report tokens twice; views are outputs; the rest are
    prompts with an image. Errors are not written."""
    turn, kind = F.col("turn"), F.col("event_type")
    item = lambda *body: _cat('{"type":"response_item","payload":{', *body, "}}")
    spent = lambda i, cached, o: _cat('{"type":"event_msg","payload":{"type":"token_count","info":{"last_token_usage":{"input_tokens":', i, f',"cached_input_tokens":{cached},"output_tokens":{o}}}}}}}}}')
    program = _cat('await tools.write_stdin({cmd: "run ', turn, """"}); tools.exec_command({'cmd': `two`, "cmd": `${x}`})""")
    ran = F.concat_ws("\n", item('"type":"reasoning","summary":[{"text":"t', turn, '"}]'), item('"type":"custom_tool_call","name":"exec","call_id":"c', turn, '","input":', json_text(program)), spent(turn % 100 + 10, 4, 1), spent(F.lit(7), 0, 3))
    gave = item('"type":"custom_tool_call_output","call_id":"', F.col("call"), '","output":"r', turn, '"')
    asked = item('"type":"message","role":"user","content":[{"type":"input_text","text":"p', turn, '"},{"type":"input_image","image_url":"https://x/', turn, '"}]')
    rows = _sessions(spark, sf_dir).where(kind != "error")
    return _doc(rows, F.when(kind == "click", ran).when(kind == "view", gave).otherwise(asked), head=_cat('{"type":"session_meta","payload":{"id":"', F.col("conv_id"), '"}}\n'))


def import_codex_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_tools(spark, sf_dir, "codex", codex_transcripts).drop("arguments", "is_error")


# the second count of a message finds none without usage: it waits for the next, whose own first count is lost
_CODEX_TOOLS_SQL = _SESSIONS_SQL + """
c as (select *, row_number() over (partition by conv order by event_id) as n from v where event_type = 'click'),
m as (
  select conv, event_id, 'assistant' as role, 'reasoning,tool_call' as kinds, 't' || event_id as thought, null as text, 'c' || event_id as call_id, 'exec' as tool, case when n = 1 then event_id % 100 + 6 else 7 end as input_tokens from c
  union all select conv, event_id, 'tool', 'text', null, 'r' || event_id, call_id, case when nth = 1 and click is not null then 'exec' else '' end, null from v where event_type = 'view'
  union all select conv, event_id, 'user', 'text,image', null, 'p' || event_id, null, null, null from v where event_type not in ('click', 'view', 'error'))
select conv as conversation_id, row_number() over (partition by conv order by event_id) - 1 as seq, role, kinds, thought, text, call_id, tool, input_tokens from m
"""


def derive_exec_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs of two tools and three literals, one of them a template."""
    t = calls.tool_call_rows(scan.import_docs(codex_transcripts(spark, sf_dir), "codex", now_ms=1))
    derived = lambda path: F.get_json_object("derived", f"$.codexExec.{path}")
    return t.select(F.substring(F.col("toolCallId"), F.lit(2), F.lit(20)).cast("long").alias("event_id"), derived("operation").alias("operation"), derived("operations").alias("operations"), derived("commands").alias("commands"), calls.command().alias("command"), F.col("resultChars").cast("long").alias("chars"))


_MIXED_SQL = _SESSIONS_SQL + """
r as (select conv, click, max(event_id) as last from v where event_type = 'view' and click is not null group by conv, click)
select event_id, 'mixed' as operation, '["exec_command","write_stdin"]' as operations, '["run ' || event_id || '","two"]' as commands, 'run ' || event_id as command, cast(length('r' || last) as bigint) as chars
from e left join r on r.conv = e.conv and r.click = e.event_id where event_type = 'click'
"""


def export_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each format keeps of sessions with tools: how often its marks stand in a conversation's body."""
    found = scan.import_docs(tool_transcripts(spark, sf_dir), "claude-code", now_ms=1)
    marks = {
        "openai-chat": {"openai_calls": '"type":"function"', "openai_results": '"tool_call_id"', "openai_users": '{"role":"user"'},
        "anthropic-messages": {"thoughts": '"type":"thinking"', "uses": '"type":"tool_use"', "results": '"type":"tool_result"', "failed": '"is_error":true', "images": '"type":"image"'},
        "gemini": {"gemini_calls": '"functionCall"', "gemini_results": '"functionResponse":{"name":"Run"'},
        "markdown": {"folded": "<details>", "arrows": "**← Run result", "errors": "(error)**"},
        CANONICAL: {"canonical_calls": '"toolCall":', "canonical_thoughts": '"signature":"g"'},
    }
    n = lambda body, mark: ((F.length(body) - F.length(F.replace(body, F.lit(mark), F.lit("")))) / len(mark)).cast("long")
    bodies = export.exports(found, marks)  # all formats in one pass over what is imported: nothing is written, nothing joined
    return bodies.select("conversation_id", *(n(F.col(form), mark).alias(name) for form, names in marks.items() for name, mark in names.items()))


# a result without a name of its own takes the call's before it, if there is one
_EXPORT_TOOLS_SQL = _SESSIONS_SQL + """
k as (select conv, count(*) filter (event_type = 'click') as c, count(*) filter (event_type = 'view') as v, count(*) filter (event_type = 'view' and click is not null) as known, count(*) filter (event_type = 'view' and click is not null and nth = 1) as named,
  count(*) filter (event_type = 'view' and event_id % 2 = 0) as bad, count(*) filter (event_type not in ('click', 'view', 'error')) as p from v group by conv)
select conv as conversation_id, c as openai_calls, v as openai_results, v + p as openai_users, c as thoughts, c as uses, v as results, bad as failed, v as images, c as gemini_calls, known as gemini_results, c as folded, named as arrows, bad as errors, c as canonical_calls, c as canonical_thoughts
from k where c + v + p > 0
"""


# --- streams ------------------------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str, form: str, parts: int = 3) -> DataFrame:
    """Transcripts by lines through Structured Streaming, in several batches: what they changed."""
    folder = new_folder(spark, "stream")
    docs = transcripts(spark, sf_dir, form).select("file", F.split("content", "\n").alias("lines"))
    rows = docs.select("file", F.size("lines").alias("n"), F.posexplode(F.concat("lines", F.array(F.lit(None).cast("string")))).alias("line_no", "value"))
    for k in range(parts):  # the lines of a file arrive in order
        own = rows.where(F.floor(F.col("line_no") * parts / (F.col("n") + 1)) == k)
        own.select("file", F.col("line_no").cast("long").alias("line_no"), "value").repartition("file").write.parquet(f"{folder}/lines/{k}")
    lines = spark.readStream.schema("file string, line_no long, value string").option("recursiveFileLookup", "true").parquet(f"{folder}/lines")
    return streaming.import_stream(lines, form, folder)


def stream_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages that stand after the last line."""
    return streaming.upserts(_streamed(spark, sf_dir, "claude-code")).select("conversation_id", F.col("seq").cast("long").alias("seq"), "role", "ts_ms", F.array_join(F.transform("content", lambda p: p["text"]), "\n").alias("text"))


_STREAM_SQL = f"select cast(conv_id as varchar) as conversation_id, row_number() over (partition by conv_id order by turn) - 1 as seq, role, {BASE_MS} + turn * 1000 as ts_ms, text from conversations where role <> 'system'"


def stream_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations themselves, as the stream gives them."""
    return streaming.heads(_streamed(spark, sf_dir, "codex")).select("conversation_id", "source", "cwd", "created_at", "updated_at", F.size("warnings").cast("long").alias("n_warnings"))


_STREAM_HEADS_SQL = f"select cast(conv_id as varchar) as conversation_id, 'codex' as source, '/w' as cwd, {BASE_MS} + min(turn) * 1000 as created_at, {BASE_MS} + max(turn) * 1000 as updated_at, cast(0 as bigint) as n_warnings from conversations group by conv_id"


def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage folded batch by batch over a stream of messages: first those of one file, then copies in another."""
    folder = new_folder(spark, "usage")
    m = usage_messages(spark, sf_dir)
    for k in (0, 1):
        m.where(F.col("file_ord") == k).write.parquet(f"{folder}/messages/{k}")
    fold = UsageFold(spark, f"{folder}/fold")
    arriving = spark.readStream.schema(m.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 4).parquet(f"{folder}/messages")
    write = arriving.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    write.foreachBatch(lambda df, n: fold.add(df, n)).start().awaitTermination()
    return fold.result()


QUERIES = {
    **{f"usage_by_{d}": _usage_query(d) for d in DIMENSIONS},
    "usage_since": _usage_query("model", SINCE),
    "usage_reasoning_partial": _usage_query("source", None, True),
    "tool_call_rows": tool_call_rows,
    "tool_call_rows_csv": tool_call_rows_csv,
    "tool_error_rate": tool_error_rate,
    "inspect_summary": inspect_summary,
    **{f"import_{_name(f)}": _import_query(f) for f in FORMATS},
    "detect_format": detect_format,
    "claude_merge_split": claude_merge_split,
    "codex_token_attribution": codex_token_attribution,
    "chatgpt_path": chatgpt_path,
    **{f"export_{_name(f)}": _export_query(f) for f in export.FORMATS},
    "system_prompt": system_prompt,
    "role_merge": role_merge,
    "ts_fill_forward": ts_fill_forward,
    "model_backfill": model_backfill,
    "consumed_names": consumed_names,
    "derive_exec": derive_exec,
    "import_tools": import_tools,
    "import_codex_tools": import_codex_tools,
    "derive_exec_mixed": derive_exec_mixed,
    "export_tools": export_tools,
    "stream_import": stream_import,
    "stream_conversations": stream_conversations,
    "stream_usage": stream_usage,
}

ORACLES = {
    **{f"usage_by_{d}": _usage_sql(d) for d in DIMENSIONS},
    "usage_since": _usage_sql("model", SINCE),
    "usage_reasoning_partial": _usage_sql("source", 0, True),
    "tool_call_rows": _PAIRS_SQL + "select * from p",
    "tool_call_rows_csv": _PAIRS_SQL + """select pos, user_id || ',' || call_id || ',' || '"' || replace(props, '"', '""') || '"' || ',' || coalesce(cast(is_error as varchar), '') || ',' || coalesce(cast(chars as varchar), '') as line from p""",
    "tool_error_rate": _PAIRS_SQL + "select call_id, count(*) as n_calls, count(*) filter (is_error) as n_errors, count(*) filter (is_error is null) as n_unpaired, cast(sum(chars) as bigint) as chars from p group by call_id",
    "inspect_summary": _INSPECT_SQL,
    **{f"import_{_name(f)}": _import_sql(f) for f in FORMATS},
    "detect_format": _DETECT_SQL,
    "claude_merge_split": _SPLIT_SQL,
    "codex_token_attribution": _ATTRIBUTION_SQL,
    "chatgpt_path": _PATH_SQL,
    "export_canonical": _CANONICAL_SQL,
    "export_openai_chat": _OPENAI_SQL,
    "export_anthropic_messages": _ANTHROPIC_SQL,
    "export_gemini": _GEMINI_SQL,
    "export_markdown": _MARKDOWN_SQL,
    "system_prompt": _SYSTEM_SQL,
    "role_merge": _ISLAND_SQL,
    **_SEQUENCE_SQL,
    "derive_exec": _EXEC_SQL,
    "import_tools": _IMPORT_TOOLS_SQL,
    "import_codex_tools": _CODEX_TOOLS_SQL,
    "derive_exec_mixed": _MIXED_SQL,
    "export_tools": _EXPORT_TOOLS_SQL,
    "stream_import": _STREAM_SQL,
    "stream_conversations": _STREAM_HEADS_SQL,
    "stream_usage": _usage_sql("model"),
}
