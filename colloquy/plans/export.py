"""Conversations in the message formats of providers, as canonical JSON and as Markdown.

Everything is an expression over one row's arrays, so exports need no shuffle. Bodies are compact JSON text;
`pretty` indents one on the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.columns import call_input, fence, iso, json_text, result_text, text_content, text_length, text_prefix
from colloquy.schema import CANONICAL, VERSION

FORMATS = (CANONICAL, "openai-chat", "anthropic-messages", "gemini", "markdown")
MAX_RESULT = 2000


def _obj(*pairs: tuple[str, Column]) -> Column:
    """A JSON object of (key, JSON text) pairs in order; null values have no key."""
    fields = [F.concat(F.lit(f'"{k}":'), v) for k, v in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it: nothing else does so within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _arr(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _lit(text: str) -> Column:
    return F.lit(json.dumps(text))


def _number(c: Column) -> Column:
    return c.cast("string")


def _placeholder_file(p: Column) -> Column:
    return F.concat(F.lit("[file: "), p["name"], F.lit(" ("), p["media_type"], F.lit(")]"))


def _kept(items: Column) -> Column:
    """Without empty texts."""
    return F.filter(items, lambda t: F.length(t) > 0)


def system_prompt(messages: Column) -> Column:
    """Texts of system messages, joined by blank lines; null if there are none."""
    texts = F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: text_content(m["content"]))
    return _let(F.array_join(_kept(texts), "\n\n"), lambda text: F.nullif(text, F.lit("")))


# --- OpenAI chat ----------------------------------------------------------------------------------------------


def _openai(m: Column) -> Column:
    """The array of JSON messages that one message becomes."""
    role, content = m["role"], m["content"]
    asked = F.array_join(_kept(F.transform(content, lambda p: F.when(p["type"] == "text", p["text"]).when(p["type"] == "file", _placeholder_file(p)).otherwise(""))), "\n")
    said = F.array_join(_kept(F.transform(content, lambda p: F.when(p["type"] == "text", p["text"]).when(p["type"] == "image", F.concat(F.lit("[image: "), p["media_type"], F.lit("]"))).otherwise(""))), "\n")
    url = lambda p: F.when(p["data"].rlike("^(https?:|data:|file:)"), p["data"]).otherwise(F.concat(F.lit("data:"), p["media_type"], F.lit(";base64,"), p["data"]))
    images = F.transform(F.filter(content, lambda p: p["type"] == "image"), lambda p: _obj(("type", _lit("image_url")), ("image_url", _obj(("url", json_text(url(p)))))))
    calls = F.transform(F.filter(content, lambda p: p["type"] == "tool_call"), lambda p: _obj(("id", json_text(p["tool_call"]["id"])), ("type", _lit("function")), ("function", _obj(("name", json_text(p["tool_call"]["name"])), ("arguments", json_text(p["tool_call"]["arguments"]))))))
    none = F.array().cast("array<string>")
    text_item = lambda text: F.when(F.length(text) > 0, F.array(_obj(("type", _lit("text")), ("text", json_text(text))))).otherwise(none)
    pictured = lambda text: F.array(_obj(("role", _lit("user")), ("content", _arr(F.concat(text_item(text), images)))))
    has_image = F.exists(content, lambda p: p["type"] == "image")
    asks = _let(asked, lambda text: F.when((role == "user") & has_image, pictured(text)).when(F.length(text) > 0, F.array(_obj(("role", json_text(role)), ("content", json_text(text))))).otherwise(none))
    called = lambda text, cs: F.array(_obj(("role", _lit("assistant")), ("content", json_text(F.nullif(text, F.lit("")))), ("tool_calls", _arr(cs))))
    says = _let(said, lambda text: _let(calls, lambda cs: F.when(F.size(cs) > 0, called(text, cs)).when(F.length(text) > 0, F.array(_obj(("role", _lit("assistant")), ("content", json_text(text))))).otherwise(none)))
    results = F.transform(m["tool_results"], lambda r: _obj(("role", _lit("tool")), ("content", _let(result_text(r["content"]), json_text)), ("tool_call_id", json_text(r["tool_call_id"]))))
    return F.when(role == "assistant", says).when(role == "tool", results).otherwise(asks)


def openai_messages(messages: Column) -> Column:
    return F.flatten(F.transform(messages, _openai))


# --- merging neighbours ---------------------------------------------------------------------------------------


def merged(turns: Column) -> Column:
    """turns (role, items) with neighbours of one role as one; turns without items neither appear nor separate. Each
    run of a role is cut out by where it and the next begin: work grows with the turns, not with their square."""
    none = F.array().cast("array<int>")

    def runs(ts: Column) -> Column:
        differs = lambda i: (i == 0) | (F.get(ts, i)["role"] != F.get(ts, i - 1)["role"])
        begins = F.when(F.size(ts) > 0, F.filter(F.sequence(F.lit(0), F.size(ts) - 1), differs)).otherwise(none)
        run = lambda at, i, k: F.struct(F.get(ts, i)["role"].alias("role"), F.flatten(F.transform(F.slice(ts, i + 1, F.coalesce(F.get(at, k + 1), F.size(ts)) - i), lambda t: t["items"])).alias("items"))
        return _let(begins, lambda at: F.transform(at, lambda i, k: run(at, i, k)))

    return _let(F.filter(turns, lambda t: F.size(t["items"]) > 0), runs)


def _turns(messages: Column, assistant: str, items) -> Column:
    spoken = F.filter(messages, lambda m: m["role"] != "system")
    return F.transform(spoken, lambda m: F.struct(F.when(m["role"] == "assistant", assistant).otherwise("user").alias("role"), items(m).alias("items")))


# --- Anthropic messages ---------------------------------------------------------------------------------------


def _bare(data: Column) -> Column:
    return F.regexp_replace(data, "^data:[^;]+;base64,", "")


def _anthropic_image(p: Column) -> Column:
    linked = _obj(("type", _lit("url")), ("url", json_text(p["data"])))
    held = _obj(("type", _lit("base64")), ("media_type", json_text(p["media_type"])), ("data", json_text(_bare(p["data"]))))
    return _obj(("type", _lit("image")), ("source", F.when(p["data"].rlike("^https?:"), linked).otherwise(held)))


def _text_block(text: Column) -> Column:
    return F.when(F.length(text) > 0, _obj(("type", _lit("text")), ("text", json_text(text))))


def _anthropic_part(p: Column) -> Column:
    r = p["reasoning"]
    hidden = F.when(F.get_json_object(r["provider_metadata"], "$.redacted") == "true", F.get_json_object(r["provider_metadata"], "$.data"))
    thought = F.when(F.length(hidden) > 0, _obj(("type", _lit("redacted_thinking")), ("data", json_text(hidden)))).when(
        (F.length(r["text"]) > 0) & r["signature"].isNotNull(), _obj(("type", _lit("thinking")), ("thinking", json_text(r["text"])), ("signature", json_text(r["signature"])))
    )
    c = p["tool_call"]
    call = _obj(("type", _lit("tool_use")), ("id", json_text(c["id"])), ("name", json_text(c["name"])), ("input", call_input(c)))
    file = _obj(("type", _lit("text")), ("text", json_text(_placeholder_file(p))))
    return F.when(p["type"] == "text", _text_block(p["text"])).when(p["type"] == "reasoning", thought).when(p["type"] == "tool_call", call).when(p["type"] == "image", _anthropic_image(p)).otherwise(file)


def _anthropic_result(r: Column) -> Column:
    block = lambda p: F.when(p["type"] == "text", _text_block(p["text"])).when(p["type"] == "image", _anthropic_image(p)).otherwise(_obj(("type", _lit("text")), ("text", json_text(F.concat(F.lit("[file: "), p["name"], F.lit("]"))))))
    blocks = F.array_compact(F.transform(r["content"], block))
    return _obj(("type", _lit("tool_result")), ("tool_use_id", json_text(r["tool_call_id"])), ("content", F.when(F.size(blocks) > 0, _arr(blocks))), ("is_error", r["is_error"].cast("string")))


def anthropic_messages(messages: Column) -> Column:
    items = lambda m: F.when(m["role"] == "tool", F.transform(m["tool_results"], _anthropic_result)).otherwise(F.array_compact(F.transform(m["content"], _anthropic_part)))
    return F.transform(merged(_turns(messages, "assistant", items)), lambda t: _obj(("role", json_text(t["role"])), ("content", _arr(t["items"]))))


# --- Gemini ---------------------------------------------------------------------------------------------------


def _gemini_part(p: Column, spoken: Column) -> Column:
    say = lambda text: _obj(("text", json_text(text)))
    c = p["tool_call"]
    call = _obj(("functionCall", _obj(("name", json_text(c["name"])), ("args", call_input(c)))))
    image = F.when(p["data"].rlike("^https?:"), say(F.concat(F.lit("[image: "), p["data"], F.lit("]")))).otherwise(_obj(("inlineData", _obj(("mimeType", json_text(p["media_type"])), ("data", json_text(_bare(p["data"])))))))
    return F.when(p["type"] == "text", say(p["text"])).when(spoken, F.when(p["type"] == "tool_call", call)).when(p["type"] == "image", image).otherwise(say(_placeholder_file(p)))


def gemini_contents(messages: Column) -> Column:
    """A result without a name takes that of the last call with its id before it."""
    own = lambda m, i: F.transform(F.filter(m["content"], lambda p: (p["type"] == "tool_call") & p["tool_call"]["id"].isNotNull()), lambda p, k: F.struct(p["tool_call"]["id"].alias("id"), i.alias("i"), k.alias("k"), p["tool_call"]["name"].alias("name")))
    none = F.array().cast("array<struct<id:string,i:int,k:int,name:string>>")
    called = F.flatten(F.transform(messages, lambda m, i: F.when((m["role"] == "assistant") & m["content"].isNotNull(), own(m, i)).otherwise(none)))
    return _let(F.sort_array(called), lambda calls: _let(F.filter(F.array(*(F.lit(1 << b) for b in range(30, -1, -1))), lambda n: n <= F.size(calls)), lambda halves: _gemini_turns(messages, calls, halves)))


def _last_before(calls: Column, halves: Column, call_id: Column, i: Column) -> Column:
    """The last of calls (id, i, k, name), which are in order, with call_id and a smaller i; null if there is none.
    Found by steps of halves, the powers of two from high to low: work grows with the logarithm of the calls."""
    ahead = lambda at: _let(F.get(calls, at), lambda c: (c["id"] < call_id) | ((c["id"] == call_id) & (c["i"] < i)))
    step = lambda at, bit: F.when((at + bit <= F.size(calls)) & ahead(at + bit - 1), at + bit).otherwise(at)
    before = F.aggregate(halves, F.lit(0), step)
    return _let(F.when(call_id.isNotNull(), F.get(calls, before - 1)), lambda c: F.when(c["id"] == call_id, c))


def _gemini_turns(messages: Column, calls: Column, halves: Column) -> Column:
    def name(r: Column, i: Column) -> Column:
        return F.coalesce(F.nullif(r["name"], F.lit("")), _let(_last_before(calls, halves, r["tool_call_id"], i)["name"], lambda n: F.nullif(n, F.lit(""))), F.lit("unknown"))

    response = lambda r, i: _obj(("functionResponse", _obj(("name", _let(name(r, i), json_text)), ("response", _obj(("content", _let(result_text(r["content"]), json_text)))))))
    turns = F.transform(messages, lambda m, i: F.struct(
        F.when(m["role"] == "assistant", "model").otherwise("user").alias("role"),
        F.when(m["role"] == "system", F.array().cast("array<string>")).when(m["role"] == "tool", F.transform(m["tool_results"], lambda r: response(r, i))).otherwise(F.array_compact(F.transform(m["content"], lambda p: _gemini_part(p, m["role"] == "assistant")))).alias("items"),
    ))
    return F.transform(merged(turns), lambda t: _obj(("role", json_text(t["role"])), ("parts", _arr(t["items"]))))


# --- canonical JSON -------------------------------------------------------------------------------------------


def _part_json(p: Column, spoken: Column) -> Column:
    r, c = p["reasoning"], p["tool_call"]
    picture = _obj(("type", _lit("image")), ("data", json_text(p["data"])), ("mediaType", json_text(p["media_type"])), ("detail", json_text(p["detail"])))
    thought = _obj(("type", _lit("reasoning")), ("text", json_text(r["text"])), ("signature", json_text(r["signature"])), ("providerMetadata", r["provider_metadata"]))
    call = _obj(("id", json_text(c["id"])), ("name", json_text(c["name"])), ("arguments", json_text(c["arguments"])), ("parsedArguments", c["parsed_arguments"]), ("derived", c["derived"]))
    return (
        F.when(p["type"] == "text", _obj(("type", _lit("text")), ("text", json_text(p["text"])), ("annotations", p["annotations"])))
        .when(p["type"] == "reasoning", _obj(("type", _lit("reasoning")), ("reasoning", thought)))
        .when(p["type"] == "tool_call", _obj(("type", _lit("tool_call")), ("toolCall", call)))
        .when(p["type"] == "image", F.when(spoken, _obj(("type", _lit("image")), ("image", picture))).otherwise(picture))
        .otherwise(_obj(("type", _lit("file")), ("data", json_text(p["data"])), ("mediaType", json_text(p["media_type"])), ("name", json_text(p["name"])), ("size", _number(p["size"]))))
    )


def _message_json(m: Column) -> Column:
    u, spoken = m["usage"], m["role"] == "assistant"
    usage = F.when(u.isNotNull(), _obj(*((k, _number(u[n])) for k, n in (("inputTokens", "input_tokens"), ("outputTokens", "output_tokens"), ("reasoningTokens", "reasoning_tokens"), ("cacheReadTokens", "cache_read_tokens"), ("cacheWriteTokens", "cache_write_tokens")))))
    results = F.transform(m["tool_results"], lambda r: _obj(("toolCallId", json_text(r["tool_call_id"])), ("name", json_text(r["name"])), ("content", _arr(F.transform(r["content"], lambda p: _part_json(p, F.lit(False))))), ("isError", r["is_error"].cast("string")), ("structuredResult", r["structured_result"])))
    content = F.transform(m["content"], lambda p: _part_json(p, spoken))
    return _obj(
        ("id", json_text(m["message_id"])), ("threadId", json_text(m["conversation_id"])), ("role", json_text(m["role"])), ("timestamp", _number(m["ts_ms"])), ("metadata", m["metadata"]),
        ("content", F.when(m["role"] != "tool", _arr(content))), ("toolResults", F.when(m["role"] == "tool", _arr(results))),
        ("model", json_text(m["model"])), ("provider", json_text(m["provider"])), ("usage", usage), ("finishReason", json_text(m["finish_reason"])),
    )


def canonical_json(conversation: Column, messages: Column) -> Column:
    git = F.when(conversation["git"].isNotNull(), _obj(*((k, json_text(conversation["git"][k])) for k in ("repo", "branch", "commit"))))
    tags = F.when(conversation["tags"].isNotNull(), _arr(F.transform(conversation["tags"], json_text)))
    meta = _obj(("title", json_text(conversation["title"])), ("tags", tags), ("source", json_text(conversation["source"])), ("sourceVersion", json_text(conversation["source_version"])), ("cwd", json_text(conversation["cwd"])), ("git", git), ("custom", conversation["custom"]))
    return _obj(
        ("schemaVersion", json_text(F.coalesce(conversation["schema_version"], F.lit(VERSION)))), ("id", json_text(conversation["conversation_id"])), ("messages", _arr(F.transform(messages, _message_json))),
        ("metadata", F.nullif(meta, F.lit("{}"))), ("createdAt", _number(conversation["created_at"])), ("updatedAt", _number(conversation["updated_at"])),
    )


# --- Markdown -------------------------------------------------------------------------------------------------


def markdown(conversation: Column, messages: Column, metadata: bool = True, timestamps: bool = True, with_reasoning: bool = True, with_tools: bool = True, max_result: int = MAX_RESULT) -> Column:
    """A readable page. It is lines joined by newlines; results beyond max_result UTF-16 units are cut, and say so."""
    lines = lambda *xs: F.array(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    none = F.array().cast("array<string>")
    said = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(f"{name}: "), json_text(c)))
    tags = F.when(F.size(conversation["tags"]) > 0, F.concat(F.lit("tags: ["), F.array_join(F.transform(conversation["tags"], json_text), ", "), F.lit("]")))
    title = F.coalesce(conversation["title"], F.concat(F.lit("Thread "), conversation["conversation_id"]))
    head = F.array_compact(lines(
        "---", F.concat(F.lit("title: "), json_text(title)), F.concat(F.lit("id: "), json_text(conversation["conversation_id"])), F.concat(F.lit("created: "), iso(conversation["created_at"])), F.concat(F.lit("updated: "), iso(conversation["updated_at"])),
        said("source", conversation["source"]), said("sourceVersion", conversation["source_version"]), said("cwd", conversation["cwd"]), said("branch", conversation["git"]["branch"]), tags, "---", "",
    ))
    image = lambda p: lines(F.concat(F.lit("*[image: "), p["media_type"], F.lit("]*")), "")
    asked = lambda p: F.when(p["type"] == "text", lines(p["text"], "")).when(p["type"] == "image", image(p)).otherwise(lines(F.concat(F.lit("*[file: "), p["name"], F.lit(" ("), p["media_type"], F.lit(")]*")), ""))

    def spoke(p: Column) -> Column:
        thought, call = p["reasoning"]["text"], p["tool_call"]
        shown = F.when(p["type"] == "text", lines(p["text"], "")).when(p["type"] == "image", image(p))
        if with_reasoning:
            shown = shown.when((p["type"] == "reasoning") & (F.length(thought) > 0), lines("<details><summary>Reasoning</summary>", "", thought, "", "</details>", ""))
        if with_tools:
            shown = shown.when(p["type"] == "tool_call", _let(fence(call["arguments"]), lambda f: lines(F.concat(F.lit("**→ "), call["name"], F.lit("**")), "", F.concat(f, F.lit("json")), call["arguments"], f, "")))
        return shown.otherwise(none)

    def gave(r: Column) -> Column:
        more = lambda text: F.concat(text_prefix(text, max_result), F.lit("\n… ("), (text_length(text) - max_result).cast("string"), F.lit(" more characters)"))
        shown = _let(result_text(r["content"]), lambda text: F.when(text_length(text) > max_result, more(text)).otherwise(text))
        label = F.when(F.length(r["name"]) > 0, F.concat(r["name"], F.lit(" "))).otherwise("")
        status = F.when(F.coalesce(r["is_error"], F.lit(False)), " (error)").otherwise("")
        fenced = lambda text, f: lines(F.concat(F.lit("**← "), label, F.lit("result"), status, F.lit("**")), "", f, text, f, "")
        return _let(shown, lambda text: _let(fence(text), lambda f: fenced(text, f)))

    def turn(m: Column) -> Column:
        when = F.concat(F.lit(" — "), iso(m["ts_ms"])) if timestamps else F.lit("")
        model = F.when(F.length(m["model"]) > 0, F.concat(F.lit(" ("), m["model"], F.lit(")"))).otherwise("")
        name = F.when(m["role"] == "user", "## User").when(m["role"] == "system", "## System").otherwise(F.concat(F.lit("## Assistant"), model))
        opened = lines(F.concat(name, when), "")
        results = F.flatten(F.transform(m["tool_results"], gave)) if with_tools else none
        return F.when(m["role"] == "tool", results).when(m["role"] == "assistant", F.concat(opened, F.flatten(F.transform(m["content"], spoke)))).otherwise(F.concat(opened, F.flatten(F.transform(m["content"], asked))))

    body = F.flatten(F.transform(messages, turn))
    return F.array_join(F.concat(head, body) if metadata else body, "\n")


def exports(imported: DataFrame, forms, **options) -> DataFrame:
    """(file, conversation_ord, conversation_id) and the body in each of forms, a column of that name, in one pass."""
    t, m = F.col("conversation"), F.col("messages")
    system = lambda body: _let(system_prompt(m), lambda text: _let(json_text(text), body))
    bodies = {
        CANONICAL: lambda: canonical_json(t, m),
        "openai-chat": lambda: _arr(openai_messages(m)),
        "anthropic-messages": lambda: system(lambda said: _obj(("system", said), ("messages", _arr(anthropic_messages(m))))),
        "gemini": lambda: system(lambda said: _obj(("systemInstruction", F.when(said.isNotNull(), _obj(("parts", _arr(F.array(_obj(("text", said)))))))), ("contents", _arr(gemini_contents(m))))),
        "markdown": lambda: markdown(t, m, **options),
    }
    for form in forms:
        if form not in FORMATS:
            raise ValueError(f"unknown output format {form!r} (one of: {', '.join(FORMATS)})")
    return imported.where("conversation is not null").select("file", "conversation_ord", "conversation.conversation_id", *(bodies[form]().alias(form) for form in forms))


def export(imported: DataFrame, form: str, **options) -> DataFrame:
    """(file, conversation_ord, conversation_id, body) of each conversation in one of FORMATS."""
    return exports(imported, [form], **options).withColumnRenamed(form, "body")


def numbered(path: str, i: int, total: int) -> str:
    """path for the i-th (from 0) of several outputs."""
    if total == 1:
        return path
    head, dot, tail = path.rpartition(".")
    return f"{head}-{i + 1}{dot}{tail}" if dot and head and "/" not in tail else f"{path}-{i + 1}"


def pretty(body: str) -> str:
    return json.dumps(json.loads(body), indent=2, ensure_ascii=False)
