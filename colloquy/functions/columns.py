"""Column expressions that canonical tables need again and again; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_length(c: Column) -> Column:
    """Length in UTF-16 units, as transcripts' own tools count it."""
    return F.floor(F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def text_prefix(c: Column, n: int) -> Column:
    """The first n UTF-16 units; a pair that would be torn keeps its first half's replacement out."""
    cut = F.decode(F.substring(F.encode(c, "UTF-16BE"), 1, 2 * n), "UTF-16BE")
    return F.when(text_length(c) <= n, c).otherwise(F.rtrim(cut, F.lit("�")))


def iso(ms: Column) -> Column:
    """Epoch milliseconds as UTC ISO text, whatever the session's time zone is."""
    days = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))
    rest = F.pmod(ms, F.lit(86_400_000))
    two = lambda x, w=2: F.lpad(F.floor(x).cast("string"), w, "0")
    return F.concat(days.cast("string"), F.lit("T"), two(rest / 3_600_000), F.lit(":"), two(rest / 60_000 % 60), F.lit(":"), two(rest / 1000 % 60), F.lit("."), two(rest % 1000, 3), F.lit("Z"))


def day(ms: Column) -> Column:
    """The UTC date as text, whatever the session's time zone is."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int")).cast("string")


def json_text(c: Column) -> Column:
    """c as a JSON string, quotes included; null for null."""
    whole = F.rtrim(F.to_json(F.struct(c.alias("v"))), F.lit("}"))  # a quote comes before the brace, which goes
    return F.when(c.isNotNull(), F.substr(whole, F.lit(6)))


def parts(content: Column, kind: str) -> Column:
    return F.filter(content, lambda p: p["type"] == kind)


def text_content(content: Column, sep: str = "\n") -> Column:
    """The text parts joined."""
    return F.array_join(F.transform(parts(content, "text"), lambda p: p["text"]), sep)


def tool_calls(content: Column) -> Column:
    return F.transform(parts(content, "tool_call"), lambda p: p["tool_call"])


def reasoning(content: Column) -> Column:
    """The reasoning texts joined; signatures alone have none."""
    return F.array_join(F.filter(F.transform(parts(content, "reasoning"), lambda p: p["reasoning"]["text"]), lambda t: F.length(t) > 0), "\n")


def result_text(content: Column) -> Column:
    """A result's content as text, other parts as placeholders."""
    return F.array_join(F.transform(content, lambda p: F.when(p["type"] == "text", p["text"]).otherwise(F.concat(F.lit("["), p["type"], F.lit("]")))), "\n")


def fence(c: Column) -> Column:
    """A run of backticks longer than any in c, three at least."""
    runs = F.transform(F.regexp_extract_all(c, F.lit("(`++)"), 1), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def call_input(call: Column) -> Column:
    """A call's arguments as a JSON object: the parsed ones, else those its text parses to, else none. What was
    derived from a program is never passed for arguments."""
    parsed = F.when(F.startswith(F.ltrim(call["arguments"]), F.lit("{")) & F.try_parse_json(call["arguments"]).isNotNull(), F.get_json_object(call["arguments"], "$"))
    return F.coalesce(call["parsed_arguments"], parsed, F.lit("{}"))


def is_role(role: str) -> Column:
    return F.col("role") == role
