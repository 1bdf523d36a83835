"""Summaries of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.columns import iso, parts, text_content, text_prefix

PREVIEW = 100


def summaries(imported: DataFrame) -> DataFrame:
    """One row a conversation: its head, message counts by role (in order of appearance), tool calls (every part,
    repeated ids too) and the beginning of the first user message. No shuffle: a conversation is one row."""
    roles = F.transform("_m", lambda m: m["role"])
    first_user = F.get(F.filter("_m", lambda m: m["role"] == "user"), F.lit(0))
    preview = text_prefix(F.replace(text_content(first_user["content"]), F.lit("\n"), F.lit(" ")), PREVIEW)
    calls = F.aggregate(F.filter("_m", lambda m: m["role"] == "assistant"), F.lit(0), lambda n, m: n + F.size(parts(m["content"], "tool_call")))
    by_role = F.transform(F.array_distinct(roles), lambda r: F.struct(r.alias("role"), F.size(F.filter(roles, lambda x: x == r)).cast("long").alias("n")))
    return imported.where("conversation is not null").withColumnRenamed("messages", "_m").select(
        "file", "format", "conversation_ord", "conversation.conversation_id", "conversation.title", "conversation.cwd", "conversation.source_version", iso(F.col("conversation.created_at")).alias("created"), iso(F.col("conversation.updated_at")).alias("updated"),
        F.size("_m").cast("long").alias("messages"), by_role.alias("by_role"), calls.cast("long").alias("tool_calls"), F.nullif(preview, F.lit("")).alias("preview"),
    )


def summary_text(row) -> str:
    """One summary as lines of text."""
    known = [("title", row["title"]), ("cwd", row["cwd"]), ("version", row["source_version"])]
    lines = [("format", row["format"]), ("threadId", row["conversation_id"]), *((k, v) for k, v in known if v), ("created", row["created"]), ("updated", row["updated"]), ("messages", row["messages"])]
    lines += [("by role", " ".join(f"{r['role']}={r['n']}" for r in row["by_role"])), ("toolCalls", row["tool_calls"])]
    if row["preview"]:
        lines.append(("first msg", row["preview"]))
    return "\n".join(f"{k + ':':<11}{v}" for k, v in lines)
