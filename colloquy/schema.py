"""The canonical tables: one row a conversation, one row a message, typed once and for all.

Open records (metadata, arguments, custom) are JSON text: key order is data and NULL is not an empty object.
"""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = "1.1.0"
CANONICAL = "thread"  # fixed value: what the canonical format is called
ROLES = ("user", "assistant", "system", "tool")
FINISH_REASONS = ("stop", "length", "tool_calls", "content_filter", "error", "cancelled")
DETAILS = ("auto", "low", "high")

PART_DDL = (
    "struct<type:string,text:string,annotations:string,data:string,media_type:string,detail:string,name:string,size:bigint,"
    "reasoning:struct<text:string,signature:string,provider_metadata:string>,"
    "tool_call:struct<id:string,name:string,arguments:string,parsed_arguments:string,derived:string>>"
)
USAGE_DDL = "struct<input_tokens:bigint,output_tokens:bigint,reasoning_tokens:bigint,cache_read_tokens:bigint,cache_write_tokens:bigint>"
RESULT_DDL = f"struct<tool_call_id:string,name:string,content:array<{PART_DDL}>,is_error:boolean,structured_result:string>"
MESSAGE_DDL = (
    f"struct<message_id:string,conversation_id:string,role:string,ts_ms:bigint,model:string,provider:string,finish_reason:string,"
    f"usage:{USAGE_DDL},content:array<{PART_DDL}>,tool_results:array<{RESULT_DDL}>,metadata:string>"
)
CONVERSATION_DDL = (
    "struct<conversation_id:string,source:string,source_version:string,title:string,tags:array<string>,cwd:string,"
    "git:struct<repo:string,branch:string,commit:string>,custom:string,created_at:bigint,updated_at:bigint,schema_version:string>"
)
#: What importing gives: a row a conversation, or a row that says why a file has none.
IMPORTED_DDL = f"struct<file:string,file_ord:int,format:string,status:string,error:string,warnings:array<string>,conversation_ord:int,conversation:{CONVERSATION_DDL},messages:array<{MESSAGE_DDL}>>"


_SIMPLE = {"string": T.StringType, "bigint": T.LongType, "int": T.IntegerType, "boolean": T.BooleanType}


def struct(ddl: str) -> T.DataType:
    """The type that ddl spells, without a running session."""
    head, _, inner = ddl.partition("<")
    if not inner:
        return _SIMPLE[head]()
    inner = inner[:-1]
    if head == "array":
        return T.ArrayType(struct(inner))
    fields, depth, start = [], 0, 0
    for i, c in enumerate(inner + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = inner[start:i].partition(":")
            fields.append(T.StructField(name, struct(kind)))
            start = i + 1
    return T.StructType(fields)


IMPORTED = struct(IMPORTED_DDL)
MESSAGE = struct(MESSAGE_DDL)
PART_FIELDS = [f.name for f in struct(PART_DDL).fields]


class Invalid(ValueError):
    """A canonical document that breaks the schema; says where."""


def message(message_id, conversation_id, role, ts_ms, **rest) -> dict:
    out = dict.fromkeys(MESSAGE.names)
    out.update(message_id=message_id, conversation_id=conversation_id, role=role, ts_ms=ts_ms, **rest)
    return out


def text_part(text: str) -> dict:
    return {"type": "text", "text": text}


def image_part(data: str, media_type: str, detail: str | None = None) -> dict:
    return {"type": "image", "data": data, "media_type": media_type, "detail": detail}


def file_part(name: str, media_type: str, data: str, size: int | None = None) -> dict:
    return {"type": "file", "name": name, "media_type": media_type, "data": data, "size": size}


def reasoning_part(text: str | None, signature: str | None = None, provider_metadata: str | None = None) -> dict:
    return {"type": "reasoning", "reasoning": {"text": text, "signature": signature, "provider_metadata": provider_metadata}}


def call_part(call_id: str, name: str, arguments: str, parsed: str | None, derived: str | None = None) -> dict:
    return {"type": "tool_call", "tool_call": {"id": call_id, "name": name, "arguments": arguments, "parsed_arguments": parsed, "derived": derived}}


def result(call_id: str, name: str, content: list[dict], is_error: bool | None = None, structured: str | None = None) -> dict:
    return {"tool_call_id": call_id, "name": name, "content": content, "is_error": is_error, "structured_result": structured}


def conversation(conversation_id: str, source: str | None, messages: list[dict], **rest) -> dict:
    out = {"conversation_id": conversation_id, "source": source, "source_version": None, "title": None, "tags": None, "cwd": None, "git": None, "custom": None, "schema_version": VERSION}
    out.update(created_at=messages[0]["ts_ms"] if messages else None, updated_at=messages[-1]["ts_ms"] if messages else None)
    out.update({k: v for k, v in rest.items() if v is not None})
    return out
