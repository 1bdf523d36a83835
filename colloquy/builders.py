"""Building canonical conversations by hand, for tests and small programs. Ids are random unless given."""

from __future__ import annotations

import time
import uuid

from colloquy import schema


def new_id() -> str:
    return uuid.uuid4().hex


def now() -> int:
    return int(time.time() * 1000)


def user(conversation_id: str, content, **rest) -> dict:
    return _message("user", conversation_id, content=_parts(content), **rest)


def system(conversation_id: str, content, **rest) -> dict:
    return _message("system", conversation_id, content=_parts(content), **rest)


def assistant(conversation_id: str, content, **rest) -> dict:
    return _message("assistant", conversation_id, content=_parts(content), **rest)


def tool(conversation_id: str, results: list[dict], **rest) -> dict:
    return _message("tool", conversation_id, tool_results=results, **rest)


def conversation(messages: list[dict], conversation_id: str | None = None, source: str | None = None, **rest) -> dict:
    """A row of the imported table; times come from the first and last message."""
    t = schema.conversation(conversation_id or (messages[0]["conversation_id"] if messages else new_id()), source, messages, **rest)
    return {"file": t["conversation_id"], "file_ord": 0, "format": "built", "status": "ok", "error": None, "warnings": [], "conversation_ord": 0, "conversation": t, "messages": messages}


def _parts(content) -> list[dict]:
    return [schema.text_part(content)] if isinstance(content, str) else list(content)


def _message(role: str, conversation_id: str, message_id: str | None = None, ts_ms: int | None = None, **rest) -> dict:
    return schema.message(message_id or new_id(), conversation_id, role, now() if ts_ms is None else ts_ms, **rest)
