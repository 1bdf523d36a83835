"""Which format a transcript has, from its content alone."""

from __future__ import annotations

from colloquy.functions.values import MISSING, is_number, record, try_parse
from colloquy.schema import CANONICAL

FORMATS = ("claude-code", "codex", "opencode", "kiro", "pi", "muse", "chatgpt-export", CANONICAL)
SCAN = 200  # lines looked at when the first decides nothing


def _claude(r: dict) -> bool:
    kind = r.get("type")
    return "sessionId" in r or "parentUuid" in r or kind in ("ai-title", "file-history-snapshot") or kind == "summary" and "leafUuid" in r


def _kiro(r: dict) -> bool:
    return "data" in r and isinstance(r.get("kind"), str) and r["kind"] in ("Prompt", "AssistantMessage", "ToolResults", "Compaction")


def _pi(r: dict) -> bool:
    return r.get("type") == "session" and "cwd" in r and "version" in r or r.get("type") == "message" and "message" in r and "parentId" in r


def _muse(r: dict) -> bool:
    events = r.get("events")
    if not is_number(r.get("export_schema_version")) or not isinstance(events, list):
        return False
    if any(isinstance((record((record(e) or {}).get("envelope")) or {}).get("payload_type"), str) for e in events):
        return True
    return not events and isinstance(r.get("sessions"), list)


def _line(r: dict, codex: tuple[str, ...], codex_first: bool) -> str | None:
    is_codex = isinstance(r.get("type"), str) and r["type"] in codex
    if is_codex and codex_first:
        return "codex"
    if _claude(r):
        return "claude-code"
    return "codex" if is_codex else "kiro" if _kiro(r) else "pi" if _pi(r) else None


def detect(content: str) -> str | None:
    """One of FORMATS, or None."""
    text = content.lstrip("﻿ \t\n\r\x0b\x0c\xa0  ")
    first = record(try_parse(text.split("\n", 1)[0]))
    if first is not None and (found := _line(first, ("session_meta", "response_item", "turn_context", "event_msg"), True)):
        return found
    doc = try_parse(text)
    if doc is MISSING:
        for line in text.split("\n", SCAN)[:SCAN]:
            r = record(try_parse(line))
            if r is not None and (found := _line(r, ("response_item", "session_meta"), False)):
                return found
        return None
    if isinstance(doc, list):
        return "chatgpt-export" if doc and "mapping" in (record(doc[0]) or {}) else None
    d = record(doc)
    if d is None:
        return None
    if "mapping" in d:
        return "chatgpt-export"
    if _muse(d):
        return "muse"
    if "schemaVersion" in d and "messages" in d:
        return CANONICAL
    if isinstance(d.get("messages"), list):
        head = record(d["messages"][0]) if d["messages"] else None
        if head and "parts" in head and "info" in head:
            return "opencode"
        return CANONICAL if "id" in d and "createdAt" in d else "opencode" if "info" in d else None
    return None
