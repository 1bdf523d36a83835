"""Importers of formats that are one JSON document a file. Each gives (conversations, warnings), a conversation
being (head, messages)."""

from __future__ import annotations

import math

from colloquy.functions.values import count, dump, dump_record, is_number, nonempty, parse_json, record, rounded, string, timestamp, try_parse
from colloquy.schema import CANONICAL, DETAILS, FINISH_REASONS, Invalid, call_part, file_part, image_part, message, reasoning_part, result, text_part, conversation
from colloquy.sources.jsonl import NoConversation, _opt, _usage

Conversations = tuple[list[tuple[dict, list[dict]]], list[str]]


def _document(content: str, what: str):
    try:
        return parse_json(content)
    except ValueError as e:
        raise Invalid(f"{what}: not JSON ({e})") from e


class _Ids:
    def __init__(self, conversation_id: str):
        self.conversation_id, self.n = conversation_id, 0

    def __call__(self, prefix: str | None = None) -> str:
        self.n += 1
        return f"{prefix or self.conversation_id}:{self.n}"


_str = lambda v: isinstance(v, str)


def opencode(content: str, now_ms: int = 0, session_id: str | None = None) -> Conversations:
    """Session exports in which a tool part holds both the call and its result."""
    doc = _document(content, "opencode")

    def times(holder, *names):
        t = holder.get("time", {})
        return isinstance(t, dict) and all(_opt(t, n, is_number) for n in names)

    def fits(m):
        if not isinstance(m, dict) or not isinstance(m.get("info"), dict):
            return False
        i, t, parts = m["info"], m["info"].get("tokens", {}), m.get("parts", [])
        cache = t.get("cache", {}) if isinstance(t, dict) else None
        return (
            i.get("role") in ("user", "assistant") and all(_opt(i, k, _str) for k in ("id", "modelID", "providerID")) and times(i, "created", "completed")
            and isinstance(t, dict) and all(_opt(t, k, is_number) for k in ("input", "output", "reasoning"))
            and isinstance(cache, dict) and all(_opt(cache, k, is_number) for k in ("read", "write"))
            and isinstance(parts, list) and all(isinstance(p, dict) and isinstance(p.get("type"), str) for p in parts)
        )

    info = doc.get("info", {}) if isinstance(doc, dict) else None
    if not isinstance(info, dict) or not all(_opt(info, k, _str) for k in ("id", "title", "directory", "version")) or not times(info, "created", "updated") or not isinstance(doc.get("messages"), list) or not all(map(fits, doc["messages"])):
        raise Invalid("opencode: not a session export")
    tid = info.get("id", "opencode-session")
    mint, out = _Ids(tid), []
    whole = lambda h, k: max(0, rounded(h[k])) if k in h else None
    for m in doc["messages"]:
        i, at = m["info"], None
        at = timestamp(i.get("time", {}).get("created")) or (out[-1]["ts_ms"] if out else now_ms)
        parts, results = [], []
        for p in m.get("parts", []):
            if p["type"] == "text" and isinstance(p.get("text"), str):
                parts.append(text_part(p["text"]))
            elif i["role"] == "user":
                if p["type"] == "file":
                    parts.append(file_part(*(p[k] if isinstance(p.get(k), str) else d for k, d in (("filename", "file"), ("mime", "application/octet-stream"), ("url", "")))))
            elif p["type"] == "reasoning" and isinstance(p.get("text"), str):
                parts.append(reasoning_part(p["text"]))
            elif p["type"] == "tool":
                state = record(p.get("state")) or {}
                call = p["callID"] if isinstance(p.get("callID"), str) else mint(f"{tid}:call")
                name = p["tool"] if isinstance(p.get("tool"), str) else "unknown"
                given = state.get("input")
                parts.append(call_part(call, name, dump({} if given is None else given), dump_record(given)))
                failed = state.get("status") == "error"
                if isinstance(state.get("output"), str) or failed:
                    text = next((state[k] for k in ("output", "error") if isinstance(state.get(k), str)), "")
                    results.append(result(call, name, [text_part(text)], True if failed else None))
        if parts and i["role"] == "user":
            out.append(message(i["id"] if "id" in i else mint(), tid, "user", at, content=parts))
        elif parts:
            t, usage = i.get("tokens", {}), None
            if "input" in t or "output" in t:
                cache = t.get("cache", {})
                usage = _usage(whole(t, "input") or 0, whole(t, "output") or 0, whole(t, "reasoning"), whole(cache, "read"), whole(cache, "write"))
            out.append(message(i["id"] if "id" in i else mint(), tid, "assistant", at, content=parts, model=i.get("modelID"), provider=i.get("providerID"), usage=usage))
        if results:
            out.append(message(mint(), tid, "tool", timestamp(i.get("time", {}).get("completed")) or at, tool_results=results))
    if not out:
        raise NoConversation("opencode: nothing to import")
    time = info.get("time", {})
    return [(conversation(tid, "opencode", out, source_version=info.get("version"), cwd=info.get("directory"), title=info.get("title"), created_at=timestamp(time.get("created")), updated_at=timestamp(time.get("updated"))), out)], []


def _leaf_chain(mapping: dict[str, dict], current) -> list[str]:
    """Keys from the root to current, or to the last childless node where current is unknown."""
    at = current if isinstance(current, str) and current in mapping else None
    if at is None:
        order = sorted((k for k in mapping if k.isascii() and k.isdigit() and (k == "0" or k[0] != "0") and len(k) < 10), key=int)
        order += [k for k in mapping if k not in set(order)]
        at = next((k for k in reversed(order) if not mapping[k]["children"]), current)
    chain: dict[str, None] = {}
    while at is not None and at not in chain and at in mapping:
        chain[at] = None
        at = mapping[at]["parent"]
    return list(chain)[::-1]


def _node(raw) -> dict | None:
    """A tolerant reading of a node: what is malformed in it counts as not there."""
    if not isinstance(raw, dict) or not _opt(raw, "id", _str):
        return None
    m, children = raw.get("message"), raw.get("children")
    ok = (
        isinstance(m, dict) and isinstance(m.get("id"), str) and isinstance(record(m.get("author")) and m["author"].get("role"), str)
        and isinstance(record(m.get("content")) and m["content"].get("content_type"), str) and _opt(m, "create_time", is_number, null=True) and _opt(m, "metadata", lambda v: isinstance(v, dict))
    )
    return {"message": m if ok else None, "parent": string(raw.get("parent")), "children": children if isinstance(children, list) and all(map(_str, children)) else []}


def _spoken(m: dict | None) -> list[dict]:
    """The parts a node's message would give; none for hidden ones and for tools."""
    if not m or (m.get("metadata") or {}).get("is_visually_hidden_from_conversation") is True:
        return []
    role, c = m["author"]["role"], m["content"]
    kind = c["content_type"]
    texts = [text_part(t) for t in (c["parts"] if isinstance(c.get("parts"), list) else ()) if nonempty(t)]
    if role in ("user", "system"):
        return texts
    if role != "assistant":
        return []
    if kind in ("text", "multimodal_text"):
        return texts
    if kind == "code":
        return [text_part(c["text"])] if nonempty(c.get("text")) else []
    if kind == "thoughts":
        thoughts = [t["content"] for t in (c["thoughts"] if isinstance(c.get("thoughts"), list) else ()) if isinstance(t, dict) and nonempty(t.get("content"))]
        return [reasoning_part("\n".join(thoughts))] if thoughts else []
    return []


def chatgpt(content: str, now_ms: int = 0, session_id: str | None = None) -> Conversations:
    """Data exports: trees of messages of which the path to the current node is the conversation."""
    doc = _document(content, "chatgpt-export")
    found, skipped, lost_all = [], 0, 0
    for c in doc if isinstance(doc, list) else [doc]:
        c = record(c) or {}
        raw = record(c.get("mapping"))
        nodes = {k: _node(v) for k, v in (raw or {}).items()}
        if raw is None or None in nodes.values() or not all(_opt(c, k, _str) for k in ("id", "conversation_id")) or not all(_opt(c, k, _str, null=True) for k in ("title", "current_node")) or not all(_opt(c, k, is_number, null=True) for k in ("create_time", "update_time")):
            skipped += 1
            continue
        tid = c.get("id", c.get("conversation_id", f"chatgpt-{len(found) + 1}"))
        path = _leaf_chain(nodes, c.get("current_node"))
        lost = sum(1 for k in nodes.keys() - set(path) if _spoken(nodes[k]["message"]))
        lost_all += lost
        ms = lambda holder, key: rounded(holder[key] * 1000) if is_number(holder.get(key)) and holder[key] > 0 else None
        out: list[dict] = []
        for k in path:
            m = nodes[k]["message"]
            parts = _spoken(m)
            if not parts:
                continue
            began = c.get("create_time")
            at = ms(m, "create_time") or (out[-1]["ts_ms"] if out else rounded(began * 1000) if is_number(began) else now_ms)
            role = m["author"]["role"]
            extra = {"model": string((m.get("metadata") or {}).get("model_slug")), "provider": "openai"} if role == "assistant" else {}
            out.append(message(m["id"], tid, role, at, content=parts, **extra))
        if out:
            custom = dump({"chatgptAbandonedBranchMessages": lost}) if lost else None
            found.append((conversation(tid, "chatgpt-export", out, title=c.get("title"), custom=custom, created_at=ms(c, "create_time"), updated_at=ms(c, "update_time")), out))
    said = [f"chatgpt-export: skipped {skipped} conversation(s) of another shape"] if skipped else []
    return found, said + ([f"chatgpt-export: {lost_all} message(s) on other branches were not imported"] if lost_all else [])


def _micros(value) -> int | None:
    """Milliseconds of microseconds between 1980 and 2100; other numbers are of another unit."""
    return rounded(value / 1000) if is_number(value) and math.isfinite(value) and 315_360_000_000_000 <= value <= 4_102_444_800_000_000 else None


class _Muse:
    """Reads the events of one export in order."""

    MAPPED = {"started", "assistant_message_committed", "assistant_tool_calls_committed", "tool_result_batch_committed", "reasoning_committed", "model_response_created", "model_completed"}

    def __init__(self, tid: str, now_ms: int):
        self.tid, self.now_ms, self.mint = tid, now_ms, _Ids(tid)
        self.out: list[dict] = []
        self.taken: set[str] = set()
        self.open: dict[str, dict] = {}
        self.waiting: dict[str, dict] = {}
        self.names: dict[str, str] = {}
        self.response: str | None = None
        self.facts: dict[str, str] = {}
        self.began = self.ended = None
        self.counts = dict.fromkeys(("gaps", "undecodable", "encrypted", "malformed", "orphaned"), 0)

    def unique(self, wanted: str) -> str:
        own = wanted
        while own in self.taken:
            own = self.mint(wanted)
        self.taken.add(own)
        return own

    def complete(self, m: dict, c: dict) -> None:
        for key in ("usage", "model", "finish_reason"):
            if c[key] is not None:
                m[key] = c[key]
        if c["raw"] is not None:
            m["metadata"] = dump({"museTokenUsage": c["raw"]})

    def assistant(self, response: str, at: int) -> dict:
        if response not in self.open:
            m = message(self.unique(response), self.tid, "assistant", at, content=[])
            self.open[response] = m
            self.out.append(m)
            if response in self.waiting:
                self.complete(m, self.waiting.pop(response))
        return self.open[response]

    @staticmethod
    def valid(e) -> bool:
        """Whether a run event has the shape of its kind."""
        if not isinstance(e, dict):
            return False
        kind, texts = e.get("kind"), lambda *names: all(_opt(e, n, _str) for n in names)
        items = lambda name, ok: isinstance(e.get(name), list) and all(isinstance(x, dict) and ok(x) for x in e[name])
        if kind == "model_completed":
            u = e.get("usage", {})
            return texts("model") and _opt(e, "finish_reason", _str, null=True) and isinstance(u, dict) and all(_opt(u, k, is_number) for k in ("input_tokens", "output_tokens", "cached_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"))
        return {
            "started": lambda: texts("prompt"),
            "model_response_created": lambda: isinstance(e.get("response_id"), str),
            "reasoning_committed": lambda: texts("response_id", "text", "encrypted_content"),
            "assistant_message_committed": lambda: texts("response_id") and isinstance(e.get("text"), str),
            "assistant_tool_calls_committed": lambda: texts("response_id") and items("tool_calls", lambda x: isinstance(x.get("name"), str) and all(_opt(x, k, _str) for k in ("id", "call_id", "args"))),
            "tool_result_batch_committed": lambda: items("results", lambda x: all(_opt(x, k, _str) for k in ("tool_call_id", "text"))),
            "terminal": lambda: True,
        }.get(kind if isinstance(kind, str) else "", lambda: False)()

    def event(self, e: dict) -> None:
        if e.get("kind") != "record":
            self.counts["gaps"] += 1
            return
        if "envelope" not in e:
            self.counts["undecodable"] += 1
            return
        env = e["envelope"]
        at = _micros(env.get("recorded_at")) or _micros(e.get("recorded_at")) or self.ended
        if at is not None:
            self.began = at if self.began is None else self.began
            self.ended = at
        p = record(env.get("payload"))
        if p is None:
            self.counts["undecodable"] += 1
            return
        kind, rec = p.get("kind"), record(p.get("record")) or {}
        if kind == "metadata":
            build = record(rec.get("build")) or {}
            for key, v in (("cwd", rec.get("workspace_root")), ("provider", rec.get("provider_id")), ("model", rec.get("model_id")), ("version", build.get("semver"))):
                if isinstance(v, str):
                    self.facts.setdefault(key, v)
        elif kind == "workspace_branch":
            ref = record(rec.get("reference")) or {}
            if ref.get("kind") == "branch" and isinstance(ref.get("name"), str):
                self.facts["branch"] = ref["name"]
        elif kind == "run":
            run = p.get("event")
            if self.valid(run):
                self.run(run, env, at or (self.out[-1]["ts_ms"] if self.out else self.now_ms))
            elif isinstance((record(run) or {}).get("kind"), str) and run["kind"] in self.MAPPED:
                self.counts["malformed"] += 1

    def run(self, e: dict, env: dict, at: int) -> None:
        kind = e["kind"]
        own = lambda: self.unique(env["id"] if "id" in env else self.mint())
        response = e.get("response_id", self.response)
        if kind == "started":
            self.open.clear()
            self.response = None
            if e.get("prompt"):
                self.out.append(message(own(), self.tid, "user", at, content=[text_part(e["prompt"])]))
        elif kind == "model_response_created":
            self.response = e["response_id"]
        elif kind == "reasoning_committed" and response is not None:
            if e.get("text"):
                self.assistant(response, at)["content"].append(reasoning_part(e["text"]))
            elif e.get("encrypted_content"):
                self.counts["encrypted"] += 1
        elif kind == "assistant_message_committed" and response is not None and e["text"]:
            self.assistant(response, at)["content"].append(text_part(e["text"]))
        elif kind == "assistant_tool_calls_committed" and response is not None and e["tool_calls"]:
            m = self.assistant(response, at)
            for c in e["tool_calls"]:
                call = nonempty(c.get("call_id")) or nonempty(c.get("id")) or self.mint()
                self.names[call] = c["name"]
                given = c.get("args", "")
                m["content"].append(call_part(call, c["name"], given, dump_record(try_parse(given))))
        elif kind == "tool_result_batch_committed":
            results = [result(r["tool_call_id"], self.names.get(r["tool_call_id"], ""), [text_part(r.get("text", ""))]) for r in e["results"] if nonempty(r.get("tool_call_id"))]
            if results:
                self.out.append(message(own(), self.tid, "tool", at, tool_results=results))
            self.open.clear()
        elif kind == "model_completed":
            if self.response is None:
                self.counts["orphaned"] += 1
                return
            raw, reason = e.get("usage"), e.get("finish_reason")
            c = {"usage": _muse_usage(raw) if raw is not None else None, "raw": raw, "model": e.get("model"), "finish_reason": reason if reason in FINISH_REASONS else None}
            if self.response in self.open:
                self.complete(self.open[self.response], c)
            else:
                self.waiting[self.response] = c
        elif kind == "terminal":
            self.open.clear()


def _muse_usage(raw: dict) -> dict | None:
    i, o = count(raw.get("input_tokens")), count(raw.get("output_tokens"))
    if i is None or o is None:
        return None
    read = count(raw.get("cache_read_tokens"))
    read = (count(raw.get("cached_tokens")) or 0) if read is None else read
    write = count(raw.get("cache_write_tokens")) or 0
    return _usage(max(0, i - read - write), o, count(raw.get("reasoning_tokens")), read, write)


def muse(content: str, now_ms: int = 0, session_id: str | None = None) -> Conversations:
    """Session exports: a log of records of which the run events make the conversation."""
    doc = _document(content, "muse")

    def fits(e):
        env = e.get("envelope", {}) if isinstance(e, dict) else None
        return isinstance(env, dict) and _opt(e, "kind", _str) and _opt(e, "recorded_at", is_number) and _opt(env, "id", _str) and _opt(env, "payload_type", _str) and _opt(env, "sequence", is_number) and _opt(env, "recorded_at", is_number)

    sessions, events = (doc.get("sessions", []), doc.get("events", [])) if isinstance(doc, dict) else (None, None)
    exporter = doc.get("exporter_version", {}) if isinstance(doc, dict) else None
    if (
        not isinstance(doc, dict) or not is_number(doc.get("export_schema_version")) or not isinstance(sessions, list) or not isinstance(events, list) or not _opt(doc, "session_terminated_abnormally", lambda v: isinstance(v, bool))
        or not all(isinstance(s, dict) and _opt(s, "session_id", _str) for s in sessions) or not all(map(fits, events)) or not isinstance(exporter, dict) or not all(_opt(exporter, k, _str) for k in ("semver", "sha"))
    ):
        raise Invalid("muse: not a session export")
    tid = next((s["session_id"] for s in sessions if "session_id" in s), "muse-session")
    r = _Muse(tid, now_ms)
    for e in events:
        r.event(e)
    if not r.out:
        raise NoConversation("muse: nothing to import")
    for m in r.out:
        if m["role"] == "assistant":
            m["model"] = r.facts.get("model") if m["model"] is None else m["model"]
            m["provider"] = r.facts.get("provider")
    n = r.counts
    custom: dict = {}
    for key, name in (("encrypted", "museEncryptedReasoningDropped"), ("malformed", "museMalformedRunEventsDropped"), ("orphaned", "museOrphanedCompletionsDropped")):
        if n[key]:
            custom[name] = n[key]
    if doc.get("session_terminated_abnormally"):
        custom["museSessionTerminatedAbnormally"] = True
    said = [
        f"muse: {k} {what}"
        for k, what in (
            (n["encrypted"], "reasoning event(s) with encrypted content only were not imported"),
            (n["gaps"], "gap marker(s) without a record"),
            (n["undecodable"], "record(s) without a readable payload were skipped"),
            (len(r.waiting), "response(s) reported usage but gave no message; that usage is not represented"),
            (len(sessions) if len(sessions) > 1 else 0, f"sessions were imported into one conversation ({tid})"),
            (n["malformed"], "run event(s) of a known kind but another shape were dropped"),
            (n["orphaned"], "completion(s) without a response were dropped"),
        )
        if k
    ]
    branch = r.facts.get("branch")
    git = {"repo": None, "branch": branch, "commit": None} if branch else None
    t = conversation(tid, "muse", r.out, source_version=r.facts.get("version"), cwd=r.facts.get("cwd"), git=git, custom=dump(custom) if custom else None, created_at=r.began, updated_at=r.ended)
    return [(t, r.out)], said


# --- canonical JSON -------------------------------------------------------------------------------------------


def _must(ok: bool, where: str) -> None:
    if not ok:
        raise Invalid(f"conversation: {where}")


def _text(d: dict, key: str, where: str, least: int = 0, optional: bool = False) -> str | None:
    if optional and key not in d:
        return None
    _must(isinstance(d.get(key), str) and len(d[key]) >= least, f"{where}.{key}")
    return d[key]


def _whole(d: dict, key: str, where: str, least: int = 0, optional: bool = False) -> int | None:
    if optional and key not in d:
        return None
    n = count(d.get(key))
    _must(n is not None and n >= least, f"{where}.{key}")
    return n


def _open(d: dict, key: str, where: str) -> str | None:
    if key not in d:
        return None
    _must(isinstance(d[key], dict), f"{where}.{key}")
    return dump(d[key])


def _array(d: dict, key: str, where: str) -> list[dict]:
    _must(isinstance(d.get(key), list) and all(isinstance(x, dict) for x in d[key]), f"{where}.{key}")
    return d[key]


def _image_in(d: dict, where: str) -> dict:
    _must(_opt(d, "detail", lambda v: v in DETAILS), f"{where}.detail")
    return image_part(_text(d, "data", where), _text(d, "mediaType", where), d.get("detail"))


def _content_in(d: dict, where: str) -> dict:
    kind = d.get("type")
    _must(kind in ("text", "image", "file"), f"{where}.type")
    if kind == "text":
        return text_part(_text(d, "text", where)) | {"annotations": dump(d["annotations"]) if "annotations" in d else None}
    if kind == "image":
        return _image_in(d, where)
    return file_part(_text(d, "name", where), _text(d, "mediaType", where), _text(d, "data", where), _whole(d, "size", where, optional=True))


def _assistant_in(d: dict, where: str) -> dict:
    kind = d.get("type")
    _must(kind in ("text", "reasoning", "tool_call", "image"), f"{where}.type")
    if kind == "text":
        return text_part(_text(d, "text", where))
    inner = {"reasoning": "reasoning", "tool_call": "toolCall", "image": "image"}[kind]
    x = d.get(inner)
    _must(isinstance(x, dict), f"{where}.{inner}")
    if kind == "image":
        _must(x.get("type") == "image", f"{where}.image.type")
        return _image_in(x, f"{where}.image")
    if kind == "reasoning":
        _must(x.get("type") == "reasoning", f"{where}.reasoning.type")
        return reasoning_part(_text(x, "text", where, optional=True), _text(x, "signature", where, optional=True), _open(x, "providerMetadata", where))
    return call_part(_text(x, "id", where, 1), _text(x, "name", where), _text(x, "arguments", where), _open(x, "parsedArguments", where), _open(x, "derived", where))


def _message_in(d: dict, where: str) -> dict:
    role = d.get("role")
    _must(role in ("user", "assistant", "system", "tool"), f"{where}.role")
    out = message(_text(d, "id", where, 1), _text(d, "threadId", where, 1), role, _whole(d, "timestamp", where, 1), metadata=_open(d, "metadata", where))
    if role == "tool":
        out["tool_results"] = [
            result(_text(r, "toolCallId", where, 1), _text(r, "name", where), [_content_in(c, f"{where}.toolResults.content") for c in _array(r, "content", where)], r.get("isError"), _open(r, "structuredResult", where))
            for r in _array(d, "toolResults", where)
            if _must(_opt(r, "isError", lambda v: isinstance(v, bool)), f"{where}.isError") is None
        ]
        return out
    read = _assistant_in if role == "assistant" else _content_in
    out["content"] = [read(c, f"{where}.content[{i}]") for i, c in enumerate(_array(d, "content", where))]
    if role == "assistant":
        out["model"], out["provider"] = (_text(d, k, where, optional=True) for k in ("model", "provider"))
        _must(_opt(d, "finishReason", lambda v: v in FINISH_REASONS), f"{where}.finishReason")
        out["finish_reason"] = d.get("finishReason")
        if "usage" in d:
            _must(isinstance(d["usage"], dict), f"{where}.usage")
            u = d["usage"]
            out["usage"] = _usage(_whole(u, "inputTokens", where), _whole(u, "outputTokens", where), *(_whole(u, k, where, optional=True) for k in ("reasoningTokens", "cacheReadTokens", "cacheWriteTokens")))
    return out


def canonical(content: str, now_ms: int = 0, session_id: str | None = None) -> Conversations:
    """Canonical JSON, validated: Invalid tells the first field that breaks the schema."""
    d = _document(content, "conversation")
    _must(isinstance(d, dict), "not an object")
    messages = [_message_in(m, f"messages[{i}]") for i, m in enumerate(_array(d, "messages", "conversation"))]
    meta = d.get("metadata", {})
    _must(isinstance(meta, dict), "metadata")
    git, tags = meta.get("git"), meta.get("tags")
    _must("git" not in meta or isinstance(git, dict), "metadata.git")
    _must("tags" not in meta or isinstance(tags, list) and all(map(_str, tags)), "metadata.tags")
    t = conversation(_text(d, "id", "conversation", 1), None, messages)
    t.update({k: _text(meta, name, "metadata", optional=True) for k, name in (("source", "source"), ("source_version", "sourceVersion"), ("title", "title"), ("cwd", "cwd"))})
    t.update(tags=tags, git={k: _text(git, k, "metadata.git", optional=True) for k in ("repo", "branch", "commit")} if git is not None else None, custom=_open(meta, "custom", "metadata"))
    t.update(created_at=_whole(d, "createdAt", "conversation", 1), updated_at=_whole(d, "updatedAt", "conversation", 1), schema_version=_text(d, "schemaVersion", "conversation", optional=True))
    return [(t, messages)], []


DOCUMENT_IMPORTERS = {"opencode": opencode, "muse": muse, "chatgpt-export": chatgpt, CANONICAL: canonical}
