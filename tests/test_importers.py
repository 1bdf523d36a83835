import copy
import json
import random

import pytest

from colloquy.functions import values as V
from colloquy.schema import CANONICAL
from colloquy.sources.detect import detect
from colloquy.sources.documents import canonical, chatgpt, muse, opencode
from colloquy.sources.jsonl import LINE_IMPORTERS, ClaudeCode, Codex, Kiro, NoConversation, Pi, derive_exec
from colloquy.sources.scan import import_text, read_docs, read_lines
from colloquy.streaming.importer import Session


def lines(*records):
    return [r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records]


def roles(messages):
    return [m["role"] for m in messages]


def said(kind, content, **rest):
    event = {k: rest.pop(k) for k in ("uuid", "timestamp", "isSidechain", "isMeta", "requestId", "sessionId") if k in rest}
    return {"type": kind, "sessionId": "s1", "message": {"role": kind, "content": content, **rest}} | event


CLAUDE = lines(
    {"type": "summary", "summary": "early", "leafUuid": "x"},
    said("user", "hello", uuid="u1", timestamp="2026-01-01T10:00:00.500Z"),
    said("user", "injected", uuid="u2", isMeta=True),
    said("assistant", [{"type": "thinking", "thinking": "hm", "signature": "sig"}], id="m1", usage={"input_tokens": 1, "output_tokens": 2, "service_tier": "standard"}, timestamp="2026-01-01T10:00:01Z"),
    "{broken",
    said("assistant", [{"type": "tool_use", "id": "t1", "name": "Bash", "input": {"b": 1.0, "a": [1, "x"], "2": 0}}, {"type": "odd"}], id="m1", usage={"input_tokens": 3, "output_tokens": 4, "cache_read_input_tokens": 5}, stop_reason="tool_use", model="x"),
    said("user", [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "ok"}], "is_error": True}, {"type": "text", "text": "and"}], uuid="u3"),
    said("user", [{"type": "tool_result", "tool_use_id": "t1", "content": "again"}], uuid="u4"),
    said("assistant", [{"type": "redacted_thinking", "data": "zzz"}], id="m1", isSidechain=True),
    said("assistant", "bad usage", usage={"input_tokens": -1}),
    {"type": "ai-title", "aiTitle": "late"},
)


def test_split_assistant_lines_become_one_message():
    c = ClaudeCode(now_ms=7)
    c.push(CLAUDE)
    t, m = c.conversation()
    assert (t["title"], t["conversation_id"], t["source"]) == ("late", "s1", "claude-code")
    assert roles(m) == ["user", "assistant", "tool", "user", "tool"]
    a = m[1]
    assert [p["type"] for p in a["content"]] == ["reasoning", "tool_call"]
    assert a["usage"] == {"input_tokens": 3, "output_tokens": 4, "reasoning_tokens": None, "cache_read_tokens": 5, "cache_write_tokens": None}
    assert a["metadata"] is None  # extras go with the usage that was replaced
    assert (a["finish_reason"], a["model"], a["ts_ms"]) == ("tool_calls", "x", 1767261601000)
    assert a["content"][1]["tool_call"]["arguments"] == '{"2":0,"b":1,"a":[1,"x"]}'
    assert [r["name"] for x in m if x["tool_results"] for r in x["tool_results"]] == ["Bash", ""]  # consumed once
    assert [x["message_id"] for x in m] == ["u1", "m1", "u3", "s1:1", "u4"]
    assert m[2]["tool_results"][0]["is_error"] is True and m[4]["tool_results"][0]["is_error"] is None
    assert c.warnings() == ["claude-code: skipped 2 unparseable or unrecognized conversation line(s)"]


def test_sidechains_only_if_asked():
    c = ClaudeCode(include_sidechains=True)
    c.push(CLAUDE)
    side = c.conversation()[1][-1]
    assert side["metadata"] == '{"sidechain":true}' and side["content"][0]["reasoning"]["provider_metadata"] == '{"redacted":true,"data":"zzz"}'


def item(**p):
    return {"type": "response_item", "timestamp": 1000, "payload": p}


def count(i, o, **rest):
    return {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": i, "output_tokens": o, **rest}}}}


CODEX = lines(
    item(type="message", role="developer", content=[{"type": "input_text", "text": "hi"}]),
    {"type": "session_meta", "payload": {"id": "real", "cwd": "/w", "model_provider": "openai"}},
    item(type="reasoning", summary=[{"text": "a"}, {"text": ""}, {"text": "b"}]),
    {"type": "turn_context", "payload": {"model": "m1"}},
    {"type": "event_msg", "payload": {"type": "agent_message", "message": "same"}},
    item(type="message", role="assistant", content=[{"type": "output_text", "text": "same"}]),
    item(type="custom_tool_call", name="exec", call_id="c1", input='await tools.exec_command({cmd: "ls -l"})'),
    item(type="function_call_output", call_id="c1", output='{"output":"fine","metadata":{}}'),
    count(10, 3, cached_input_tokens=12),
    count(7, 1),
    {"type": "event_msg", "payload": {"type": "agent_message", "message": "bye"}},
)


def test_rollout_folds_and_attributes_tokens():
    c = Codex(now_ms=9)
    assert [m["message_id"] for m in c.push(CODEX)] == ["real:1", "real:2", "real:3"]
    t, m = c.conversation()
    assert roles(m) == ["user", "assistant", "tool", "assistant"]
    first = m[1]
    assert [p["type"] for p in first["content"]] == ["reasoning", "text", "tool_call"]  # the echo is dropped
    assert first["usage"]["input_tokens"] == 0 and first["usage"]["cache_read_tokens"] == 12
    assert json.loads(first["metadata"])["codexTokenUsageInconsistent"] is True
    assert json.loads(first["content"][2]["tool_call"]["derived"]) == {"codexExec": {"operation": "exec_command", "commands": ["ls -l"], "heuristic": True}}
    assert m[2]["tool_results"][0] == {"tool_call_id": "c1", "name": "exec", "content": [{"type": "text", "text": "fine"}], "is_error": None, "structured_result": None}
    assert m[3]["usage"]["input_tokens"] == 7  # held for the message that follows
    assert [x["model"] for x in m if x["role"] == "assistant"] == ["m1", "m1"]
    assert {x["conversation_id"] for x in m} == {"real"}


def test_counts_without_a_message_are_summed_up():
    c = Codex()
    c.push(lines({"type": "session_meta", "payload": {"id": "s"}}, count(5, 1), count(6, 2), item(type="message", role="user", content=[{"type": "input_text", "text": "x"}])))
    c.finalize()
    lost = json.loads(c.conversation()[0]["custom"])["codexUnattributedUsage"]
    assert (lost["inputTokens"], lost["outputTokens"], lost["events"]) == (11, 3, 2)


@pytest.mark.parametrize(("form", "source"), [("claude-code", CLAUDE), ("codex", CODEX)])
def test_chunks_saved_and_restored_give_the_same(form, source):
    make = LINE_IMPORTERS[form]
    whole = make(now_ms=3)
    announced = whole.push(source) + whole.finalize()
    for seed in range(20):
        rng, at, c, got = random.Random(seed), 0, make(now_ms=3), []
        while at < len(source):
            n = rng.randint(1, 4)
            got += [m["message_id"] for m in c.push(source[at : at + n])]
            before = copy.deepcopy(c.state())
            if c.s["events"] and (c.s["messages"] or c.s.get("open")):
                c.conversation()
            assert c.state() == before  # asking changes nothing
            c = make(now_ms=3, state=json.loads(json.dumps(c.state())))
            at += n
        got += [m["message_id"] for m in c.finalize()]
        assert c.conversation() == whole.conversation()
        assert got == [m["message_id"] for m in announced]
    with pytest.raises(ValueError):
        make(state={"format": "other"})


def test_exec_scrape_is_careful():
    assert derive_exec("map(x)") is None
    assert derive_exec("tools.a(1); tools.b({cmd: `x ${y}`})") == {"operation": "mixed", "operations": ["a", "b"]}
    assert derive_exec("""tools.a({"cmd": ["ls", "-l"], 'cmd': 'one'}); cmd: `two`""")["commands"] == ["ls -l", "one", "two"]
    many = derive_exec("tools.a();" + 'cmd: "x" ' * 40)
    assert len(many["commands"]) == 32 and many["commandsTruncated"]
    assert derive_exec("""tools.a({my_cmd: "no", "x-cmd": "no", "cmd': "no", cmd : "a\\"b\\n", cmd: [bad], cmd: "open""")["commands"] == ['a"b\n']
    assert derive_exec("tools.a({cmd: 'it\\'s', cmd: ``, cmd: [1, \"x]\"]})")["commands"] == ["it\\'s"]
    assert "commandsTruncated" not in derive_exec("tools.a();" + 'cmd: "x" ' * 32)
    assert derive_exec('tools.a({cmd: "' + "y\\n" * 100_000 + '"})')["commands"][0].startswith("y\ny")


def test_kiro_inherits_seconds():
    k = Kiro(now_ms=1, session_id="f")
    part = lambda kind, data: {"kind": kind, "data": data}
    k.push(lines(
        {"kind": "Prompt", "data": {"meta": {"timestamp": 5.0004}, "content": [part("text", "q"), part("image", {"format": "gif", "source": {"data": [1, 2, 255]}})]}},
        {"kind": "AssistantMessage", "data": {"message_id": "a", "content": [part("thinking", {"text": "t"}), part("toolUse", {"toolUseId": "x", "name": "n", "input": {"k": 1}})]}},
        {"kind": "ToolResults", "data": {"content": [part("toolResult", {"toolUseId": "x", "status": "error", "content": [part("json", {"z": [1]}), part("text", "t")]})]}},
        {"kind": "Compaction"}, {"kind": "Prompt"}, {"kind": "AssistantMessage", "data": {"content": []}},
    ))
    t, m = k.conversation()
    assert roles(m) == ["user", "assistant", "tool"] and {x["ts_ms"] for x in m} == {5000} and t["conversation_id"] == "f"
    assert m[0]["content"][1]["data"] == "AQL/" and m[0]["content"][1]["media_type"] == "image/gif"
    assert m[2]["tool_results"][0]["name"] == "" and m[2]["tool_results"][0]["is_error"] is True
    assert [p["text"] for p in m[2]["tool_results"][0]["content"]] == ['{"z":[1]}', "t"]
    assert k.s["skipped"] == 2


def test_pi_keeps_failed_turns():
    p = Pi(now_ms=1)
    turn = lambda **m: {"type": "message", "id": m.pop("id", None) or "i", "parentId": None, "message": m}
    p.push(lines(
        turn(role="user", content="q", timestamp=100), {"type": "session", "id": "sid", "version": 3, "cwd": "/w"}, turn(role="assistant", content=[], stopReason="error", errorMessage="boom"), turn(role="assistant", content=[]),
        turn(role="assistant", content=[{"type": "text", "text": "a"}], usage={"input": 1.5, "output": 2, "cacheRead": -1}, stopReason="toolUse"), turn(role="toolResult", toolCallId="c", content=[{"type": "image"}, {"type": "text", "text": "t"}], isError=True),
    ))
    t, m = p.conversation()
    assert roles(m) == ["user", "assistant", "assistant", "tool"] and t["conversation_id"] == "sid" and t["source_version"] == "3"
    assert m[1]["finish_reason"] == "error" and m[1]["metadata"] == '{"errorMessage":"boom"}' and p.s["skipped"] == 1
    assert m[2]["usage"]["input_tokens"] == 2 and m[2]["usage"]["cache_read_tokens"] is None
    assert m[3]["tool_results"][0]["content"][0]["text"] == "[image]\nt" and {x["conversation_id"] for x in m} == {"sid"}


def test_opencode_splits_calls_and_results():
    doc = {"info": {"id": "o", "time": {"created": 10}}, "messages": [
        {"info": {"role": "user", "id": "u", "time": {"created": 20}}, "parts": [{"type": "file", "url": "f"}]},
        {"info": {"role": "assistant", "time": {"created": 30, "completed": 40}, "tokens": {"input": 2.5, "output": -1}}, "parts": [{"type": "tool", "tool": "sh", "state": {"status": "error", "error": "bad", "input": {"a": 1}}}, {"type": "step-start"}]},
    ]}
    [(t, m)], _ = opencode(json.dumps(doc))
    assert roles(m) == ["user", "assistant", "tool"] and [x["ts_ms"] for x in m] == [20, 30, 40] and t["created_at"] == 10
    assert m[0]["content"][0] == {"type": "file", "name": "file", "media_type": "application/octet-stream", "data": "f", "size": None}
    assert m[1]["usage"]["input_tokens"] == 3 and m[1]["usage"]["output_tokens"] == 0
    assert m[2]["tool_results"][0]["is_error"] is True and m[2]["tool_results"][0]["content"][0]["text"] == "bad"
    with pytest.raises(ValueError, match="not a session export"):
        opencode("{}")


def muse_event(body, i="e", at=1_700_000_000_000_000):
    return {"kind": "record", "envelope": {"id": i, "recorded_at": at, "payload_type": "run", "payload": {"kind": "run", "event": body}}}


def test_muse_matches_completions_and_discloses_losses():
    doc = {"export_schema_version": 1, "sessions": [{"session_id": "m"}], "events": [
        muse_event({"kind": "model_completed"}), {"kind": "gap"}, {"kind": "record"}, muse_event({"kind": "started", "prompt": "go"}, "p"), muse_event({"kind": "model_response_created", "response_id": "r"}),
        muse_event({"kind": "model_completed", "usage": {"input_tokens": 9, "output_tokens": 1, "cached_tokens": 4}, "finish_reason": "stop"}), muse_event({"kind": "assistant_message_committed", "text": "a"}),
        muse_event({"kind": "assistant_tool_calls_committed", "tool_calls": [{"call_id": "", "id": "c", "name": "sh", "args": "{\"a\":1}"}]}), muse_event({"kind": "tool_result_batch_committed", "results": [{"tool_call_id": "c", "text": "t"}, {"tool_call_id": ""}]}),
        muse_event({"kind": "assistant_message_committed", "text": "b"}), muse_event({"kind": "reasoning_committed", "encrypted_content": "xx"}), muse_event({"kind": "assistant_message_committed"}),
    ]}
    [(t, m)], said = muse(json.dumps(doc))
    assert roles(m) == ["user", "assistant", "tool", "assistant"] and [x["message_id"] for x in m] == ["p", "r", "e", "r:1"]
    assert m[1]["usage"]["input_tokens"] == 5 and m[1]["finish_reason"] == "stop" and m[2]["tool_results"][0]["name"] == "sh"
    assert json.loads(t["custom"]) == {"museEncryptedReasoningDropped": 1, "museMalformedRunEventsDropped": 1, "museOrphanedCompletionsDropped": 1}
    assert len(said) == 5


def chat_node(parent, role="user", text="t", **rest):
    return {"parent": parent, "children": [], "message": {"id": rest.pop("id", "i"), "author": {"role": role}, "content": {"content_type": "text", "parts": [text]}, **rest}}


def test_chatgpt_walks_to_the_root():
    nodes = {"r": {"parent": None, "children": ["a"]}, "a": chat_node("r", id="1", create_time=2.0004), "b": chat_node("a", "assistant", id="2", metadata={"model_slug": "g"}), "x": chat_node("a", "assistant", id="3"), "h": chat_node("a", id="4", metadata={"is_visually_hidden_from_conversation": True})}
    nodes["a"]["children"] = {"bad": 1}
    [(t, m)], said = chatgpt(json.dumps([{"id": "c", "current_node": "b", "mapping": nodes}, {"mapping": 3}]))
    assert [x["message_id"] for x in m] == ["1", "2"] and m[1]["model"] == "g" and {x["ts_ms"] for x in m} == {2000}
    assert t["custom"] == '{"chatgptAbandonedBranchMessages":1}' and len(said) == 2
    loop = {"p": chat_node("q", id="1"), "q": chat_node("p", id="2")}
    [(_, m)], _ = chatgpt(json.dumps({"current_node": "p", "mapping": loop}), 5)
    assert [x["message_id"] for x in m] == ["2", "1"]
    deep = {str(i): chat_node(str(i - 1) if i else None, id=str(i)) for i in range(3000)}
    assert len(chatgpt(json.dumps({"current_node": "2999", "mapping": deep}), 1)[0][0][1]) == 3000
    assert chatgpt("[]") == ([], [])


CANONICAL_DOC = {"id": "t", "messages": [{"id": "1", "threadId": "t", "role": "user", "timestamp": 5, "content": [{"type": "text", "text": "x"}]}], "createdAt": 1, "updatedAt": 2}


def test_canonical_json_is_validated():
    assert canonical(json.dumps(CANONICAL_DOC))[0][0][1][0]["content"] == [{"type": "text", "text": "x", "annotations": None}]
    for path, value, where in ((("id",), "", "conversation.id"), (("messages", 0, "role"), "robot", "role"), (("messages", 0, "timestamp"), 0, "timestamp"), (("createdAt",), 1.5, "createdAt"), (("messages", 0, "content", 0, "type"), "video", "type")):
        bad = copy.deepcopy(CANONICAL_DOC)
        at = bad
        for p in path[:-1]:
            at = at[p]
        at[path[-1]] = value
        with pytest.raises(ValueError, match=where.replace(".", r"\.")):
            canonical(json.dumps(bad))


@pytest.mark.parametrize(("text", "form"), [
    ("\n".join(CLAUDE), "claude-code"), ("\n".join(CODEX), "codex"), ('{"kind":"Prompt","data":1}', "kiro"), ('{"type":"session","cwd":1,"version":2}', "pi"), ('[{"mapping":{}}]', "chatgpt-export"), ('{"export_schema_version":1,"events":[],"sessions":[]}', "muse"),
    (json.dumps(CANONICAL_DOC), CANONICAL), ('{"info":{},"messages":[]}', "opencode"), ("", None), ("not json", None), ("[1]", None), ('{"a":1}\n{"type":"session_meta"}', "codex"), ('{"kind":7,"data":1}', None), ('{"type":["x"]}', None),
])
def test_detection(text, form):
    assert detect(text) == form


@pytest.mark.parametrize("form", ["claude-code", "codex", "kiro", "pi"])
def test_files_without_conversation_are_not_failures(form):
    with pytest.raises(NoConversation):
        LINE_IMPORTERS[form]().conversation()
    assert [r["status"] for r in import_text("", "f", form=form)] == ["no_conversation"]
    assert [r["status"] for r in import_text("{}", "f", form="opencode")] == ["failed"]
    assert [r["status"] for r in import_text("[]", "f", form="chatgpt-export")] == ["empty"]
    assert [r["status"] for r in import_text("???", "f")] == ["failed"]


def test_values_are_strict():
    assert V.dump(json.loads('{"b":1.0,"a":1e2,"10":[],"9":null,"c":1.5e-7,"d":1e21}')) == '{"9":null,"10":[],"b":1,"a":100,"c":1.5e-7,"d":1e+21}'
    assert V.dump("\ud800é ") == '"�é "'
    assert [V.timestamp(x) for x in ("2026-01-01T00:00:00Z", "2026-01-01", "2026-01-01T01:00:00.1234+01:00", "x", 0, 1.5, True, None, float("nan"))] == [1767225600000, 1767225600000, 1767225600123, None, None, 2, None, None, None]
    assert V.count(5.0) == 5 and V.count(True) is None and V.count(-1) is None and V.count("1") is None
    with pytest.raises(ValueError):
        V.parse_json("NaN")


def test_files_keep_the_order_they_are_given_in(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "same name.jsonl").write_text(name)
    few = [str(tmp_path / n / "same name.jsonl") for n in ("b", "a")]
    other = tmp_path / "other.jsonl"
    other.write_text("x")
    for paths in (few, few + [str(other)] * 1000):
        for rows in (read_docs(spark, paths).withColumnRenamed("content", "value"), read_lines(spark, paths)):
            got = {r["value"]: r["file_ord"] for r in rows.collect()}
            assert (got["b"], got["a"], got.get("x", 2)) == (0, 1, 2)
    for i in range(1500):  # more than a few
        (tmp_path / f"{i}.txt").write_text(str(i))
    given = [str(tmp_path / f"{i}.txt") for i in reversed(range(1500))]
    assert {r["content"]: r["file_ord"] for r in read_docs(spark, given).collect()} == {str(i): 1499 - i for i in range(1500)}
    mixed = read_docs(spark, [str(tmp_path / "[12]5.txt"), str(tmp_path / "a"), f"file://{tmp_path}/7.txt", str(tmp_path / "b")])
    assert {r["content"]: r["file_ord"] for r in mixed.collect()} == {"15": 0, "25": 0, "a": 1, "7": 2, "b": 3}


def turns(form, n):
    """A long transcript of one format: prompts, answers, calls and results, the header late."""
    out = []
    for i in range(n):
        if form == "claude-code":
            out += lines(said("user", f"q{i}", uuid=f"u{i}"), said("assistant", [{"type": "text", "text": f"a{i}"}], id=f"m{i}", usage={"input_tokens": i, "output_tokens": 1}), said("assistant", [{"type": "tool_use", "id": f"c{i}", "name": "N", "input": {}}], id=f"m{i}"), said("user", [{"type": "tool_result", "tool_use_id": f"c{i}", "content": "r"}]))
        elif form == "codex":
            item = lambda **p: {"type": "response_item", "payload": p}
            out += lines(item(type="message", role="user", content=[{"type": "input_text", "text": f"q{i}"}]), item(type="message", role="assistant", content=[{"type": "output_text", "text": f"a{i}"}]), item(type="function_call", name="f", call_id=f"c{i}", arguments="{}"), item(type="function_call_output", call_id=f"c{i}", output="r"), {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": i, "output_tokens": 2}}}})
            out += lines({"type": "turn_context", "payload": {"model": "m"}}) if i == 3 else lines({"type": "session_meta", "payload": {"id": "late"}}) if i == 5 else []
        elif form == "kiro":
            out += lines({"kind": "Prompt", "data": {"meta": {"timestamp": i + 1}, "content": [{"kind": "text", "data": f"q{i}"}]}}, {"kind": "AssistantMessage", "data": {"message_id": f"a{i}", "content": [{"kind": "text", "data": f"a{i}"}]}})
        else:
            turn = lambda role, text: {"type": "message", "id": f"{role}{i}", "parentId": None, "message": {"role": role, "content": [{"type": "text", "text": text}]}}
            out += lines(turn("user", f"q{i}"), turn("assistant", f"a{i}")) + (lines({"type": "session", "id": "late", "cwd": "/", "version": 3}) if i == 5 else [])
    return out


@pytest.mark.parametrize("form", list(LINE_IMPORTERS))
def test_sessions_read_and_write_only_what_lines_touch(form):
    own, saved, kept, now, heads = turns(form, 40), None, {}, {}, None
    read, written = [], []
    for k in range(0, len(own) + 1, 3):
        part = own[k : k + 3] if k + 3 <= len(own) else [*own[k:], None]
        loads = []
        session = Session(form, "f.jsonl", 3, saved, lambda i, loads=loads, kept=kept: loads.append(i) or kept[i])
        rows, keep = session.push(part)
        kept.update(keep)
        saved = session.save()
        assert len({r[2] for r in rows}) == len(rows)
        for _, conversation, seq, _, text in rows:
            now[seq] = (conversation, json.loads(text))
        if k > 60:  # a late header names all that came before
            read.append(len(set(loads)))
            written.append(len(keep))
        whole = LINE_IMPORTERS[form](3, "f")
        whole.push([x for x in own[: k + 3]])
        if part[-1] is None:
            whole.finalize()
        try:
            head, messages = whole.conversation()
        except NoConversation:
            continue
        assert now[-1][1]["conversation"] == head
        assert [now[i][1] for i in range(len(messages))] == messages and len(now) == len(messages) + 1
    assert max(read) <= 12 and max(written) <= 12 and len(now) > 80 - 2
