import json
import random

import pytest
from pyspark.sql import functions as F

from colloquy import builders as B
from colloquy import cli, queries, schema
from colloquy.functions import columns as C
from colloquy.operators import inspect as summaries
from colloquy.operators import sequence, tool_calls, usage
from colloquy.plans import export
from colloquy.schema import CANONICAL
from colloquy.sources import scan
from colloquy.streaming import importer as streaming
from tests.conftest import DATA
from tests.test_importers import CLAUDE, CODEX


def tokens(i, o, **rest):
    return {"input_tokens": i, "output_tokens": o, "reasoning_tokens": None, "cache_read_tokens": None, "cache_write_tokens": None} | rest


def frame(spark, *conversations):
    return spark.createDataFrame(list(conversations), schema.IMPORTED)


def call(call_id, name, arguments="{}", parsed=None, derived=None):
    return schema.call_part(call_id, name, arguments, parsed, derived)


@pytest.fixture(scope="module")
def sample(spark):
    t = "t"
    m = [
        B.system(t, "be brief", message_id="0", ts_ms=1),
        B.user(t, [schema.text_part("look"), schema.text_part(""), schema.image_part("aGk=", "image/png"), schema.image_part("https://x/y.png", "image/*"), schema.file_part("f.txt", "text/plain", "u")], message_id="1", ts_ms=1_700_000_000_001),
        B.assistant(t, [schema.reasoning_part("why", "sig"), schema.reasoning_part("unsigned"), schema.reasoning_part(None, None, '{"redacted":true,"data":"zz"}'), schema.text_part("so"), call("c1", "sh", '{"command": "ls,\\"x\\""}', '{"command":"ls,\\"x\\""}'), call("c2", "exec", "tools.a()", None, '{"codexExec":{"operation":"a","commands":["do"]}}')], message_id="2", ts_ms=1_700_000_000_002, model="m", usage=tokens(1, 2)),
        B.tool(t, [schema.result("c1", "", [schema.text_part("a😀```"), schema.image_part("d", "image/png")])], message_id="3", ts_ms=1_700_000_000_003),
        B.user(t, "", message_id="4", ts_ms=1_700_000_000_004),
        B.tool(t, [schema.result("c1", "", [schema.text_part("last")], True)], message_id="5", ts_ms=1_700_000_000_005),
        B.assistant(t, [call("c1", "again"), call("c3", "w", "[1]")], message_id="6", ts_ms=1_700_000_000_006),
    ]
    return frame(spark, B.conversation(m, t, "src", title='a "q"', git={"repo": None, "branch": "main", "commit": None})).cache()


def body(df, form, **options):
    return export.export(df, form, **options).first()["body"]


def test_first_copy_counts_and_later_ones_are_told(spark):
    a = lambda i, model, use, ts=1000: B.assistant("t", "x", message_id=i, ts_ms=ts, model=model, usage=use)
    one = B.conversation([a("1", "m", tokens(5, 1)), a("2", None, None), a("3", "m", tokens(1, 1, reasoning_tokens=4)), B.user("t", "u", message_id="9", ts_ms=1)], "t")
    two = B.conversation([a("1", "other", tokens(9, 9)), a("4", "m", tokens(2, 2), 999)], "t") | {"file": "later", "file_ord": 1}
    m = scan.messages(frame(spark, one, two))
    got = {r["key"]: r for r in usage.usage(m).collect()}
    assert list(got) == ["m", "other", "unknown"]
    assert (got["m"]["messages"], got["m"]["input_tokens"], got["m"]["reasoning_tokens"], got["m"]["reasoning_messages"]) == (3, 8, 4, 1)
    assert (got["other"]["messages"], got["other"]["duplicates_skipped"], got["other"]["input_tokens"], got["other"]["reasoning_tokens"]) == (0, 1, 0, None)
    assert got["unknown"]["messages_without_usage"] == 1
    assert {r["key"]: r["messages"] for r in usage.usage(m, since=1000).collect()}["m"] == 2  # inclusive
    table = usage.usage_table(usage.usage(m)).split("\n")
    assert table[0].split() == ["key", "messages", "noUsage", "inputTokens", "outputTokens", "cacheReadTokens", "cacheWriteTokens", "reasoningTokens"] and table[3].endswith("0")
    assert json.loads(usage.usage_json(usage.usage(m)))[1] == {"key": "other", "messages": 0, "messagesWithoutUsage": 0, "inputTokens": 0, "outputTokens": 0, "cacheReadTokens": 0, "cacheWriteTokens": 0, "duplicatesSkipped": 1}
    with pytest.raises(ValueError):
        usage.usage(m, "color")
    assert usage.window_start("2d", 200_000_000) == 27_200_000
    with pytest.raises(ValueError):
        usage.window_start("2w", 0)


def test_rows_pair_calls_with_their_last_result(sample):
    flat = tool_calls.tool_call_rows(sample).orderBy("_pos")
    rows = flat.collect()
    assert [(r["toolCallId"], r["tool"], r["isError"], r["resultChars"]) for r in rows] == [("c1", "sh", True, 4), ("c2", "exec", None, None), ("c3", "w", None, None)]
    lines = [json.loads(r["line"]) for r in tool_calls.rows_jsonl(flat).orderBy("_pos").collect()]
    assert lines[0]["parsedArguments"] == {"command": 'ls,"x"'} and lines[0]["isError"] is True and "isError" not in lines[1] and lines[1]["derived"]["codexExec"]["operation"] == "a"
    csv = [r["line"] for r in tool_calls.rows_csv(flat).orderBy("_pos").collect()]
    assert csv[0] == 'src,t,1700000000002,m,,sh,,"ls,""x""",true,4,,main' and csv[1] == "src,t,1700000000002,m,,exec,a,do,,,,main"
    assert tool_calls.tool_call_rows(sample, since=1_700_000_000_003).select("toolCallId").collect() == [("c3",)]


def planned(df, step):
    return df._jdf.queryExecution().executedPlan().toString().count(step)


def test_rows_of_calls_import_once(spark):
    docs = spark.createDataFrame([("a.jsonl", 0, "\n".join(CODEX))], "file string, file_ord int, content string")
    flat = tool_calls.tool_call_rows(scan.import_docs(docs, "codex", now_ms=1))
    assert planned(flat, "MapInArrow") == 1 and planned(flat, "Join") == 0
    assert flat.select("tool").collect()[0] == ("exec",)


def test_rows_keep_calls_without_an_id_and_the_first_of_one_message(spark):
    ids = [None, "a", "a", None]
    spoken = B.assistant("t", [call(i, f"n{k}") for k, i in enumerate(ids)], ts_ms=1)
    gave = [B.tool("t", [schema.result("a", "", [schema.text_part(text)], failed)], ts_ms=2) for text, failed in (("x", True), ("xyz", None))]
    lost = B.tool("t", [schema.result(None, "", [schema.text_part("w")])], ts_ms=3)
    flat = tool_calls.tool_call_rows(frame(spark, B.conversation([*gave, lost, spoken])))
    assert sorted(flat.select("tool", "isError", "resultChars").collect()) == [("n0", None, None), ("n1", False, 3)]


def test_summary_of_a_conversation(sample):
    r = summaries.summaries(sample).first()
    assert [(x["role"], x["n"]) for x in r["by_role"]] == [("system", 1), ("user", 2), ("assistant", 2), ("tool", 2)]
    assert (r["tool_calls"], r["preview"], r["created"]) == (4, "look ", "1970-01-01T00:00:00.001Z")
    assert "by role:   system=1 user=2 assistant=2 tool=2" in summaries.summary_text(r)


def test_openai_messages(sample):
    m = json.loads(body(sample, "openai-chat"))
    assert m[0] == {"role": "system", "content": "be brief"}
    assert m[1]["content"][0]["text"] == "look\n[file: f.txt (text/plain)]" and m[1]["content"][1]["image_url"]["url"] == "data:image/png;base64,aGk="
    assert m[2]["content"] == "so" and [c["function"]["name"] for c in m[2]["tool_calls"]] == ["sh", "exec"]
    assert m[3] == {"role": "tool", "content": "a😀```\n[image]", "tool_call_id": "c1"} and "content" not in m[5] and len(m) == 6


def test_anthropic_messages_alternate(sample):
    b = json.loads(body(sample, "anthropic-messages"))
    assert b["system"] == "be brief" and [m["role"] for m in b["messages"]] == ["user", "assistant", "user", "assistant"]
    kinds = [[c["type"] for c in m["content"]] for m in b["messages"]]
    assert kinds == [["text", "image", "image", "text"], ["thinking", "redacted_thinking", "text", "tool_use", "tool_use"], ["tool_result", "tool_result"], ["tool_use", "tool_use"]]
    assert b["messages"][1]["content"][3]["input"] == {"command": 'ls,"x"'} and b["messages"][1]["content"][4]["input"] == {} and b["messages"][3]["content"][1]["input"] == {}
    assert "is_error" not in b["messages"][2]["content"][0] and b["messages"][2]["content"][1]["is_error"] is True


def test_gemini_names_results_after_earlier_calls(sample):
    c = json.loads(body(sample, "gemini"))["contents"]
    assert [x["role"] for x in c] == ["user", "model", "user", "model"]
    assert [p["functionResponse"]["name"] for p in c[2]["parts"] if "functionResponse" in p] == ["sh", "sh"] and {"text": ""} in c[2]["parts"]
    assert c[0]["parts"][2] == {"inlineData": {"mimeType": "image/png", "data": "aGk="}} and c[0]["parts"][3] == {"text": "[image: https://x/y.png]"}


def test_gemini_finds_the_last_call_before_each_result(spark):
    rng, m = random.Random(5), []
    for k in range(300):
        ids = [rng.choice("abcdefgé") + str(rng.randrange(6)) for _ in range(rng.randrange(1, 4))]
        said = B.assistant("t", [call(i, f"n{k}-{j}") for j, i in enumerate(ids)]) if rng.random() < 0.4 else B.tool("t", [schema.result(i, "", [schema.text_part(i)]) for i in ids])
        m.append(said)
    named, want = {}, []
    for x in m:
        named |= {p["tool_call"]["id"]: p["tool_call"]["name"] for p in x["content"] or ()}
        want += [named.get(r["tool_call_id"], "unknown") for r in x["tool_results"] or ()]
    c = json.loads(body(frame(spark, B.conversation(m)), "gemini"))["contents"]
    assert [p["functionResponse"]["name"] for t in c for p in t["parts"] if "functionResponse" in p] == want


def test_all_formats_leave_in_one_pass(spark, sample):
    whole = export.exports(sample, export.FORMATS).first()
    assert all(whole[form] == body(sample, form) for form in export.FORMATS)
    found = queries.export_tools(spark, f"{DATA}/sf0.001")
    assert planned(found, "MapInArrow") == 1 and planned(found, "Join") == 0


def test_markdown_cannot_be_broken_out_of(sample):
    text = body(sample, "markdown")
    assert text.startswith('---\ntitle: "a \\"q\\""\nid: "t"\ncreated: 1970-01-01T00:00:00.001Z\n') and "\nbranch: \"main\"\n---\n\n## System" in text
    assert "**← result**\n\n````\na😀```\n[image]\n````\n" in text and "**← result (error)**" in text and "<details>" in text
    cut = body(sample, "markdown", max_result=3, metadata=False, timestamps=False, with_reasoning=False)
    assert "a😀\n… (11 more characters)" in cut and "<details>" not in cut and cut.startswith("## System\n\n")
    assert "**→" not in body(sample, "markdown", with_tools=False)


def test_canonical_json_round_trip(spark, sample):
    text = export.export(sample, CANONICAL).select(F.lit("f").alias("file"), F.lit(0).alias("file_ord"), F.col("body").alias("content"))
    back = scan.import_docs(text).first()
    have = sample.first()
    assert back["messages"] == have["messages"] and back["conversation"] == have["conversation"]
    assert [export.numbered("a/b.json", i, 2) for i in (0, 1)] == ["a/b-1.json", "a/b-2.json"] and export.numbered("b", 0, 1) == "b" and export.numbered("x.y/b", 1, 2) == "x.y/b-2"


def test_merging_alternates_and_loses_nothing(spark):
    rng = random.Random(4)
    cs = []
    for i in range(30):
        ms = [rng.choice((B.user, B.assistant, B.system))(f"t{i}", rng.choice(("", "x", "y\n")), message_id=str(j), ts_ms=1) for j in range(rng.randint(0, 9))]
        cs.append(B.conversation(ms, f"t{i}"))
    got = {r["conversation_id"]: json.loads(r["body"])["messages"] for r in export.export(frame(spark, *cs), "anthropic-messages").collect()}
    for c in cs:
        m = got[c["conversation"]["conversation_id"]]
        assert all(a["role"] != b["role"] for a, b in zip(m, m[1:], strict=False))
        want = [(x["role"], x["content"][0]["text"]) for x in c["messages"] if x["role"] != "system" and x["content"][0]["text"]]
        assert [(x["role"], p["text"]) for x in m for p in x["content"]] == want


def test_column_helpers(spark):
    df = spark.createDataFrame([("a😀b",), (None,), ("x``y",)], "s string")
    got = df.select(C.text_length(F.col("s")), C.text_prefix(F.col("s"), 3), C.json_text(F.col("s")), C.fence(F.col("s"))).collect()
    assert tuple(got[0]) == (4, "a😀", '"a😀b"', "```") and got[1][0] is None and got[1][2] is None and got[2][3] == "```"
    assert spark.range(1).select(C.iso(F.lit(1_700_000_000_123)), C.day(F.lit(-1))).first() == ("2023-11-14T22:13:20.123Z", "1969-12-31")


def test_sequences(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, None), ("a", 4, "y"), ("b", 1, None)], "g string, i int, v string")
    got = df.select("g", "i", sequence.fill_forward("v", ["g"], ["i"]).alias("f"), sequence.fill_leading("v", ["g"], ["i"]).alias("l")).orderBy("g", "i").collect()
    assert [tuple(r)[2:] for r in got] == [(None, "x"), ("x", "x"), ("x", None), ("y", "y"), (None, None)]
    assert [r["island"] for r in sequence.islands(df, "v", ["g"], ["i"]).orderBy("g", "i").collect()] == [1, 2, 3, 4, 1]
    nodes = spark.createDataFrame([("c", "1", None), ("c", "2", "1"), ("c", "3", "2"), ("d", "p", "q"), ("d", "q", "p")], "conv string, node string, parent string")
    leaves = spark.createDataFrame([("c", "3"), ("d", "p"), ("e", "z")], "conv string, node string")
    assert sorted(map(tuple, sequence.path_to_root(nodes, leaves).collect())) == [("c", "1", 2), ("c", "2", 1), ("c", "3", 0), ("d", "p", 0), ("d", "q", 1)]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(CLAUDE))
    (tmp_path / "b.jsonl").write_text("\n".join(CODEX))
    (tmp_path / "empty.jsonl").write_text('{"type":"session_meta","payload":{"id":"s"}}')
    (tmp_path / "bad.txt").write_text("hello")
    return tmp_path


def test_reading_files(spark, folder):
    found = scan.read_transcripts(spark, [str(folder / n) for n in ("a.jsonl", "b.jsonl", "empty.jsonl", "bad.txt")], now_ms=3).cache()
    state = {r["file"].rsplit("/", 1)[1]: (r["format"], r["status"], r["file_ord"]) for r in found.collect()}
    assert state == {"a.jsonl": ("claude-code", "ok", 0), "b.jsonl": ("codex", "ok", 1), "empty.jsonl": ("codex", "no_conversation", 2), "bad.txt": (None, "failed", 3)}
    assert scan.conversations(found).count() == 2 and scan.warnings(found).count() == 3
    by_lines = scan.import_lines(scan.read_lines(spark, str(folder / "a.jsonl")), "claude-code", now_ms=3).first()
    assert by_lines["messages"] == found.where("file like '%/a.jsonl'").first()["messages"]
    with pytest.raises(Exception, match="not recognized"):
        scan.read_transcripts(spark, str(folder / "bad.txt"), mode="FAILFAST").collect()
    with pytest.raises(ValueError):
        scan.read_transcripts(spark, str(folder), form="word")
    assert scan.import_docs(spark.createDataFrame([], "file string, file_ord int, content string")).count() == 0


def test_command_line(spark, folder, capsys):
    run = lambda *a: (cli.main(list(a), spark), capsys.readouterr())
    code, said = run("rows", str(folder / "a.jsonl"), str(folder / "bad.txt"), str(folder / "empty.jsonl"))
    assert code == 2 and json.loads(said.out)["tool"] == "Bash" and "1 input(s) skipped" in said.err and "contained no conversation" in said.err
    code, said = run("rows", "--csv", str(folder / "a.jsonl"))
    assert code == 0 and said.out.split("\n")[0] == tool_calls.csv_header()
    code, said = run("usage", str(folder / "a.jsonl"), str(folder / "b.jsonl"), "--json")
    assert code == 0 and [b["key"] for b in json.loads(said.out)] == ["m1", "x"]
    assert run("usage", str(folder / "bad.txt"))[0] == 1 and run("usage", str(folder / "a.jsonl"), "--window", "x")[0] == 1
    code, said = run("convert", str(folder / "a.jsonl"), "-t", "gemini", "-o", str(folder / "out.json"))
    assert code == 0 and json.loads((folder / "out.json").read_text())["contents"]
    assert "threadId:  s1" in run("inspect", str(folder / "a.jsonl"))[1].out
    assert "claude-code" in run("formats")[1].out and run("convert", str(folder / "empty.jsonl"))[0] == 1


def test_large_files_are_read_by_lines(spark, folder):
    (folder / "doc.json").write_text('{"mapping": {}, "x": 1}')
    paths = [str(folder / n) for n in ("doc.json", "b.jsonl", "a.jsonl") if (folder / n).exists()]
    whole = {r["file"]: r for r in scan.read_transcripts(spark, paths, now_ms=3).collect()}
    parts = {r["file"]: r for r in scan.read_transcripts(spark, paths, now_ms=3, limit=20).collect()}
    assert whole.keys() == parts.keys()
    for f, r in parts.items():
        assert r["file_ord"] == whole[f]["file_ord"] and r["format"] == whole[f]["format"]
        assert "too large" in r["error"] if f.endswith("doc.json") else (r["conversation"], r["messages"]) == (whole[f]["conversation"], whole[f]["messages"])


def test_stream_ends_where_a_batch_does(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    rows = [(f, i, x) for f, ls in (("a.jsonl", CODEX), ("b.jsonl", CODEX[:7])) for i, x in enumerate([*ls, None])]
    for n, part in enumerate((rows[:4], rows[4:9], rows[9:])):
        spark.createDataFrame(part, "file string, line_no long, value string").coalesce(1).write.parquet(f"{source}/{n}")
    lines = spark.readStream.schema("file string, line_no long, value string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(source))
    changes = []
    query = streaming.stream_messages(lines, "codex", now_ms=3).writeStream.outputMode("update").foreachBatch(lambda df, _: changes.extend(df.collect())).option("checkpointLocation", str(out)).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    now = streaming.upserts(spark.createDataFrame(changes, streaming.UPSERT)).orderBy("file", "seq").collect()
    docs = spark.createDataFrame([("a.jsonl", 0, "\n".join(CODEX)), ("b.jsonl", 0, "\n".join(CODEX[:7]))], "file string, file_ord int, content string")
    want = scan.messages(scan.import_docs(docs, "codex", now_ms=3)).orderBy("file", "seq").collect()
    keep = ("file", "seq", "message_id", "conversation_id", "role", "ts_ms", "model", "usage", "content", "tool_results", "metadata")
    assert [[r[k] for k in keep] for r in now] == [[r[k] for k in keep] for r in want]
    heads = {r["file"]: r for r in streaming.heads(spark.createDataFrame(changes, streaming.UPSERT)).collect()}
    for r in scan.conversations(scan.import_docs(docs, "codex", now_ms=3)).collect():
        assert all(heads[r["file"]][k] == r[k] for k in ("conversation_id", "source", "cwd", "git", "title", "custom", "created_at", "updated_at"))
    rolled = lambda m: [tuple(r) for r in usage.usage(m).collect()]
    assert rolled(streaming.upserts(spark.createDataFrame(changes, streaming.UPSERT))) == rolled(scan.messages(scan.import_docs(docs, "codex", now_ms=3)))


def test_usage_folds_batches_as_if_they_were_one(spark, tmp_path):
    say = lambda conv, message, model, tokens, source="s": (conv, source, message, "assistant", 5, model, None if tokens is None else (tokens, 1, None, None, None), 0, 0, 0)
    kind = f"conversation_id string, source string, message_id string, role string, ts_ms long, model string, usage {schema.USAGE_DDL}, file_ord int, conversation_ord int, seq int"
    batches = [[say("a", "1", "m", 10), say("a", "2", None, None), say("a", None, "m", 1)], [say("a", "1", "other", 99), say("b", "1", "m", 5)], [], [say("b", "1", "m", 5), say("a", None, "m", 1), say("c", "9", "m", 7)]]
    fold = usage.UsageFold(spark, f"file://{tmp_path}/fold")
    assert fold.result().collect() == []
    for n, rows in enumerate(batches):
        fold.add(spark.createDataFrame(rows, kind), n)
    fold.add(spark.createDataFrame(batches[3], kind), 3)  # again, as after a failure
    whole = spark.createDataFrame([(*r[:-3], n, 0, i) for n, rows in enumerate(batches) for i, r in enumerate(rows)], kind)
    assert [tuple(r) for r in fold.result().collect()] == [tuple(r) for r in usage.usage(whole).collect()]
    assert {r["key"]: (r["messages"], r["duplicates_skipped"]) for r in fold.result().collect()} == {"m": (4, 2), "other": (0, 1), "unknown": (0, 0)}
