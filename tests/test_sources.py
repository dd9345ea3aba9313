"""Readers on small files: span files with foreign rows, session logs of each assistant, round trips."""

import json

import pytest

from loomlight.sources import readers, sessions, writers


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def span(i, **more):
    return {"trace_id": "t" * 32, "span_id": f"s{i}", "name": "x", "start_time": "2024-01-01T00:00:00Z", "end_time": "2024-01-01T00:00:01Z", "status": {"code": "STATUS_CODE_OK"}} | more


def test_foreign_rows_are_quarantined_by_physical_line(spark, tmp_path):
    path = lines(tmp_path / "a.jsonl", span(1), "", "  ", "{broken", span(2), span(3), 42, ["a"], {"hello": "world"})
    good, bad = readers.read_spans(spark, path)
    assert sorted(r.span_id for r in good.collect()) == ["s1", "s2", "s3"]
    assert {r.line: r.reason for r in bad.collect()} == {4: "not JSON", 7: "not an object", 8: "not an object", 9: "no span id"}


def test_aliases_kinds_and_withheld_ends(spark, tmp_path):
    path = lines(
        tmp_path / "a.jsonl",
        span(1, attributes={"llm.model_name": "m", "llm.token_count.prompt": 5, "gen_ai.usage.output_tokens": 7}),
        span(2, end_time="2023-01-01T00:00:00Z", parent_span_id="", attributes={"tool.name": "bash", "agent.loop.iteration": 1.5}),
        span(3, kind="telepathy", status={"code": "WEIRD"}, start_time="1700000000000"),
    )
    found = {r.span_id: r for r in readers.read_spans(spark, path)[0].collect()}
    assert (found["s1"].kind, found["s1"].input_tokens, found["s1"].output_tokens, found["s1"].cost_usd) == ("LLM", 5, 7, None)
    assert (found["s2"].kind, found["s2"].end_ms, found["s2"].end_withheld, found["s2"].parent_span_id, found["s2"].iteration) == ("TOOL", None, True, None, 1.5)
    assert (found["s3"].kind, found["s3"].status_code, found["s3"].start_ms) == ("UNKNOWN", "UNSET", 1700000000000)


def test_repeat_and_conflict(spark, tmp_path):
    path = lines(tmp_path / "a.jsonl", span(1), span(1), span(1, name="y"), span(2))
    kept, issues = readers.merged(readers.read_spans(spark, path)[0])
    assert sorted((r.span_id, r.name) for r in kept.collect()) == [("s1", "x"), ("s2", "x")]
    assert {(r.line, r.issue) for r in issues.collect()} == {(2, "repeat"), (3, "conflicting-span-id")}


def test_export_reads_back_the_same(spark, tmp_path):
    path = lines(tmp_path / "a.jsonl", span(1, attributes={"gen_ai.request.model": "m", "gen_ai.usage.input_tokens": 3, "content": "hi"}), span(2, parent_span_id="s1", attributes={"tool.name": "bash"}))
    first = readers.read_spans(spark, path)[0]
    writers.write_spans(first, str(tmp_path / "out"))
    again = readers.read_spans(spark, str(tmp_path / "out"))[0]
    columns = ["trace_id", "span_id", "parent_span_id", "start_ms", "end_ms", "status_code", "kind", "model", "tool", "input_tokens", "content"]
    assert sorted(map(str, first.select(columns).collect())) == sorted(map(str, again.select(columns).collect()))


def test_sniff_journal_and_manifest(spark, tmp_path):
    a = tmp_path / "in"
    a.mkdir()
    lines(a / "spans.jsonl", "", span(1))
    lines(a / "other.jsonl", {"type": "x"})
    assert {r.file.rsplit("/", 1)[1]: r.is_spans for r in readers.sniff(spark, str(a)).collect()} == {"spans.jsonl": True, "other.jsonl": False}
    j = tmp_path / "journal"
    j.write_text('{"kind":"begin","root":"r"}\n{"kind":"odd"}\n{"kind":"event","event":{"kind":"spawned","id":"a"}}\n{"kind":"event"')
    assert [(r.line, r.valid, r.id) for r in readers.journal_events(spark, str(j)).orderBy("line").collect()] == [(1, True, None), (2, False, None), (3, True, "a")]
    assert {r.bytes for r in writers.manifest(spark, str(a)).collect()} == {f.stat().st_size for f in a.iterdir()}


def test_chat_and_sandbox_spans(spark):
    chat = spark.createDataFrame([("c", [("user", "hi"), ("assistant", "yo"), ("user", "ok"), ("assistant", "bye")])], "trajectory_id string, messages array<struct<role:string,content:string>>")
    assert [r.step for r in readers.chat_spans(chat).filter("kind = 'LLM'").orderBy("span_id").collect()] == [1, 2]
    box = spark.createDataFrame([("r", 0, "start", 5), ("r", 1, "raw", None), ("r", 2, "error", 9)], "run string, ord int, type string, ts long")
    found = {r.span_id: (r.ts, r.status_code) for r in readers.sandbox_spans(box).collect()}
    assert found == {"r": (5, "ERROR"), "r:0": (5, "UNSET"), "r:1": (5, "UNSET"), "r:2": (9, "ERROR")}


T = "2024-01-01T00:00:00Z"
LOGS = {
    "claude-code": [
        {"type": "user", "sessionId": "s", "timestamp": T, "message": {"role": "user", "content": "fix it"}},
        {"type": "assistant", "sessionId": "s", "timestamp": T, "message": {"id": "m1", "model": "big", "usage": {"input_tokens": 5, "output_tokens": 1}, "content": [{"type": "text", "text": "ok"}]}},
        {"type": "assistant", "sessionId": "s", "timestamp": T, "message": {"id": "m1", "model": "big", "usage": {"input_tokens": 5, "output_tokens": 9}, "content": [{"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "user", "sessionId": "s", "timestamp": T, "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": "boom", "is_error": True}]}},
    ],
    "codex": [
        {"type": "session_meta", "timestamp": T, "payload": {"id": "s"}},
        {"type": "response_item", "timestamp": T, "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "fix it"}]}},
        {"type": "turn_context", "timestamp": T, "payload": {"model": "big"}},
        {"type": "event_msg", "timestamp": T, "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 5}, "last_token_usage": {"input_tokens": 5, "output_tokens": 9}}}},
        {"type": "event_msg", "timestamp": T, "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 5}, "last_token_usage": {"input_tokens": 5, "output_tokens": 9}}}},
        {"type": "response_item", "timestamp": T, "payload": {"type": "function_call", "call_id": "c1", "name": "Bash", "arguments": "{}"}},
        {"type": "response_item", "timestamp": T, "payload": {"type": "function_call_output", "call_id": "c1", "output": "boom"}},
    ],
    "qwen": [
        {"type": "user", "sessionId": "s", "timestamp": T, "message": {"role": "user", "parts": [{"text": "fix it"}]}},
        {"type": "assistant", "sessionId": "s", "timestamp": T, "model": "big", "usageMetadata": {"promptTokenCount": 5, "candidatesTokenCount": 9}, "message": {"parts": [{"text": "ok"}, {"functionCall": {"name": "Bash", "args": {}}}]}},
        {"type": "tool_result", "sessionId": "s", "timestamp": T, "toolCallResult": {"status": "error"}, "message": {"parts": [{"functionResponse": {"name": "Bash", "response": {"output": "boom"}}}]}},
    ],
    "factory": [
        {"type": "session_start", "id": "s", "cwd": "/x"},
        {"type": "message", "id": "1", "timestamp": T, "message": {"role": "user", "content": [{"type": "text", "text": "fix it"}]}},
        {"type": "message", "id": "2", "timestamp": T, "message": {"role": "assistant", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "c1", "name": "Bash", "input": {}}]}},
        {"type": "message", "id": "3", "timestamp": T, "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": "boom", "is_error": True}]}},
    ],
    "pi": [
        {"type": "session", "id": "s"},
        {"type": "message", "id": "0", "timestamp": T, "message": {"role": "toolResult", "toolCallId": "c1", "content": [{"type": "text", "text": "boom"}], "isError": True}},
        {"type": "message", "id": "1", "timestamp": T, "message": {"role": "user", "content": [{"type": "text", "text": "fix it"}]}},
        {"type": "message", "id": "2", "timestamp": T, "message": {"role": "assistant", "model": "big", "usage": {"input": 5, "output": 9}, "content": [{"type": "text", "text": "ok"}, {"type": "toolCall", "id": "c1", "name": "Bash", "arguments": {}}]}},
    ],
    "github-copilot": [
        {"type": "user.message", "timestamp": T, "data": {"content": "fix it"}},
        {"type": "assistant.usage", "timestamp": T, "data": {"inputTokens": 5, "outputTokens": 9}},
        {"type": "assistant.message", "timestamp": T, "data": {"content": "ok"}},
        {"type": "tool.execution_start", "timestamp": T, "data": {"toolCallId": "c1", "toolName": "Bash", "arguments": {}}},
        {"type": "tool.execution_complete", "timestamp": T, "data": {"toolCallId": "c1", "success": False, "result": {"content": "boom"}}},
    ],
    "gemini": [{"sessionId": "s", "messages": [{"type": "user", "timestamp": T, "content": "fix it"}, {"type": "gemini", "timestamp": T, "model": "big", "tokens": {"input": 5, "output": 9}, "content": "ok", "toolCalls": [{"id": "c1", "name": "Bash", "args": {}, "status": "error", "result": "boom"}]}]}],
    "amp": [{"id": "s", "messages": [{"role": "user", "content": [{"type": "text", "text": "fix it"}]}, {"role": "assistant", "usage": {"model": "big", "inputTokens": 5, "outputTokens": 9}, "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "c1", "name": "Bash", "input": {}}]}, {"role": "user", "content": [{"type": "tool_result", "toolUseID": "c1", "run": {"result": "boom"}}]}]}],
    "forge": [{"context": {"conversation_id": "s", "messages": [{"message": {"text": {"role": "User", "content": "fix it"}}}, {"message": {"text": {"role": "Assistant", "model": "big", "content": "ok", "tool_calls": [{"call_id": "c1", "name": "Bash", "arguments": {}}]}}, "usage": {"prompt_tokens": 5, "completion_tokens": 9}}, {"message": {"tool": {"call_id": "c1", "output": {"is_error": True, "values": ["boom"]}}}}]}}],
}


@pytest.mark.parametrize("name", sorted(LOGS))
def test_session_logs(spark, tmp_path, name):
    path = lines(tmp_path / "log.jsonl", *LOGS[name])
    found = sessions.adapter(name)(spark, path).collect()
    calls = [r for r in found if r.kind == "TOOL"]
    assert [(r.tool, "boom" in r.output) for r in calls] == [("Bash", True)]
    if name not in ("codex", "amp"):
        assert calls[0].failed is True
    prompts = [r for r in found if r.kind == "CHAIN" and r.content == "fix it"]
    assert len(prompts) == 1
    usage = [(r.input_tokens, r.output_tokens) for r in found if r.kind == "LLM" and r.input_tokens is not None]
    assert usage == ([] if name == "factory" else [(5, 9)])


def test_opencode_and_orphan_results(spark, tmp_path):
    for d in ("m", "p"):
        (tmp_path / d).mkdir()
    lines(tmp_path / "m/1.json", {"id": "m1", "sessionID": "s", "role": "assistant", "modelID": "big", "time": {"created": 5}, "tokens": {"input": 5, "output": 9}})
    lines(tmp_path / "p/1.json", {"id": "p1", "messageID": "m1", "type": "text", "text": "ok"})
    lines(tmp_path / "p/2.json", {"id": "p2", "messageID": "m1", "type": "tool", "callID": "c", "tool": "bash", "state": {"status": "error", "output": "boom"}})
    found = sessions.opencode(spark, str(tmp_path / "m"), str(tmp_path / "p")).collect()
    assert {(r.kind, r.content or r.output) for r in found} == {("LLM", "ok"), ("TOOL", "boom")}
    path = lines(tmp_path / "c.jsonl", {"type": "user", "sessionId": "s", "message": {"content": [{"type": "tool_result", "tool_use_id": "lost", "content": "x"}]}})
    assert [r.role for r in sessions.claude(spark, path).collect() if r.kind == "TOOL"] == ["orphan_result"]


def test_unknown_adapter():
    with pytest.raises(KeyError):
        sessions.adapter("nobody")
    assert sessions.adapter("claude") is sessions.claude


def test_redaction_and_metadata(spark):
    s = spark.createDataFrame([("mail a.b@c.org", "x")], "content string, span_id string")
    assert writers.redact_spans(s).first().content == "mail [email]" and writers.metadata_only(s).columns == ["span_id"]
