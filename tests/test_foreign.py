"""Formats of files by their rows, spans of foreign rows, and which files of a folder are read."""

import json

import pytest

from loomlight.sources import foreign
from loomlight.sources.lines import json_lines

SPAN = {"trace_id": "t", "span_id": "s", "name": "x", "start_time": "2024-01-01T00:00:00Z", "end_time": "2024-01-01T00:00:01Z", "status": {}, "attributes": {}}
INTEL = {"trace_id": "t", "name": "run bash", "attributes": {"tool.name": "bash", "gen_ai.usage.input_tokens": 3, "user_prompt": "hi", "session.id": "se"}, "start_unix_nano": 1_700_000_000_000_000_000, "status_code": "ERROR", "cost_usd": 0.5}
SESSION = {"kind": "x.policy_evidence.session", "session": {"sessionId": "se", "mtimeMs": 5}, "metrics": {"firstSpanAt": "2024-01-01T00:00:00Z"}, "execution": {"execution": {"tokenUsage": {"totals": {"input": 7, "output": 2}}}}, "repo": {}}
FILES = {
    "spans": ([SPAN, SPAN | {"parent_span_id": None, "links": []}], "openinference"),
    "half": ([SPAN, {k: v for k, v in SPAN.items() if k != "status"}], "intelligence-spans"),
    "intel": ([INTEL, INTEL | {"start_unix_nano": None, "received_at": "2024-01-01"}], "intelligence-spans"),
    "sessions": ([SESSION], "policy-evidence"),
    "chat": ([{"role": "user", "content": "a"}, {"role": "assistant", "content": [1]}], "chat-trajectory"),
    "talks": ([{"messages": []}], "chat-trajectory"),
    "sandbox": ([{"data": 1}, {"event": "RAW"}, {"x": 2}], "sandbox-events"),
    "mixed": ([SPAN, {"role": "user", "content": "a"}], None),
    "none": ([1, [2], "x"], None),
}


def put(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(folder / f"{name}.jsonl")


def test_formats_of_files(spark, tmp_path):
    for name, (rows, _) in FILES.items():
        put(tmp_path, name, rows)
    found = {r.file.rsplit("/", 1)[1].removesuffix(".jsonl"): (r.format, r.rows) for r in foreign.detected(spark, str(tmp_path)).collect()}
    assert found == {name: (kind, len(rows)) for name, (rows, kind) in FILES.items()}


def test_spans_of_foreign_rows(spark, tmp_path):
    first, second = foreign.intelligence_spans(json_lines(spark, put(tmp_path, "intel", FILES["intel"][0]))).orderBy("line").collect()
    assert (first.trace_id, first.kind, first.tool, first.status_code, first.start_ms, first.end_ms, first.input_tokens, first.output_tokens, first.cost_usd, first.content, first.session_id) == ("t", "TOOL", "bash", "ERROR", 1_700_000_000_000, 1_700_000_000_000, 3, None, 0.5, "hi", "se")
    assert second.start_ms == 1_704_067_200_000 and second.span_id != first.span_id
    (one,) = foreign.session_spans(json_lines(spark, put(tmp_path, "sessions", [SESSION]))).collect()
    assert (one.trace_id, one.kind, one.start_ms, one.end_ms, one.input_tokens, one.output_tokens) == ("se", "AGENT", 1_704_067_200_000, 1_704_067_200_000, 7, 2) and '"sessionId":"se"' in one.content


def test_files_of_a_folder(spark, tmp_path):
    put(tmp_path / "a", "chat", FILES["chat"][0])
    put(tmp_path / "a", "y", [SPAN])
    put(tmp_path / "a" / "deep", "x", [SPAN])
    names = lambda kept: [k.rsplit("/", 1)[1] for k in kept]
    kept, others = foreign.span_files(spark, str(tmp_path / "a"))
    assert names(kept) == ["x.jsonl", "y.jsonl"] and [r.format for r in others.collect()] == ["chat-trajectory"]
    put(tmp_path / "a" / "otlp", "z", [SPAN])
    assert names(foreign.span_files(spark, str(tmp_path / "a"))[0]) == ["z.jsonl"]
    assert names(foreign.span_files(spark, put(tmp_path, "chat", FILES["chat"][0]))[0]) == ["chat.jsonl"]
    put(tmp_path / "b", "chat", FILES["chat"][0])
    put(tmp_path / "b", "talks", FILES["talks"][0])
    with pytest.raises(FileNotFoundError):
        foreign.span_files(spark, str(tmp_path / "b"))
