"""Strict event streams, failures told by outputs, exact quantiles, staged imports and payload budgets."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlight.functions.outputs import output_failed
from loomlight.operators import payload
from loomlight.operators.quantiles import quantiles
from loomlight.sources import codex_exec, imports, sessions

R = random.Random(6)

OUTPUTS = {
    "error: everything failed": None, "": None, "  ": None, "{not json}": None, '{"exit_code": 1}': None, '{"exit_code": "2", "output": ""}': True, '{"exitCode": 0, "chunk_id": "c", "timed_out": true}': False,
    '{"timedOut": true}': True, '{"succeeded": true, "value": 1}': False, '{"succeeded": false}': None, '["x", {"type": "text", "text": "Script failed\\nWall time: 1"}]': True, '[{"type": "input_text", "text": "Script completed\\nWall time: 1"}, "error"]': False,
    "Chunk ID: a\nProcess exited with code -1\nOutput:\nfine": True, "chunk id: a\nOutput:\nProcess exited with code 1": None, "Script error:\nExit code: 0\n": False, "Command failed with exit code 2.": True, "I saw: Command failed with exit code 2": None,
    "<tool_error>\nx\n</tool_error>": True, "a <tool_error>x</tool_error>": None, '"{\\"timed_out\\": true}"': None, '[{"type": "text", "text": "{\\"timed_out\\": true}"}]': True, "[]": None, "[1, null]": None,
}


def test_only_the_protocol_tells_of_failures(spark):
    rows = spark.createDataFrame([(t,) for t in [*OUTPUTS, None]], "t string")
    found = {r.t: r.f for r in rows.select("t", output_failed(F.col("t")).alias("f")).collect()}
    assert found == {**OUTPUTS, None: None}
    assert rows.filter("t = '{\"timedOut\": true}'").select(output_failed(F.col("t"), timeout_fails=False)).first()[0] is None


def item(kind, i, kind_of="command_execution", **more):
    return {"type": f"item.{kind}", "item": {"id": i, "type": kind_of, "command": "ls", **more}}


START, TURN, DONE = {"type": "thread.started", "thread_id": "th"}, {"type": "turn.started", "timestamp": 1_700_000_000}, {"type": "turn.completed", "usage": {"input_tokens": 5, "output_tokens": 2}}
GOOD = [
    {"type": "hello"}, START, TURN, item("started", "a", status="in_progress"), item("completed", "a", status="completed", exit_code=2, aggregated_output="no"), item("completed", "m", "agent_message", text="hi"), item("completed", "t", "todo"),
    item("completed", "f", "file_change", status="completed", changes=[{"path": "x", "kind": "add"}]), DONE, TURN, item("started", "a"), {"type": "turn.failed", "error": {"message": "limit"}}, {"type": "error", "message": "gone"},
]
BAD = {
    "nothing": ([{"type": "x"}], "no event of a run"),
    "late": ([TURN, START], "an event came before thread.started"),
    "twice": ([START, START, TURN, DONE], "thread.started is not the first event"),
    "nested": ([START, TURN, TURN, DONE], "turn.started came before the prior turn ended"),
    "outside": ([START, TURN, DONE, item("started", "a")], "an event of a turn came without an active turn"),
    "cut": ([START, TURN, item("started", "a")], "the stream ended in a turn"),
    "endless": ([START], "the stream has no end"),
    "open": ([START, TURN, item("started", "a"), DONE], "a turn completed with an open item"),
    "again": ([START, TURN, item("completed", "a", status="failed"), item("completed", "a", status="failed"), DONE], "an item completed more than once"),
    "restart": ([START, TURN, item("completed", "a", status="failed"), item("started", "a"), DONE], "an item started more than once"),
    "changed": ([START, TURN, item("started", "a"), item("completed", "a", "file_change", status="completed", changes=[{"path": "x"}]), DONE], "an item changed its type"),
    "status": ([START, TURN, item("completed", "a", status="maybe"), DONE], "a completed item is neither completed nor failed"),
    "usage": ([START, TURN, {"type": "turn.completed", "usage": {"input_tokens": -1}}], "usage is no count of tokens"),
    "silent": ([START, TURN, {"type": "turn.failed", "error": {}}], "a failure has no message"),
}


def test_streams_that_break_their_life_cycle_are_refused(spark, tmp_path):
    for name, rows in {"good": GOOD, **{k: v[0] for k, v in BAD.items()}}.items():
        (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    found = {r.file.rsplit("/", 1)[1]: r.reason for r in codex_exec.rejections(spark, str(tmp_path)).collect()}
    assert found == {k: v[1] for k, v in BAD.items()}
    rows = sessions.adapter("codex-json")(spark, str(tmp_path)).orderBy("ord", "kind").collect()
    assert {r.trace_id for r in rows} == {"th"}
    assert [(r.ord, r.kind, r.tool, r.failed) for r in rows] == [
        (5, "TOOL", "exec_command", True), (6, "CHAIN", None, None), (8, "TOOL", "apply_patch", False), (9, "LLM", None, False), (11, "TOOL", "exec_command", True), (12, "LLM", None, True), (13, "CHAIN", None, True),
    ]
    assert (rows[0].output, rows[0].arguments, rows[3].input_tokens, rows[3].ts_ms, rows[6].content) == ("no", "ls", 5, None, "gone")


def test_quantiles_are_exact(spark):
    values = {"few": [3.0], "two": [1.0, 2.0], "hot": [7.0] * 900 + [R.random() for _ in range(300)], "wide": [R.choice([-1, 1]) * 10.0 ** R.randint(-300, 300) for _ in range(500)], "ties": [float(R.randint(0, 5)) for _ in range(1000)]}
    rows = [(m, x) for m, xs in values.items() for x in xs] + [("few", None), ("none", None)]
    R.shuffle(rows)
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    found = {(r.measure, r.share): r.value for r in quantiles(spark.createDataFrame(rows, "measure string, x double").repartition(7), shares).collect()}
    assert found == {(m, s): pytest.approx(np.quantile(xs, s), rel=1e-12) for m, xs in values.items() for s in shares}
    assert quantiles(spark.createDataFrame([], "measure string, x double"), shares).count() == 0


STEPS = "traj_id string, step_id int, said string"


def test_imports_are_published_whole_or_not_at_all(spark, tmp_path):
    steps = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "é\n")], STEPS).repartition(3)
    rows = spark.createDataFrame([("a", 2), ("b", 1)], "traj_id string, step_count int")
    leaks = spark.createDataFrame([], "traj_id string, label string")
    out = str(tmp_path / "out")
    summary = imports.import_trajectories(spark, rows, steps, out, "r1", leaks)
    assert (summary["traces"], summary["steps"], summary["leak_scan"]) == (2, 3, "passed") and json.load(open(f"{out}/import.json")) == summary
    kept = spark.read.schema(STEPS).json(f"{out}/steps")
    assert sorted(map(tuple, kept.select("traj_id", "step_id", "said").collect()), key=repr) == sorted(map(tuple, steps.collect()), key=repr)
    assert {r.traj_id: r.steps for r in spark.read.json(f"{out}/receipts").collect()} == {"a": 2, "b": 1}
    again = imports.import_trajectories(spark, rows, steps.repartition(1), str(tmp_path / "again"), "r1")
    assert again["digest"] == summary["digest"]
    other = imports.import_trajectories(spark, rows, steps.withColumn("said", F.lit("z")), str(tmp_path / "other"), "r1")
    assert other["digest"] != summary["digest"]
    for bad_rows, bad_leaks, why in (
        (rows, None, "exists"),
        (rows.union(rows), None, "repeated row"),
        (spark.createDataFrame([("a", 3), ("b", 1)], rows.schema), None, "count differs"),
        (rows, spark.createDataFrame([("a", "l")], leaks.schema), "label in a step"),
    ):
        target = out if why == "exists" else str(tmp_path / "bad")
        with pytest.raises(imports.ImportRefused, match=why):
            imports.import_trajectories(spark, bad_rows, steps, target, "r1", bad_leaks)
    (tmp_path / ".held.lock").write_text("")
    with pytest.raises(imports.ImportRefused, match="another import"):
        imports.import_trajectories(spark, rows, steps, str(tmp_path / "held"), "r1")
    broken = steps.withColumn("said", F.when(F.col("step_id") == 2, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("said")))
    with pytest.raises(Exception, match="lost"):
        imports.import_trajectories(spark, rows, broken, str(tmp_path / "bad"), "r1")
    assert sorted(x for x in os.listdir(tmp_path) if not x.endswith(".crc")) == [".held.lock", "again", "other", "out"]


def test_attributes_are_cut_only_if_the_whole_is_too_large(spark):
    rows = spark.sql("select id, map('text', repeat('x', 100)::variant, 'list', parse_json('[1,2,3,4,5,6,7,8,9,10]'), 'n', 5::variant) as attributes from range(10)")
    same, how = payload.budgeted(rows, budget=5000)
    assert how["cap"] is None and how["chars"] == len(json.dumps([json.loads(r[0]) for r in rows.select(F.to_json(F.struct("id", "attributes"))).collect()], separators=(",", ":")))
    cut, how = payload.budgeted(rows, budget=1600, cap=12)
    one = json.loads(cut.select(F.to_json("attributes")).first()[0])
    assert how["cap"] == 12 and one == {"text": "x" * 12 + "…[truncated 88 chars]", "list": "[omitted non-string attribute: 22 JSON chars]", "n": 5}
    with pytest.raises(payload.PayloadTooLarge):
        payload.budgeted(rows, budget=200, cap=12)
    assert payload.budgeted(rows.limit(0), budget=2)[1] == {"cap": None, "chars": 2} and same.count() == 10
