"""Streams over files that are there: first sight, late rows, windows, growth, whole-session rules."""

import datetime as dt

from pyspark.sql import functions as F

from loomlight.operators.findings import live_rules
from loomlight.streaming import live


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def write(spark, path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.json(f"{path}/{i}")


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_first_sight(spark, tmp_path):
    schema = "ts timestamp, harness string, session_id string, span_id string"
    write(spark, tmp_path / "in", [[(at(0), "h", "s", "a"), (at(1), "h", "s", "b")], [(at(2), "h", "s", "a"), (at(3), "h", "t", "a")]], schema)
    rows = drain(live.unseen(live.follow(spark, str(tmp_path / "in/*"), schema, 1)), "seen")
    assert sorted((r.session_id, r.span_id) for r in rows) == [("s", "a"), ("s", "b"), ("t", "a")]


def test_windows_drop_late_rows_and_equal_the_batch(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double, user_id long"
    # Spark drops late rows by the watermark of the batch before, so one batch stands between
    parts = [[(at(1), "x", 1.0, 1), (at(4), "x", 2.0, 1)], [(at(61), "x", 3.0, 1)], [(at(62), "x", 4.0, 1)], [(at(2), "x", 100.0, 1), (at(130), "x", 0.0, 1)]]
    write(spark, tmp_path / "in", parts, schema)
    stream = live.follow(spark, str(tmp_path / "in/*"), schema, 1)
    found = {r.window.start: (r.n, r.value) for r in drain(live.windowed_counts(stream, "10 minutes"), "tumbling")}
    assert found == {at(0): (2, 3.0), at(60): (2, 7.0)}
    batch = spark.createDataFrame(parts[0], schema)
    assert live.windowed_counts(batch, "10 minutes", "5 minutes").count() == 2
    assert [r.n for r in live.session_counts(batch, "5 minutes").collect()] == [2]


def test_alerts_only_when_counts_grow(spark, tmp_path):
    write(spark, tmp_path / "in", [[("a", 2)], [("a", 2)], [("a", 5)], [("a", 3)]], "loop string, n long")
    live.with_state_store(spark)
    rows = drain(live.growing(live.follow(spark, str(tmp_path / "in/*"), "loop string, n long", 1), ["loop"], "n"), "grows")
    assert [r.n for r in rows] == [2, 5]


ACTIONS = "trace_id string, ord long, start_us long, tool string, content string, status_code string, is_tool boolean, action string"


def act(i, action, tool=True, status="UNSET"):
    return ("s", i, i * 1000, "bash" if tool else None, "pnpm test" if tool else "done", status, tool, action)


def test_live_batch_of_three_failing_tests_and_a_claim(spark):
    rows = [act(0, "other", False), *[act(i, "verify", status="ERROR") for i in (1, 2, 3)], act(4, "claim", False)]
    found = {(r.rule, r.severity, r.n) for r in live_rules(spark.createDataFrame(rows, ACTIONS)).collect()}
    assert found == {("same-failing-command", "high", 3.0), ("verification-without-change", "high", 3.0), ("claim-without-verification", "medium", 1.0)}


def test_whole_sessions_are_judged_again_and_findings_go_out_once(spark, tmp_path):
    parts = [[act(1, "verify", status="ERROR")], [act(2, "verify", status="ERROR")], [act(3, "edit")], [act(4, "verify", status="ERROR")]]
    write(spark, tmp_path / "in", parts, ACTIONS)
    out = []
    stream = live.follow(spark, str(tmp_path / "in/*"), ACTIONS, 1)
    q = live.watch_sessions(stream, str(tmp_path / "store"), lambda rows, n: out.extend((r.rule, r.n) for r in rows.collect()), str(tmp_path / "cp"), once=True)
    q.awaitTermination(240)
    assert q.exception() is None
    assert out.count(("same-failing-command", 2.0)) == 1 and ("same-failing-command", 3.0) in out
    everything = spark.read.schema(ACTIONS).json(str(tmp_path / "in/*"))
    assert live.replayed(everything).filter(F.col("rule") == "same-failing-command").first().n == 3


def session_parts():
    import random

    pick = random.Random(8)
    rows = []
    for trace in "abcdef":
        for i in range(pick.randint(1, 14)):
            action = pick.choice(["verify", "verify", "edit", "claim", "other"])
            tool = action in ("verify", "edit") or pick.random() < 0.3
            rows.append((trace, i, pick.randint(0, 50) * 1_000_000 + i, "bash" if tool else None, pick.choice(["pnpm test", "pytest"]), pick.choice(["ERROR", "OK"]), tool, action))
    pick.shuffle(rows)
    return [rows[i::4] for i in range(4)]


def test_state_gives_the_findings_of_the_batch_in_any_order(spark, tmp_path):
    live.with_state_store(spark)
    parts = session_parts()
    write(spark, tmp_path / "in", [*parts, parts[0]], ACTIONS)  # the last file repeats spans
    stream = live.follow(spark, str(tmp_path / "in/*"), ACTIONS, 1, active="30m")
    out, ticks = [], []
    q = live.ticked(live.session_events(stream), lambda rows, tick: (out.extend((tick["batch"], *r) for r in rows.collect()), ticks.append(tick)), str(tmp_path / "cp"), once=True)
    q.awaitTermination(240)
    assert q.exception() is None
    events = [r for r in out if r[2] == "finding"]
    keys = [(r[1], r[3], r[5], r[6]) for r in events]
    assert len(keys) == len(set(keys))  # none goes out twice
    everything = spark.read.schema(ACTIONS).json(str(tmp_path / "in/*")).distinct()
    batch = {(r.trace_id, r.rule, r.severity, r.n) for r in live_rules(everything).collect()}
    said = {(r[1], r[3], r[4], r[5]) for r in events}
    assert batch <= said
    # the latest of each rule is the batch's, but for rules that no longer hold
    latest = {}
    for n, trace, _, rule, severity, value, subject in sorted(events, key=lambda r: r[0]):
        latest[trace, rule, subject] = (trace, rule, severity, value)
    assert {x for x in latest.values() if x[1] == "same-failing-command"} == {x for x in batch if x[1] == "same-failing-command"}
    assert sorted(r[1] for r in out if r[2] == "session") == sorted({r[0] for p in parts for r in p})
    assert sum(t["sessions"] for t in ticks) == 6 and sum(t["findings"] for t in ticks) == len(events)


def test_idle_sessions_leave_no_state(spark, tmp_path):
    live.with_state_store(spark)
    hour = 3_600_000_000
    row = lambda trace, i, us: (trace, i, us, "bash", "pnpm test", "ERROR", True, "verify")
    parts = [[row("a", 1, hour), row("a", 2, hour + 1)], [row("b", 1, 5 * hour)], [row("d", 1, 8 * hour)], [row("d", 2, 8 * hour + 1)], [row("b", 2, 12 * hour)], [row("c", 1, 20 * hour)], [row("c", 2, 20 * hour + 1)]]
    write(spark, tmp_path / "in", parts, ACTIONS)
    out = []
    stream = live.follow(spark, str(tmp_path / "in/*"), ACTIONS, 1)
    q = live.ticked(live.session_events(stream, idle=60_000), lambda rows, tick: out.extend((r.trace_id, r.event, r.n) for r in rows.collect()), str(tmp_path / "cp"), once=True)
    q.awaitTermination(240)
    assert q.exception() is None
    assert out.count(("a", "session", 2.0)) == 1 and ("a", "idle", 2.0) in out
    # b ended and came back: a session that was idle is a new one
    assert [x for x in out if x[0] == "b" and x[1] != "finding"] == [("b", "session", 1.0), ("b", "idle", 1.0), ("b", "session", 1.0), ("b", "idle", 1.0)]
    assert ("c", "finding", 2.0) in out and ("c", "idle", 2.0) not in out
    left = q.lastProgress.stateOperators[0].numRowsTotal
    assert left <= 16  # of session c alone: its spans, findings, totals and timer
