"""Context roots, fork boundaries, replays and connected sessions on small tables with expected values by hand."""

import pytest

from loomlight.operators import context, forks, replay, workflow


def test_deepest_marked_folder_is_the_root(spark):
    sessions = spark.createDataFrame([("a", "/w/r/src/deep"), ("a", "/w/r2"), ("b", "/w/r/"), ("c", None), ("d", "/"), ("e", "/w/rx/src"), ("e", "/w/rx/src")], "trace_id string, cwd string")
    files = spark.createDataFrame([("/w/r", ".git"), ("/w/r/src", "AGENTS.md"), ("/w/r/src", "CLAUDE.md"), ("/w", "README.md"), ("/w/r/src/deep", "x.jsonl"), ("/", ".evolve")], "folder string, name string")
    roots = context.context_roots(sessions, files)
    assert sorted(map(tuple, roots.collect()), key=repr) == sorted([("a", "/w/r/src/deep", "/w/r/src"), ("a", "/w/r2", "/"), ("b", "/w/r/", "/w/r"), ("c", None, None), ("d", "/", "/"), ("e", "/w/rx/src", "/")], key=repr)
    none = files.filter("name = 'README.md'")
    assert {r.cwd: r.root for r in context.context_roots(sessions, none).collect()}["/w/r2"] == "/w/r2"
    index = {r.root: (r.sessions, r.files, r.instruction_docs) for r in context.context_index(roots, files).collect()}
    assert index == {"/w/r/src": (1, 2, 2), "/": (3, 1, 0), "/w/r": (1, 1, 0)}


def u7(ms, tail=0):
    h = f"{ms:012x}"
    return f"{h[:8]}-{h[8:]}-7000-8000-{tail:012d}"


def test_each_rung_of_the_fork_ladder(spark):
    children = [
        ("exact", "s1", 100), ("twice", "s2", 100), ("made", u7(5000), 100), ("tie", u7(5000), 100), ("early", u7(9000), 100),
        ("near", "s6", 100), ("nears", "s7", 100), ("none", "s8", 100), ("empty", "s9", None), ("upper", u7(5003).upper(), 100),
    ]
    turns = [
        ("exact", "s1", 7), ("exact", "t", 100), ("twice", "s2", 7), ("twice", "s2", 8),
        ("made", u7(4999), 100), ("made", u7(6000), 1), ("made", u7(7000), 1), ("tie", u7(6000, 1), 1), ("tie", u7(6000, 2), 1), ("tie", "t", 100),
        ("early", u7(8000), 101), ("near", "t", 102), ("near", "u", 103), ("nears", "t", 98), ("nears", "u", 102), ("none", "t", 1000), ("upper", u7(5003), 1),
    ]
    found = forks.fork_boundaries(spark.createDataFrame(children, "child string, session_id string, started_s long"), spark.createDataFrame(turns, "child string, turn_id string, started_s long"))
    assert {r.child: (r.rung, r.state, r.turn_id) for r in found.collect()} == {
        "exact": ("exact", "resolved", "s1"), "twice": ("exact", "resolved", "s2"), "made": ("created", "resolved", u7(6000)), "tie": ("created", "ambiguous", None),
        "early": ("near", "resolved", u7(8000)), "near": ("near", "resolved", "t"), "nears": ("near", "ambiguous", None), "none": (None, "missing", None), "empty": (None, "missing", None), "upper": ("created", "resolved", u7(5003)),
    }


RECORDED = "case_id string, step int, command string, returncode int, signature string"
RERUN = "case_id string, step int, command string, returncode int, output string"


def test_steps_are_aligned_and_cases_judged(spark):
    recorded = [("a", i, f"c{i}", 0, None) for i in range(1, 11)] + [("a", 11, "fail", 2, "boom")]
    recorded += [("b", 1, "x", 0, None), ("b", 2, "fail", 1, "boom"), ("c", 1, "fail", 1, None), ("d", 1, "ok", 0, None)]
    rerun = [("a", i, "other" if i == 4 else f"c{i}", 0, "") for i in range(1, 11) if i != 7] + [("a", 11, "fail", 2, "it went boom"), ("a", 12, "more", 0, "")]
    rerun += [("b", 1, "x", 1, ""), ("b", 2, "fail", 1, "boom")]
    r, n = spark.createDataFrame(recorded, RECORDED), spark.createDataFrame(rerun, RERUN)
    kinds = {(x.case_id, x.step): x.difference for x in replay.aligned(r, n).collect()}
    assert (kinds["a", 4], kinds["a", 7], kinds["a", 12], kinds["b", 1], kinds["a", 1], kinds["c", 1]) == ("command", "missing", "extra", "returncode", "same", "missing")
    targets = replay.failing_steps(r)
    assert {x.case_id: x.target for x in targets.collect()} == {"a": 11, "b": 2, "c": 1}
    cases = replay.replayed_cases(r, n, targets)
    found = {x.case_id: (x.prefix_executed, x.divergences, x.divergence_pct, x.returncode_match, x.signature_match, x.replayed) for x in cases.collect()}
    assert found == {"a": (9, 1, 11.1, True, True, False), "b": (1, 1, 100.0, True, True, False), "c": (0, 0, 0.0, False, False, False)}
    attempts = spark.createDataFrame([("a", 1, True, False), ("a", 2, True, True), ("a", 3, True, True), ("b", 1, False, True), ("c", 1, True, True)], "case_id string, attempt int, executed boolean, vanished boolean")
    fixed = replay.fixes(attempts)
    rates = {x.rate: (x.numerator, x.denominator, x.value) for x in replay.rates(cases, fixed).collect()}
    assert rates == {"replayability": (0, 3, 0.0), "signature-strict": (0, 3, 0.0), "fix-flip": (2, 2, 1.0), "fix-flip-nonzero": (2, 2, 1.0), "fix-flip-first": (1, 2, 0.5)}
    assert sorted(map(tuple, replay.flips_by_attempt(fixed).collect())) == [(1, 1), (2, 1)]
    nothing = replay.rates(cases.limit(0), fixed.limit(0)).collect()
    assert {x.value for x in nothing} == {None}


SESSIONS = "session_id string, path string, parent_id string, child_ids array<string>"


def test_sessions_are_expanded_both_ways_with_issues(spark):
    rows = [
        ("root", "/1", None, ["a", "b", "gone"]), ("a", "/2", "root", ["c"]), ("b", "/3", "elsewhere", []), ("c", "/4", "a", []), ("twin", "/5", "c", []), ("twin", "/6", "c", []),
        ("c2", "/7", "twin", []), ("x", "/8", "y", ["y"]), ("y", "/9", "x", ["x"]), ("lone", "/10", None, ["twin"]),
    ]
    sessions = spark.createDataFrame(rows, SESSIONS)
    seeds = lambda *ids: spark.createDataFrame([(i,) for i in ids], "session_id string")
    found, issues = workflow.expanded(sessions, seeds("a"))
    assert {r.session_id: r.distance for r in found.collect()} == {"a": 0, "root": 1, "c": 1, "b": 2}
    assert sorted(map(tuple, issues.collect())) == [("missing-session", "b", "elsewhere"), ("missing-session", "root", "gone"), ("parent-conflict", "b", "root")]
    found, issues = workflow.expanded(sessions, seeds("x", "lone"))
    assert {r.session_id for r in found.collect()} == {"x", "y", "lone"}
    assert sorted(map(tuple, issues.collect())) == [("ambiguous-session", "lone", "twin"), ("parent-cycle", "x", "x"), ("parent-cycle", "y", "x")]
    with pytest.raises(workflow.WorkflowLimit):
        workflow.expanded(sessions, seeds("a"), most=3)
    assert workflow.expanded(sessions, seeds("nobody"))[0].count() == 0
