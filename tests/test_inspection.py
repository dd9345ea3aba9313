"""Inspection rules at their thresholds, edges to ambiguous parents, null keys of as-of joins."""

from loomlight.operators import findings as R
from loomlight.operators import joins as J

SESSIONS = "trace_id string, attributed boolean, loops long, calls long, errors long, tokens long"
FILES = "path string, root string, kind string, lines int, has_toc boolean, rows long, invalid_rows long, linked_rows long"


def told(spark, sessions, files):
    return {r.id: (r.severity, r.impact) for r in R.inspect(spark.createDataFrame(sessions, SESSIONS), spark.createDataFrame(files, FILES)).collect()}


def test_inspection_rules(spark):
    doc = ("a", "/r", "instruction-doc", 99, False, None, 0, None)
    assert told(spark, [], []) == {"index.no-sessions": ("high", 100)}
    assert told(spark, [("s", True, 0, 5, 0, 0)], []) == {"context.none-indexed": ("medium", 1)}
    quiet = [(f"s{i}", True, 0, 100, 9, 499_999) for i in range(10)]
    assert told(spark, quiet, [doc]) == {}
    some = [("a", False, 1, 100, 10, 500_000), *quiet]
    assert told(spark, some, [doc]) == {"repo.missing-attribution": ("medium", 1), "session.repeated-call-loops": ("medium", 1), "session.tool-errors": ("medium", 10), "session.large-token-runs": ("low", 500_000)}
    worse = [("a", False, 9, 10, 3, 1_000_000), ("b", False, 1, 0, 0, 0), ("c", True, 0, 0, 0, 0)]
    assert told(spark, worse, [doc]) == {"repo.missing-attribution": ("high", 2), "session.repeated-call-loops": ("high", 10), "session.tool-errors": ("high", 3), "session.large-token-runs": ("medium", 1_000_000)}
    files = [("b", "/r", "reflection", 40, False, None, 0, None), ("c", "/q", "skill-runs", 0, None, 5, 2, 0), ("d", "/q", "skill-runs", 0, None, 5, 0, 4), ("e", "/q", "handoff", 500, True, None, 0, None)]
    assert told(spark, quiet, files) == {"context.no-instruction-docs": ("medium", 2), "context.long-narrative-docs-without-toc": ("low", 40), "context.invalid-jsonl": ("high", 2), "context.skill-run-trace-links": ("medium", 6)}
    assert told(spark, quiet, [("a", "/r", "instruction-doc", 200, False, None, 0, None)]) == {"context.long-docs-without-toc": ("medium", 200)}
    assert told(spark, [], files) == {"index.no-sessions": ("high", 100), **{k: v for k, v in told(spark, quiet, files).items()}}


def test_edges_to_ambiguous_parents_are_dropped(spark):
    rows = [("a", "/1", None), ("b", "/2", "a"), ("c", "/3", "t"), ("t", "/4", "a"), ("t", "/5", "a"), ("d", "/6", "lost")]
    found = J.without_ambiguous_parents(spark.createDataFrame(rows, "node string, path string, parent string"), "node", "path", "parent")
    assert sorted(((r.node, r.path, r.parent, r.dropped_edge) for r in found.collect()), key=repr) == sorted([("a", "/1", None, False), ("b", "/2", "a", False), ("c", "/3", None, True), ("t", "/4", "a", False), ("t", "/5", "a", False), ("d", "/6", "lost", False)], key=repr)


def test_null_keys_match_nothing_as_of(spark):
    left = spark.createDataFrame([("a", 5), (None, 5)], "k string, at int")
    right = spark.createDataFrame([("a", 1, 7), (None, 1, 8)], "k string, at int, v int")
    assert {r.k: r.v for r in J.as_of(left, right, "k", "at", "v").collect()} == {"a": 7, None: None}
