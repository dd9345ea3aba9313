"""Operators on small spans with known answers, nulls, empty input and dealt rows."""

import pytest
from pyspark.sql import functions as F

from loomlight.functions import classifiers as C
from loomlight.functions import scalars as S
from loomlight.operators import aggregates as A
from loomlight.operators import graphs as G
from loomlight.operators import joins as J
from loomlight.operators import validation as V
from loomlight.operators import windows as W

SCHEMA = """trace_id string, span_id string, parent_span_id string, ord long, start_us long, end_us long, name string, kind string, tool string,
args string, expected_blocking boolean, status_code string, status_message string, model string, input_tokens long, output_tokens long, cost_usd double,
loop_id string, iteration double, outcome string, score double, link_span_id string, link_kind string, cwd string"""
NAMES = [x.split()[0] for x in SCHEMA.replace("\n", " ").split(",")]


def spans(spark, *rows):
    base = {"trace_id": "t", "kind": "TOOL", "name": "x", "expected_blocking": False, "status_code": "UNSET"}
    made = []
    for i, r in enumerate(rows):
        one = base | {"span_id": f"s{i}", "ord": i, "start_us": i * 1_000_000, "end_us": i * 1_000_000 + 100_000, "parent_span_id": "root"} | r
        made.append(tuple(one.get(n) for n in NAMES))
    return spark.createDataFrame(made, SCHEMA)


def call(at, tool="bash", args="{}", **more):
    return {"start_us": at * 1_000_000, "end_us": at * 1_000_000 + 100_000, "tool": tool, "args": args} | more


def test_stuck_loop_of_three(spark):
    s = spans(spark, call(0), call(1), call(2))
    assert [(r.occurrences, r.window_us) for r in A.stuck_loops(s).collect()] == [(3, 2_000_000)]
    assert A.affected_ratio(A.stuck_loops(s), s).first().affected_ratio == 1
    assert [r.occurrences for r in A.stuck_loops(s.repartition(3)).collect()] == [3]


def test_calls_over_a_minute_apart_do_not_combine(spark):
    assert A.stuck_loops(spans(spark, call(1), call(62), call(123))).count() == 0


def test_uncaptured_and_blocking_calls_do_not_count(spark):
    assert A.stuck_loops(spans(spark, *[call(i, args=None) for i in range(3)])).count() == 0
    assert A.stuck_loops(spans(spark, *[call(i, expected_blocking=True) for i in range(3)])).count() == 0
    assert A.stuck_loops(spans(spark, *[call(i, args="") for i in range(3)])).count() == 1


def test_failed_call_is_followed(spark):
    s = spans(spark, call(0, status_code="ERROR"), call(1, tool="read"), call(2))
    found = {r.tool: (r.errors, r.retried) for r in A.tool_use(s).collect()}
    assert found == {"bash": (1, 1), "read": (0, 0)}


def test_duplicates_and_latency(spark):
    s = spans(spark, call(0), call(1), call(2))
    assert A.run_metrics(A.tool_use(s)).first().duplicate_rate == pytest.approx(2 / 3)
    assert A.weighted_latency(A.tool_use(s)).first().mean_latency_ms == 100


def test_failed_root_but_not_recovered_tool_error(spark):
    s = spans(spark, {"parent_span_id": None, "kind": "AGENT", "status_code": "ERROR", "status_message": "boom"}, {"trace_id": "u", "parent_span_id": None, "kind": "AGENT"}, call(3, trace_id="u", status_code="ERROR"))
    assert [(r.failure_class, r.status_message, r.runs, r.example_run) for r in A.failure_clusters(s).collect()] == [("unknown", "boom", 1, "t")]


@pytest.mark.parametrize(
    ("scores", "outcomes", "trend", "basis"),
    [([0.2, 0.5, 0.9], None, "improved", "score"), ([0.5, 0.5, 0.5], None, "plateaued", "score"), ([0.9, 0.4], None, "regressed", "score"), ([0.4, 0.9, 0.4], None, "mixed", "score"), (None, ["fail", "pass"], "improved", "outcome"), (None, [None, None], "unscored", "none")],
)
def test_trends(spark, scores, outcomes, trend, basis):
    n = len(scores or outcomes)
    s = spans(spark, *[{"loop_id": "l", "iteration": float(i), "score": scores and scores[i], "outcome": outcomes and outcomes[i]} for i in range(n)])
    assert [(r.trend, r.basis) for r in W.trends(s).collect()] == [(trend, basis)]


def chat(spark, *turns):
    rows = [("t", f"s{i}", i, "user.prompt" if who != "a" else "message.assistant", "LLM" if who == "a" else "CHAIN", {"h": "human", "i": "injected", "a": None}[who], text) for i, (who, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "trace_id string, span_id string, step long, name string, kind string, actor string, content string")


def test_reactions_follow_a_fresh_assistant_turn(spark):
    found = W.reactions(chat(spark, ("a", "did it"), ("h", "no, that is wrong"), ("a", "again"), ("h", "perfect, thanks"))).collect()
    assert [r.step for r in found] == [1, 3]
    assert W.reactions(chat(spark, ("h", "first"), ("i", "injected"))).count() == 0
    # an injected turn neither counts nor resets; a second human turn has nothing fresh
    assert [r.step for r in W.reactions(chat(spark, ("a", "x"), ("i", "y"), ("h", "z"), ("h", "w"), ("a", " "), ("h", "v"))).collect()] == [2]


def test_dangling_link_is_kept(spark):
    s = spans(spark, {"link_span_id": "gone"}, {"link_span_id": "s0", "link_kind": "steered_by"})
    found = {r.link_kind: (r.links, r.dangling) for r in A.link_kinds(J.link_edges(s)).collect()}
    assert found == {"unspecified": (1, 1), "steered_by": (1, 0)}


def test_unknown_cost_is_not_zero(spark):
    s = spans(spark, {"kind": "LLM", "cost_usd": 0.02, "input_tokens": 100}, {"kind": "LLM", "input_tokens": 5}, {"kind": "LLM"})
    r = A.cost_provenance(s).first()
    assert (r.observed, r.estimated, r.uncaptured) == (1, 1, 1)
    assert A.session_records(spans(spark, {"kind": "LLM"})).first().usd is None


def test_direct_and_aggregate_usage_stay_apart(spark):
    s = spans(spark, {"kind": "AGENT", "input_tokens": 1000, "output_tokens": 500}, {"kind": "LLM", "input_tokens": 100, "output_tokens": 20})
    r = A.token_totals(s).first()
    assert (r.direct_input, r.direct_output, r.aggregate_input, r.aggregate_output) == (100, 20, 1000, 500)


def test_monotone_usage(spark):
    up = [{"kind": "LLM", "input_tokens": n, "output_tokens": 600 - n} for n in (100, 200, 300, 400, 500)]
    assert [(r.input_growth, r.output_decay) for r in W.monotone_usage(spans(spark, *up)).collect()] == [(True, True)]
    up[3]["input_tokens"] = 50
    assert not W.monotone_usage(spans(spark, *up)).first().input_growth


def test_identity_merge(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y")], "ord int, id string, content string")
    kept, later = J.identity_merge(rows, ["id"], "content", "ord")
    assert [r.ord for r in kept.collect()] == [1]
    assert {r.ord: r.verdict for r in later.collect()} == {2: "repeat", 3: "conflict"}


def test_tree_with_orphan_and_cycle(spark):
    nodes = spark.createDataFrame([("a", None, 1.0, None), ("b", "a", 2.0, "w"), ("c", "b", None, None), ("o", "zz", 4.0, None), ("x", "y", 1.0, None), ("y", "x", 1.0, None)], "node string, parent string, usd double, agent string")
    totals = {r.node: (r.records, r.usd, r.usd_unknown) for r in G.subtree_totals(nodes).collect()}
    assert totals["a"] == (3, 3.0, 1) and totals["c"] == (1, None, 1)
    tree = {r.node: r.enclosing for r in G.run_tree(nodes).collect()}
    assert tree == {"a": "a", "b": "a", "c": "a", "o": "o"}  # an unknown agent above is no change of agent; a pure cycle has no root
    assert {(r.node, r.cycle) for r in G.cycles(nodes).collect()} == {("x", "x"), ("y", "x")}
    assert {r.node for r in G.reach(nodes.filter("parent is not null").select("parent", F.col("node").alias("child")), nodes.filter("node = 'c'"), 1).collect()} == {"b", "c"}


def test_nested_grade_is_not_the_outer_one(spark):
    nodes = spark.createDataFrame([("o", None, True, None, 0), ("n", "o", True, None, 1), ("e", "n", False, "pass", 2), ("p", None, True, None, 3), ("q", "p", False, "fail", 4)], "node string, parent string, is_round boolean, verdict string, ord int")
    assert {r["round"]: r.verdict for r in G.round_verdicts(nodes).collect()} == {"o": None, "n": "pass", "p": "fail"}


DEFECTS = {
    "non-hex-id": {},
    "missing-trace-id": {"trace_id": " "},
    "orphan-parent": {"parent_span_id": "gone"},
    "invalid-timestamp": {"end_us": None},
    "negative-duration": {"start_us": 10, "end_us": 5},
    "invalid-status": {"status_code": "WEIRD"},
    "unknown-span-kind": {"kind": "TELEPATHY"},
    "missing-model": {"kind": "LLM"},
    "no-usage": {"kind": "LLM", "model": "m"},
    "missing-tool-name": {"kind": "TOOL"},
    "dangling-link": {"link_span_id": "gone"},
}


@pytest.mark.parametrize("code", sorted(DEFECTS))
def test_finding_codes(spark, code):
    found = {r.code for r in V.findings(spans(spark, DEFECTS[code])).collect()}
    assert code in found and found <= set(V.CODES)


def test_findings_between_rows(spark):
    s = spans(spark, {"trace_id": "t", "span_id": "p", "parent_span_id": None}, {"trace_id": "u", "span_id": "c", "parent_span_id": "p"}, {"trace_id": "u", "span_id": "c", "parent_span_id": "p"}, {"trace_id": "v", "span_id": "p", "parent_span_id": None})
    found = {r.code: r.spans for r in V.findings(s).collect()}
    assert found["duplicate-span-id"] == 1 and found["redeclared-span"] == 1
    assert V.findings(s.limit(0)).count() == 0


def test_as_of_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([("k", 5, "a"), ("k", 1, "b"), ("z", 9, "c")], "key string, at int, id string")
    right = spark.createDataFrame([("k", 2, 20), ("k", 5, 50), ("k", 6, 60)], "key string, at int, value int")
    assert {r.id: r.value for r in J.as_of(left, right, "key", "at", "value").collect()} == {"a": 50, "b": None, "c": None}


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, S.git_remote("x"), x="git@github.com:Own/Repo.git") == "github.com/own/repo"
    assert one(spark, S.git_remote("x"), x="https://user@github.com/own/repo.git") == "github.com/own/repo"
    assert one(spark, S.iso_to_epoch_ms("x"), x="1970-01-01T00:00:01Z") == 1000
    assert one(spark, S.iso_to_epoch_ms("x"), x="1234") == 1234
    assert one(spark, S.iso_to_epoch_ms("x"), x="whenever") is None
    assert one(spark, S.instant("x"), x=1_700_000_000) == 1_700_000_000_000
    assert one(spark, S.uuid7_ms("x"), x="018bcfe5-6800-7000-8000-000000000000") == 1_700_000_000_000
    assert one(spark, S.return_code("x"), x="<returncode>-1</returncode>") == -1
    assert one(spark, S.finding_step("x"), x="incorrect-step-12") == 12
    assert one(spark, S.canonical_json("x"), x='{"b":1,"a":[2]}') == '{"a":[2],"b":1}'
    assert one(spark, S.span_uri(F.col("x"), F.lit("b(c)")), x="a b") == "trace://a%20b/span/b(c)"
    assert one(spark, S.under(F.col("x"), "/repo"), x="/repo-old") is False
    assert one(spark, S.capped("x", 3), x="abcdef") == "abc… [+3 chars]"


def test_classifiers(spark):
    assert one(spark, C.status_code(F.col("x")), x="STATUS_CODE_ERROR") == "ERROR"
    assert one(spark, C.reaction_labels(F.col("x")), x="No, that is wrong. Thanks!") == ["correction"]
    assert one(spark, C.redacted(F.col("x")), x="mail a.b@c.org from 10.0.0.1") == "mail [email] from [ipv4]"
    assert one(spark, C.is_expected_blocking(F.col("x"), F.lit("")), x="wait_agent") is True
