"""Rules with fixed values on texts whose results are written out: secrets in assignments, waits, checks, paths, codes of an input."""

import pytest
from pyspark.sql import functions as F

from loomlight.functions import classifiers as C
from loomlight.functions import scalars as S
from loomlight.operators import validation as V

ASSIGNED = {
    "TOKEN=$(echo $(cat f) hunter2secret)": "[assigned-secret]",
    "TOKEN=$(a) then (b)": "[assigned-secret]",
    "x TOKEN=$(open": "x [assigned-secret](open",
    r"API_KEY='it\'s' next": "[assigned-secret] next",
    'my_secret="a b" c': "[assigned-secret] c",
    "password=`run x` y": "[assigned-secret] y",
    "db-password+=${A:-b} z": "[assigned-secret] z",
    r"token=a\ b c": "[assigned-secret] c",
    "PASSWD=a$b$(c) d": "[assigned-secret] d",
    "Narrative token: x": "Narrative token: x",
    "tokens=5": "tokens=5",
    "TOKEN=$(a\nb)": "[assigned-secret](a\nb)",
    "secret='open": "secret='open",
}


@pytest.mark.parametrize(("text", "expected"), ASSIGNED.items())
def test_assigned_secrets(spark, text, expected):
    rules = {"assigned-secret": C.REDACTIONS["assigned-secret"]}
    ((found,),) = spark.createDataFrame([(text,)], "t string").select(C.redacted(F.col("t"), rules)).collect()
    assert found == expected


def test_long_values_need_no_stack(spark):
    texts = ["TOKEN=$(" + "(a) " * 50_000 + ")", "TOKEN='" + r"\'" * 100_000 + "'", "secret=" + "x" * 300_000, "TOKEN=" + "$a" * 100_000]
    rules = {"assigned-secret": C.REDACTIONS["assigned-secret"]}
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(C.redacted(F.col("t"), rules)).collect()
    assert {r[0] for r in found} == {"[assigned-secret]"}


def test_waits_and_checks(spark):
    rows = [
        ("wait_agent", None, True, False), ("wait", '{"cell_id": 1}', True, False), ("wait", "the cell_id of it", False, False), ("write_stdin", "session_id:2", True, False), ("wait", "session_id: 2", False, False), (None, None, False, False),
        ("exec_command", "cd x && npm run lint:all", False, True), ("exec_command", "latest_test_run", False, False), ("exec_command", "cargo clippy", False, True), ("exec_command", "git log", False, False),
        ("exec_command", "curl https://x -o y", False, True), ("exec_command", "curl -XPOST https://x", False, False), ("exec_command", "curl --request=HEAD https://x", False, True), ("exec_command", "curl https://x --data-raw a", False, False),
        ("exec_command", "curl -F a=b https://x", False, False), ("exec_command", None, False, False), ("bash", "pytest", False, False),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "tool string, args string")
    found = df.select("tool", "args", C.is_expected_blocking(F.col("tool"), F.col("args")).alias("b"), (C.nested_tool(F.col("tool"), F.col("args")) == "exec_command.verify").alias("v")).collect()
    assert [(r.tool, r.args, r.b, bool(r.v)) for r in found] == rows


def test_paths_of_texts(spark):
    texts = {
        "see (/home/a/b.py:12:3), and /tmp/x].": ["/home/a/b.py", "/tmp/x"],
        "/etc/passwd and home/a": [],
        "/work//r/./src/../lib/ /work/r/lib/": ["/work/r/lib", "/work/r/lib/"],
        "/opt/a\\n /opt/a": ["/opt/a"],
        "/tmp/../../../x": ["/x"],
        " ".join(f"/tmp/{i}" for i in range(100)): [f"/tmp/{i}" for i in range(64)],
        "/tmp/" + "y" * 200_000 + " /tmp/z": [],
        "/tmp" + "/a" * 100_000: [],
        "/tmp" + "/a" * 90_000: ["/tmp" + "/a" * 90_000],
    }
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.absolute_paths("t").alias("p")).collect()
    assert {r.t: r.p for r in found} == texts


SPAN = "is_object boolean, trace_id string, span_id string, parent_span_id string, ord long, start_us long, end_us long, status_code string, kind string, model string, tool string, input_tokens long, output_tokens long, link_span_id string"


def span(i, parent=None, is_object=True, trace="t"):
    return (is_object, trace, i, parent, int((i or "0")[1:] or 0), 0, 1, "OK", "CHAIN", None, None, None, None, None)


def test_codes_of_inputs(spark):
    of = lambda rows, **how: {r.code: (r.spans, r.severity) for r in V.validated(spark.createDataFrame(rows, SPAN), ["ord"], **how).collect() if r.code != "non-hex-id"}
    assert of([]) == {"no-spans": (0, "error")}
    assert of([span(None, is_object=False)] * 3) == {"invalid-input": (3, "error"), "no-spans": (0, "error"), "invalid-span": (3, "error")}
    assert of([span("s1"), span(" "), span("s2", "s1")]) == {"invalid-span": (1, "warn")}
    assert of([span("s1", "s3"), span("s2", "s1"), span("s3", "s2"), span("s4", "s3"), span("s5", "s5")]) == {"cyclic-parent": (4, "warn")}
    assert of([span(f"s{i}", "s1" if i > 1 else None) for i in range(1, 9)], bound=5) == {"truncated-input": (3, "warn")}
    nothing = V.validated(spark.createDataFrame([], SPAN), ["ord"])
    evidence = spark.createDataFrame([(c, True) for c in V.CAPABILITIES], "capability string, there boolean")
    states = {r.capability: r.state for r in V.gated(V.capabilities(nothing, evidence)).collect()}
    assert set(states.values()) == {"skipped"} and len(states) == 7
    fine = V.gated(V.capabilities(nothing.limit(0), evidence)).collect()
    assert {r.capability for r in fine if r.state == "unbuilt"} == {"tree-comparison"}
