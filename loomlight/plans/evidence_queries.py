"""Context roots, fork boundaries, replays and connected sessions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.outputs import output_failed
from ..operators import context as C
from ..operators import forks, payload, replay, workflow
from .projection import load
from .registry import query
from .span_queries import ev

_ROOTS = """w AS (SELECT DISTINCT trace_id, cwd FROM ev), marked AS (SELECT DISTINCT folder FROM ctx_files WHERE name IN ('AGENTS.md', 'CLAUDE.md', '.git', '.evolve')),
roots AS (SELECT trace_id, cwd, coalesce(max_by(folder, length(folder)), cwd) AS root FROM w LEFT JOIN marked ON cwd = folder OR starts_with(cwd, concat(folder, '/')) GROUP BY trace_id, cwd)"""


@query("j18_context_roots", f"WITH {_ROOTS} SELECT * FROM roots")
def j18(spark, sf):
    return C.context_roots(ev(spark, sf), load(spark, sf, "ctx_files"))


@query("j18_context_index", f"WITH {_ROOTS} SELECT root, sessions, coalesce(files, 0) AS files, coalesce(docs, 0) AS instruction_docs FROM (SELECT root, count(DISTINCT trace_id) AS sessions FROM roots GROUP BY root) LEFT JOIN (SELECT folder AS root, count(*) AS files, count(*) FILTER (name IN ('AGENTS.md', 'CLAUDE.md')) AS docs FROM ctx_files GROUP BY folder) USING (root)")
def j18_index(spark, sf):
    files = load(spark, sf, "ctx_files")
    return C.context_index(C.context_roots(ev(spark, sf), files), files)


def _made(x: str) -> str:
    """Milliseconds of a version-7 UUID, in SQL."""
    return f"CASE WHEN regexp_full_match({x}, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-7[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}') THEN CAST('0x' || substr({x}, 1, 8) || substr({x}, 10, 4) AS BIGINT) END"


#: An hour: events of the driver's tables are far apart.
_BAND = 3600


@query(
    "n11_fork_boundaries",
    f"""WITH t AS (SELECT DISTINCT child, turn_id, started_s FROM fork_turns), tm AS (SELECT *, {_made("turn_id")} AS made FROM t),
    c AS (SELECT *, {_made("session_id")} AS own FROM fork_children),
    e AS (SELECT child, count(DISTINCT turn_id) AS n, min(turn_id) AS turn FROM c JOIN tm USING (child) WHERE turn_id = session_id GROUP BY child),
    later AS (SELECT c.child, tm.turn_id, tm.made FROM c JOIN tm ON tm.child = c.child AND tm.made >= c.own), first AS (SELECT child, min(made) AS made FROM later GROUP BY child),
    m AS (SELECT child, count(DISTINCT turn_id) AS n, min(turn_id) AS turn FROM later JOIN first USING (child, made) GROUP BY child),
    b AS (SELECT c.child, count(DISTINCT turn_id) AS n, min(turn_id) AS turn FROM c JOIN tm ON tm.child = c.child AND abs(tm.started_s - c.started_s) <= {_BAND} GROUP BY c.child),
    r AS (SELECT c.child, CASE WHEN e.n > 0 THEN 'exact' WHEN m.n > 0 THEN 'created' WHEN b.n > 0 THEN 'near' END AS rung, coalesce(e.n, m.n, b.n, 0) AS matches, coalesce(e.turn, m.turn, b.turn) AS turn FROM c LEFT JOIN e USING (child) LEFT JOIN m USING (child) LEFT JOIN b USING (child))
    SELECT child, rung, CASE WHEN matches = 0 THEN 'missing' WHEN matches = 1 THEN 'resolved' ELSE 'ambiguous' END AS state, CASE WHEN matches = 1 THEN turn END AS turn_id, matches FROM r""",
)
def n11(spark, sf):
    return forks.fork_boundaries(load(spark, sf, "fork_children"), load(spark, sf, "fork_turns"), _BAND)


_CASES = """tg AS (SELECT case_id, min(step) AS target FROM rec_steps WHERE returncode <> 0 GROUP BY case_id),
al AS (SELECT a.case_id, a.step, target, a.returncode AS ra, b.returncode AS rb, b.case_id IS NOT NULL AS ran, a.command = b.command AND a.returncode = b.returncode AS alike, contains(b.output, a.signature) AS seen FROM tg JOIN rec_steps a USING (case_id) LEFT JOIN rerun_steps b ON b.case_id = a.case_id AND b.step = a.step),
cs AS (SELECT case_id, target, count(*) FILTER (step < target AND ran) AS prefix_executed, count(*) FILTER (step < target AND ran AND NOT alike) AS divergences, max(ra) FILTER (step = target) AS recorded_returncode, coalesce(bool_or(ra = rb) FILTER (step = target), false) AS returncode_match, coalesce(bool_or(seen) FILTER (step = target), false) AS signature_match FROM al GROUP BY case_id, target),
rp AS (SELECT *, round(coalesce(divergences * 100 / nullif(prefix_executed, 0), 0), 1) AS divergence_pct, coalesce(divergences * 100 / nullif(prefix_executed, 0), 0) <= 10 AND returncode_match AS replayed FROM cs)"""
_FIXES = "fx AS (SELECT case_id, bool_or(executed) AS executed, bool_or(attempt = 1 AND executed) AS first_executed, min(attempt) FILTER (executed AND vanished) AS flipped_at FROM fix_tries GROUP BY case_id)"


@query("a34_divergence", f"WITH {_CASES} SELECT * FROM rp")
def a34(spark, sf):
    recorded = load(spark, sf, "rec_steps")
    return replay.replayed_cases(recorded, load(spark, sf, "rerun_steps"), replay.failing_steps(recorded))


@query("a34_aligned_steps", "SELECT CASE WHEN b.case_id IS NULL THEN 'missing' WHEN a.case_id IS NULL THEN 'extra' WHEN a.command <> b.command THEN 'command' WHEN a.returncode <> b.returncode THEN 'returncode' ELSE 'same' END AS difference, count(*) AS steps FROM rec_steps a FULL JOIN rerun_steps b ON a.case_id = b.case_id AND a.step = b.step GROUP BY 1")
def a34_steps(spark, sf):
    return replay.aligned(load(spark, sf, "rec_steps"), load(spark, sf, "rerun_steps")).groupBy("difference").agg(F.count("*").alias("steps"))


_RATE = "SELECT '{0}' AS rate, count(*) FILTER ({1}) AS numerator, count(*) FILTER ({2}) AS denominator FROM j"
_RATES = " UNION ALL ".join(
    _RATE.format(*x)
    for x in (
        ("replayability", "replayed", "true"),
        ("signature-strict", "replayed AND signature_match", "true"),
        ("fix-flip", "executed AND flipped_at IS NOT NULL", "executed"),
        ("fix-flip-nonzero", "executed AND recorded_returncode <> 0 AND flipped_at IS NOT NULL", "executed AND recorded_returncode <> 0"),
        ("fix-flip-first", "flipped_at = 1", "first_executed"),
    )
)


@query("a28_replay_rates", f"WITH {_CASES}, {_FIXES}, j AS (SELECT * FROM rp LEFT JOIN fx USING (case_id)) SELECT *, round(numerator / nullif(denominator, 0), 9) AS value FROM ({_RATES})")
def a28(spark, sf):
    return replay.rates(a34(spark, sf), replay.fixes(load(spark, sf, "fix_tries")))


@query("a28_flips_by_attempt", f"WITH {_FIXES} SELECT flipped_at AS attempt, count(*) AS cases FROM fx WHERE flipped_at IS NOT NULL GROUP BY 1")
def a28_flips(spark, sf):
    return replay.flips_by_attempt(replay.fixes(load(spark, sf, "fix_tries")))


@query("r02_verdicts", f"WITH {_CASES}, {_FIXES} SELECT CASE WHEN NOT replayed THEN 'divergent' WHEN flipped_at IS NOT NULL THEN 'fix-flipped' ELSE 'reproduced' END AS verdict, count(*) AS runs FROM rp LEFT JOIN fx USING (case_id) GROUP BY 1")
def r02(spark, sf):
    from ..operators.findings import verdicts

    rows = a34(spark, sf).join(replay.fixes(load(spark, sf, "fix_tries")), "case_id", "left")
    return verdicts(rows.withColumn("flipped", F.col("flipped_at").isNotNull())).groupBy("verdict").agg(F.count("*").alias("runs"))


def _kin(spark, sf):
    rows = load(spark, sf, "kin")
    return rows.groupBy("session_id", "path", "user_id").agg(F.min("parent_id").alias("parent_id"), F.collect_set("child_id").alias("child_ids"))


#: Sessions of a tenth of the users are connected here; the default bound is for one selected tree.
_MANY = 1_000_000
_EXPANDED = """WITH RECURSIVE rf AS (SELECT session_id, parent_id AS other, 'parent' AS relation FROM kin WHERE parent_id IS NOT NULL UNION SELECT session_id, child_id, 'child' FROM kin WHERE child_id IS NOT NULL),
pt AS (SELECT session_id, count(DISTINCT path) AS paths FROM kin GROUP BY session_id), fl AS (SELECT rf.session_id, other FROM rf JOIN pt ON pt.session_id = other AND paths = 1),
sd AS (SELECT session_id FROM (SELECT min(session_id) AS session_id FROM kin WHERE user_id % 10 = 0 GROUP BY user_id) JOIN pt USING (session_id) WHERE paths = 1), ds AS (SELECT session_id, 0 AS distance FROM sd UNION SELECT other, distance + 1 FROM ds JOIN fl USING (session_id) WHERE distance < 60),
mb AS (SELECT session_id, min(distance) AS distance FROM ds GROUP BY session_id)"""


def _expanded(spark, sf):
    kin = _kin(spark, sf)
    seeds = kin.filter("user_id % 10 = 0").groupBy("user_id").agg(F.min("session_id").alias("session_id"))
    return workflow.expanded(kin, seeds, _MANY)


@query("g08_workflow_sessions", f"{_EXPANDED} SELECT * FROM mb")
def g08_sessions(spark, sf):
    return _expanded(spark, sf)[0]


@query(
    "g08_workflow_issues",
    f"""{_EXPANDED}, own AS (SELECT rf.* FROM rf JOIN mb USING (session_id)), cl AS (SELECT other AS session_id, string_agg(DISTINCT session_id, ',' ORDER BY session_id) AS claimed, count(DISTINCT session_id) AS n FROM own WHERE relation = 'child' AND other IN (SELECT session_id FROM mb) GROUP BY other),
    dc AS (SELECT session_id, min(parent_id) AS declared FROM kin WHERE session_id IN (SELECT session_id FROM mb) GROUP BY session_id),
    bt AS (SELECT dc.session_id, declared, coalesce(claimed, '') AS claimed, coalesce(n, 0) AS n, declared IN (SELECT session_id FROM mb) AS present FROM dc LEFT JOIN cl USING (session_id))
    SELECT DISTINCT CASE WHEN paths > 1 THEN 'ambiguous-session' ELSE 'missing-session' END AS kind, own.session_id, other FROM own LEFT JOIN pt ON pt.session_id = other WHERE other NOT IN (SELECT session_id FROM mb)
    UNION ALL SELECT 'parent-conflict', session_id, claimed FROM bt WHERE n > 1 OR (n = 1 AND claimed IS DISTINCT FROM declared) OR (coalesce(present, false) AND NOT coalesce(list_contains(string_split(claimed, ','), declared), false))""",
)
def g08_issues(spark, sf):
    return _expanded(spark, sf)[1]


@query("n15_output_failures", "SELECT event_id, CASE WHEN form IN (0, 1, 4, 5, 8) THEN code <> 0 WHEN form = 2 THEN false WHEN form IN (3, 6, 9, 10) THEN true END AS failed FROM tool_outputs")
def n15(spark, sf):
    return load(spark, sf, "tool_outputs").select("event_id", output_failed(F.col("output")).alias("failed"))


#: Characters of an attribute in this query, and of the payload for each document; whole documents are far more.
_CAP, _EACH = 200, 600


@query("p19_capped_attributes", f"SELECT doc_id, CASE WHEN length(CAST(to_json(text) AS VARCHAR)) <= {_CAP} THEN text ELSE concat(left(text, {_CAP}), '…[truncated ', length(text) - {_CAP}, ' chars]') END AS content FROM documents")
def p19(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", F.map_from_arrays(F.array(F.lit("content")), F.array(F.col("text").cast("variant"))).alias("attributes"))
    cut, _ = payload.budgeted(rows, budget=_EACH * docs.count(), cap=_CAP)
    return cut.select("doc_id", F.try_variant_get(F.col("attributes")["content"], "$", "string").alias("content"))
