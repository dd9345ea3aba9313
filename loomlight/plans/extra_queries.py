"""Queries over the extra operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import collection as K
from ..operators import extras as E
from .registry import query
from .relation_queries import parquet
from .span_queries import _LOOPS, DAY_US, ev

_EVENT = "CASE name WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'other' END"


@query("n18_lifecycles", f"WITH e AS (SELECT trace_id, ord, {_EVENT} AS event FROM ev), s AS (SELECT *, max(CASE WHEN event = 'started' THEN ord END) OVER (PARTITION BY trace_id) AS last_start FROM e), f AS (SELECT trace_id, count(*) FILTER (event = 'started') AS starts, max(last_start) AS ls, arg_min(event, ord) FILTER (ord > last_start AND event IN ('completed', 'failed')) AS ended FROM s GROUP BY trace_id) SELECT trace_id, CASE WHEN ls IS NULL THEN 'none' ELSE coalesce(ended, 'started') END AS state, starts FROM f")
def n18(spark, sf):
    return E.lifecycles(ev(spark, sf).select("trace_id", "ord", F.expr(_EVENT).alias("event")))


@query("f08_truncated_values", "SELECT conv_id, turn, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS bytes, octet_length(encode(text)) > 1000 AS truncated FROM conversations")
def f08(spark, sf):
    return parquet(spark, sf, "conversations").select("conv_id", "turn", E.truncated(F.col("text"), 1000).alias("t")).select("conv_id", "turn", "t.sha256", F.col("t.bytes").cast("long").alias("bytes"), "t.truncated")


@query("s26_step_constraints", "WITH o AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY l_orderkey), b AS (SELECT coalesce(o_orderkey, l_orderkey) AS traj_id, n, d, lo, hi, CASE WHEN o_orderkey IS NOT NULL THEN 4 END AS step_count FROM orders FULL OUTER JOIN o ON o_orderkey = l_orderkey), p AS (SELECT traj_id, CASE WHEN n IS NULL THEN 'no steps' WHEN step_count IS NULL THEN 'not declared' WHEN n <> d THEN 'repeated step' WHEN lo <> 1 OR hi <> n THEN 'gap' WHEN n <> step_count THEN 'count differs' END AS problem FROM b) SELECT * FROM p WHERE problem IS NOT NULL")
def s26(spark, sf):
    steps = parquet(spark, sf, "lineitem").select(F.col("l_orderkey").alias("traj_id"), F.col("l_linenumber").alias("step_id"))
    return E.step_constraints(steps, parquet(spark, sf, "orders").select(F.col("o_orderkey").alias("traj_id"), F.lit(4).alias("step_count")))


@query("f17_named_folders", "WITH p AS (SELECT page_id, unnest(regexp_extract_all(url, '/[A-Za-z0-9._-]+/[A-Za-z0-9._-]+')) AS folder FROM pages), c AS (SELECT page_id, folder, count(*) AS n FROM p GROUP BY ALL) SELECT page_id, folder, n FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, folder) AS r FROM c) WHERE r = 1")
def f17(spark, sf):
    return E.repo_of_paths(parquet(spark, sf, "pages"), "page_id", "url")


@query("o05_seeded_sample")
def o05(spark, sf):
    return E.seeded_sample(parquet(spark, sf, "events").select("event_id"), "event_id", 17, 25)


@query("o07_distinct_behaviours")
def o07(spark, sf):
    return E.distinct_behaviours(parquet(spark, sf, "embeddings"), 5)


@query("f23_deep_values", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS v FROM events")
def f23(spark, sf):
    return parquet(spark, sf, "events").select("event_id", F.get(E.deep_values(F.col("props"), "k"), F.lit(0)).alias("v"))


@query("a26_markdown", "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS lines, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '^#{1,6}\\s+\\S'))) AS headings, regexp_matches(coalesce(text, ''), '(?i)\\btable of contents\\b') OR regexp_matches(coalesce(text, ''), '(?m)^\\s*-\\s+\\[[^\\]]+\\]\\(#[^)]+\\)') AS has_toc FROM documents")
def a26_markdown(spark, sf):
    return parquet(spark, sf, "documents").select("doc_id", K.markdown_summary(F.col("text")).alias("m")).select("doc_id", "m.*")


@query("a26_json_keys", "WITH k AS (SELECT event_type, unnest(json_keys(props)) AS key FROM events), r AS (SELECT event_type, count(*) AS rows, count(*) FILTER (NOT json_valid(props)) AS invalid_rows FROM events WHERE trim(props) <> '' GROUP BY ALL) SELECT event_type, rows, invalid_rows, key, count(*) AS n FROM r LEFT JOIN k USING (event_type) GROUP BY ALL")
def a26_json_keys(spark, sf):
    lines = parquet(spark, sf, "events").select("event_type", F.col("props").alias("value"))
    return K.json_line_counts(lines, "event_type").join(K.json_line_keys(lines, "event_type"), "event_type", "left")


@query("a29_unreadable_rows", "WITH s AS (SELECT l_suppkey AS source, max(l_linenumber)::BIGINT AS inherited FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), i AS (SELECT l_suppkey AS source, count(*) AS new FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), k AS (SELECT l_suppkey AS source, l_linestatus AS kind FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_returnflag = 'A'), n AS (SELECT source, string_agg(kind, ',' ORDER BY kind) AS kinds FROM k GROUP BY source) SELECT source, coalesce(inherited, 0) AS inherited, coalesce(inherited, 0) + coalesce(new, 0) AS rows, kinds FROM s FULL JOIN i USING (source) JOIN n USING (source)")
def a29(spark, sf):
    lines = parquet(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "source")
    spans = lines.filter("l_returnflag = 'R'").select("source", F.col("l_linenumber").alias("unreadable_rows"), F.col("l_linestatus").alias("unreadable_kinds"))
    return K.unreadable_rows(spans, lines.filter("l_returnflag = 'A'").select("source", F.col("l_returnflag").alias("kind")))


@query(
    "f24_session_kin",
    "WITH s AS (SELECT l_orderkey AS session, l_suppkey::VARCHAR AS child, l_returnflag AS f FROM lineitem) SELECT session, coalesce(array_to_string(list_sort(list(DISTINCT child) FILTER (f IN ('R', 'A'))), ','), '') AS children, coalesce(array_to_string(list_sort(list(DISTINCT child) FILTER (f = 'R')), ','), '') AS spawned, coalesce(array_to_string(list_sort(list_filter(list(DISTINCT child) FILTER (f = 'A'), lambda x: NOT coalesce(list_contains(list(DISTINCT child) FILTER (f = 'R'), x), false))), ','), '') AS resumed FROM s GROUP BY session",
)
def f24(spark, sf):
    operation = F.expr("CASE l_returnflag WHEN 'R' THEN 'spawn_agent' WHEN 'A' THEN 'send_input' ELSE 'wait_agent' END")
    ids = F.to_json(F.array(F.col("l_suppkey").cast("string")))
    spans = parquet(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session"), F.lit(None).cast("string").alias("child_ids"), ids.alias("agent_ids"), operation.alias("operation"), F.lit(None).cast("string").alias("lifecycle_child"))
    kin = K.session_kin(spans)
    return kin.select("session", *(F.array_join(c, ",").alias(c) for c in ("children", "spawned", "resumed")))


@query("p05_completed_links", "SELECT trace_id, span_id, trace_id AS target_trace, link_span_id AS target_span, link_kind AS kind FROM ev WHERE link_span_id IS NOT NULL")
def p05(spark, sf):
    link = F.struct(F.lit(None).cast("string").alias("trace_id"), F.col("link_span_id").alias("span_id"), F.col("link_kind").alias("kind"))
    found = ev(spark, sf).select("trace_id", "span_id", F.explode(K.completed_links(F.array(link), F.col("trace_id"))).alias("l"))
    return found.select("trace_id", "span_id", F.col("l.trace_id").alias("target_trace"), F.col("l.span_id").alias("target_span"), "l.kind")


@query("p15_stamped_sessions", "WITH n AS (SELECT trace_id, span_id, CASE WHEN kind <> 'TOOL' THEN harness END AS own FROM ev), r AS (SELECT trace_id, min(own) AS a, max(own) AS b FROM n GROUP BY trace_id) SELECT trace_id, span_id, CASE WHEN a <> b THEN own ELSE coalesce(own, a, 'unassigned') END AS session_id FROM n JOIN r USING (trace_id)")
def p15(spark, sf):
    own = F.when(F.col("kind") != "TOOL", F.col("harness")).alias("session_id")
    return K.stamped_sessions(ev(spark, sf).select("trace_id", "span_id", own), F.lit("unassigned")).select("trace_id", "span_id", "session_id")


_RUNS = """
SELECT trace_id, count(*) FILTER (WHERE kind = 'TOOL') AS calls, count(args) FILTER (WHERE kind = 'TOOL') AS captured,
  count(*) FILTER (WHERE kind = 'TOOL' AND status_code = 'ERROR') AS errors, count(*) FILTER (WHERE parent_span_id IS NULL AND status_code = 'ERROR') AS failures,
  count(DISTINCT cwd) AS identities, count(*) FILTER (WHERE link_kind = 'steered_by' AND link_span_id IS NOT NULL) AS steered, count(*) FILTER (WHERE tool = 'Skill') AS skills
FROM {ev} GROUP BY trace_id
"""
_COUNTS = """
SELECT sum(calls) AS tool_calls, sum(captured) AS captured_calls, count(*) AS runs, count(*) FILTER (WHERE identities <> 1) AS missing_sessions,
  count(*) AS groups, count(*) FILTER (WHERE calls > 0) AS measurable_groups, sum(calls) FILTER (WHERE failures = 0) AS quiet_calls,
  sum(errors) FILTER (WHERE failures = 0) AS quiet_errors, count(*) FILTER (WHERE failures > 0) AS failed_runs, sum(steered) AS corrective, sum(skills) AS skill_runs
FROM {runs}
"""


@query(
    "a32_incompleteness",
    f"WITH {_LOOPS}, r AS ({_RUNS.format(ev='ev')}), t AS ({_COUNTS.format(runs='r')}), u AS (SELECT *, (SELECT count(*) FROM loops) AS loops, tool_calls - captured_calls + missing_sessions + groups - measurable_groups AS gaps, least(coalesce(captured_calls / nullif(tool_calls, 0), 1), coalesce((runs - missing_sessions) / nullif(runs, 0), 1)) AS worst FROM t) "
    "SELECT 'instrumentation' AS area, CASE WHEN worst < 0.5 THEN 'high' WHEN worst < 0.9 OR groups > measurable_groups THEN 'medium' ELSE 'low' END AS severity, gaps::BIGINT AS part, (tool_calls + runs + groups)::BIGINT AS whole FROM u WHERE gaps > 0 "
    "UNION ALL SELECT 'repeated-calls', CASE WHEN loops >= 10 THEN 'high' ELSE 'medium' END, loops, runs FROM u WHERE loops > 0 "
    "UNION ALL SELECT 'tool-errors', CASE WHEN quiet_errors >= 0.25 * quiet_calls THEN 'high' ELSE 'medium' END, quiet_errors, quiet_calls FROM u WHERE quiet_errors > 0 "
    "UNION ALL SELECT 'reliability', CASE WHEN failed_runs >= 0.1 * runs THEN 'high' ELSE 'medium' END, failed_runs, runs FROM u WHERE failed_runs > 0 "
    "UNION ALL SELECT 'communication', CASE WHEN corrective >= 10 THEN 'high' ELSE 'medium' END, corrective, runs FROM u WHERE corrective > 0 "
    "UNION ALL SELECT 'workflow', 'low', 0, groups FROM u WHERE groups = measurable_groups AND groups > 0 AND skill_runs = 0",
)
def a32(spark, sf):
    spans = ev(spark, sf)
    runs = spark.sql(_RUNS.format(ev="{ev}"), ev=spans)
    loops = A.stuck_loops(spans, DAY_US).agg(F.count("*").alias("loops"))
    return K.incompleteness(spark.sql(_COUNTS.format(runs="{runs}"), runs=runs).crossJoin(loops))  # one row each
