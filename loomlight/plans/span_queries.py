"""Aggregates, windows and sorts over the event, chat and order spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classifiers as C
from ..operators import aggregates as A
from ..operators import windows as W
from .projection import load
from .registry import query

#: Gap of repeated calls on the driver's events, which are hours apart (the library's default is 60 s).
DAY_US = 86_400_000_000

_TOOL_USE = """tu AS (SELECT trace_id, tool, count(*) AS calls, count(args) AS captured, count(args) - count(DISTINCT args) AS duplicates,
 count(*) FILTER (status_code = 'ERROR') AS errors, count(*) FILTER (status_code = 'ERROR' AND later) AS retried, round(sum((end_us - start_us) / 1000), 3) AS latency_sum_ms
 FROM (SELECT *, lead(1) OVER (PARTITION BY trace_id, tool ORDER BY start_us, ord) IS NOT NULL AS later FROM ev WHERE kind = 'TOOL') GROUP BY trace_id, tool)"""
_LOOPS = f"""marked AS (SELECT *, CASE WHEN start_us - lag(start_us) OVER w <= {DAY_US} THEN 0 ELSE 1 END AS starts FROM ev WHERE kind = 'TOOL' AND args IS NOT NULL AND NOT expected_blocking WINDOW w AS (PARTITION BY trace_id, tool, args ORDER BY start_us, ord)),
islands AS (SELECT *, sum(starts) OVER (PARTITION BY trace_id, tool, args ORDER BY start_us, ord) AS island FROM marked),
loops AS (SELECT trace_id, tool, args, count(*) AS occurrences, min(start_us) AS first_us, max(start_us) - min(start_us) AS window_us FROM islands GROUP BY trace_id, tool, args, island HAVING count(*) >= 3)"""
_RECORDS = """rec AS (SELECT trace_id, count(*) AS spans, count(*) FILTER (kind = 'LLM') AS turns, count(*) FILTER (kind = 'TOOL') AS tool_calls, count(*) FILTER (kind = 'TOOL' AND status_code = 'ERROR') AS tool_errors,
 sum(input_tokens) FILTER (kind = 'LLM')::BIGINT AS input_tokens, sum(output_tokens) FILTER (kind = 'LLM')::BIGINT AS output_tokens, count(*) FILTER (kind = 'LLM' AND cost_usd IS NOT NULL) AS usd_known, count(*) FILTER (kind = 'LLM' AND cost_usd IS NULL) AS usd_unknown,
 round(sum(cost_usd) FILTER (kind = 'LLM'), 6) AS usd, coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '') AS models, min(start_us) AS first_us, max(greatest(start_us, end_us)) AS last_us FROM ev GROUP BY trace_id)"""


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "ev")


@query("tool_health", f"WITH {_TOOL_USE}, {_LOOPS}, l AS (SELECT trace_id, count(*) AS loops, sum(occurrences)::BIGINT AS repeated FROM loops GROUP BY trace_id) SELECT trace_id, sum(calls)::BIGINT AS calls, sum(errors)::BIGINT AS errors, sum(retried)::BIGINT AS retried, round(sum(errors) / sum(calls), 9) AS error_rate, coalesce(any_value(loops), 0) AS loops, coalesce(any_value(repeated), 0) AS repeated FROM tu LEFT JOIN l USING (trace_id) GROUP BY trace_id")
def tool_health(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, errors, retries and repeated calls of each trace: the flagship query."""
    spans = ev(spark, sf)
    per = A.tool_use(spans).groupBy("trace_id").agg(*(F.sum(c).alias(c) for c in ("calls", "errors", "retried")))
    loops = A.stuck_loops(spans, DAY_US).groupBy("trace_id").agg(F.count("*").alias("loops"), F.sum("occurrences").alias("repeated"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return per.join(loops, "trace_id", "left").select("trace_id", "calls", "errors", "retried", F.round(F.col("errors") / F.col("calls"), 9).alias("error_rate"), zero("loops"), zero("repeated"))


@query("a01_tool_counts", "SELECT tool, count(*) AS calls, count(*) FILTER (status_code = 'ERROR') AS errors FROM ev WHERE kind = 'TOOL' GROUP BY tool")
def a01(spark, sf):
    return A.tool_counts(ev(spark, sf))


@query("a02_session_records", f"WITH {_RECORDS} SELECT *, round(tool_errors / nullif(tool_calls, 0), 9) AS error_rate FROM rec")
def a02(spark, sf):
    return A.session_records(ev(spark, sf))


@query("a03_time_bounds", "SELECT trace_id, least(min(start_us), min(end_us)) AS first_us, greatest(max(start_us), max(end_us)) AS last_us FROM ord GROUP BY trace_id")
def a03(spark, sf):
    return A.time_bounds(load(spark, sf, "ord"))


@query("a04_first_known", "SELECT trace_id, arg_min(model, ord) FILTER (model IS NOT NULL) AS model, arg_min(loop_id, ord) FILTER (loop_id IS NOT NULL) AS loop_id, arg_min(cwd, ord) FILTER (cwd IS NOT NULL) AS cwd FROM ev GROUP BY trace_id")
def a04(spark, sf):
    return A.first_known(ev(spark, sf), ["model", "loop_id", "cwd"])


@query("a05_corpus_totals", f"WITH {_RECORDS} SELECT count(*) AS sessions, sum(spans)::BIGINT AS spans, sum(tool_calls)::BIGINT AS tool_calls, sum(tool_errors)::BIGINT AS tool_errors, sum(input_tokens)::BIGINT AS input_tokens, sum(usd_unknown)::BIGINT AS usd_unknown, count(*) FILTER (tool_errors > 0) AS sessions_with_errors, min(first_us) AS first_us, max(last_us) AS last_us FROM rec")
def a05(spark, sf):
    return A.corpus_totals(A.session_records(ev(spark, sf)))


@query("a06_tool_use", f"WITH {_TOOL_USE} SELECT * FROM tu")
def a06(spark, sf):
    return A.tool_use(ev(spark, sf))


@query("a06_run_metrics", f"WITH {_TOOL_USE} SELECT trace_id, sum(calls)::BIGINT AS calls, sum(captured)::BIGINT AS captured, round(sum(duplicates) / sum(calls), 9) AS duplicate_rate, round(sum(retried) / nullif(sum(errors), 0), 9) AS retry_rate, round(sum(errors) / sum(calls), 9) AS error_rate FROM tu GROUP BY trace_id")
def a06b(spark, sf):
    return A.run_metrics(A.tool_use(ev(spark, sf)))


@query("a07_weighted_latency", f"WITH {_TOOL_USE} SELECT tool, round(sum(latency_sum_ms) / sum(calls), 4) AS mean_latency_ms, sum(calls)::BIGINT AS calls FROM tu GROUP BY tool")
def a07(spark, sf):
    return A.weighted_latency(A.tool_use(ev(spark, sf)))


@query("a08_w01_stuck_loops", f"WITH {_LOOPS} SELECT * FROM loops")
def a08(spark, sf):
    return A.stuck_loops(ev(spark, sf), DAY_US)


@query("a09_affected_ratio", f"WITH {_LOOPS} SELECT (SELECT count(DISTINCT trace_id) FROM loops) AS affected, (SELECT count(*) FROM loops) AS loops, count(DISTINCT trace_id) AS runs, round((SELECT count(DISTINCT trace_id) FROM loops) / count(DISTINCT trace_id), 9) AS affected_ratio FROM ev")
def a09(spark, sf):
    spans = ev(spark, sf)
    return A.affected_ratio(A.stuck_loops(spans, DAY_US), spans)


@query("a10_failure_clusters", "SELECT 'unknown' AS failure_class, status_message, count(DISTINCT trace_id) AS runs, arg_min(trace_id, struct_pack(a := start_us, b := trace_id)) AS example_run FROM ev WHERE parent_span_id IS NULL AND status_code = 'ERROR' GROUP BY status_message")
def a10(spark, sf):
    return A.failure_clusters(ev(spark, sf))


@query("a11_run_envelopes", "SELECT trace_id, min(start_us) AS start_us, max(end_us) AS end_us, bool_or(parent_span_id IS NULL AND status_code = 'ERROR') AS failed FROM ord GROUP BY trace_id")
def a11(spark, sf):
    return A.run_envelopes(load(spark, sf, "ord"))


@query("a12_distributions", "WITH m AS (SELECT 'duration_ms' AS measure, (end_us - start_us) / 1000 AS x FROM ev UNION ALL SELECT 'input_tokens', input_tokens FROM ev UNION ALL SELECT 'output_tokens', output_tokens FROM ev UNION ALL SELECT 'cost_usd', cost_usd FROM ev) SELECT measure, count(x) AS n, min(x)::DOUBLE AS min, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95, max(x)::DOUBLE AS max FROM m WHERE x IS NOT NULL GROUP BY measure")
def a12(spark, sf):
    return A.distributions(ev(spark, sf), {"duration_ms": A.duration_ms(), "input_tokens": F.col("input_tokens"), "output_tokens": F.col("output_tokens"), "cost_usd": F.col("cost_usd")})


@query("a13_token_totals", "SELECT trace_id, sum(input_tokens) FILTER (kind = 'LLM')::BIGINT AS direct_input, sum(output_tokens) FILTER (kind = 'LLM')::BIGINT AS direct_output, sum(input_tokens) FILTER (kind = 'AGENT')::BIGINT AS aggregate_input, sum(output_tokens) FILTER (kind = 'AGENT')::BIGINT AS aggregate_output FROM ev GROUP BY trace_id")
def a13(spark, sf):
    return A.token_totals(ev(spark, sf))


@query("a14_cost_provenance", "SELECT count(*) FILTER (cost_usd IS NOT NULL) AS observed, count(*) FILTER (cost_usd IS NULL AND input_tokens IS NOT NULL) AS estimated, count(*) FILTER (cost_usd IS NULL AND input_tokens IS NULL) AS uncaptured, count(*) AS records, round(count(cost_usd) / count(*), 9) AS known_fraction FROM ev WHERE kind = 'LLM'")
def a14(spark, sf):
    return A.cost_provenance(ev(spark, sf))


@query("a15_terminal_outcomes", "SELECT status_code, count(*) AS runs FROM ord WHERE parent_span_id IS NULL GROUP BY status_code")
def a15(spark, sf):
    return A.terminal_outcomes(load(spark, sf, "ord"))


@query("a16_models_by_runs", "SELECT concat(coalesce(model, 'unknown'), '@otlp') AS model, count(DISTINCT trace_id) AS runs, count(*) AS calls FROM ev WHERE kind = 'LLM' GROUP BY 1")
def a16(spark, sf):
    return A.models_by_runs(ev(spark, sf))


_TRENDS = """r AS (SELECT *, coalesce(loop_id, concat('(unnamed loop in ', trace_id, ')')) AS loop, CASE outcome WHEN 'error' THEN 0.0 WHEN 'fail' THEN 1.0 WHEN 'pass' THEN 2.0 END::DOUBLE AS rank FROM ev WHERE loop_id IS NOT NULL OR iteration IS NOT NULL),
g AS (SELECT trace_id, loop, count(*) AS rounds, count(score) AS ns, count(rank) AS nr, arg_min(score, struct_pack(a := iteration, b := start_us, c := ord)) FILTER (score IS NOT NULL) AS fs, arg_max(score, struct_pack(a := iteration, b := start_us, c := ord)) FILTER (score IS NOT NULL) AS ls, max(score) AS ms, min(score) AS mns,
 arg_min(rank, struct_pack(a := iteration, b := start_us, c := ord)) FILTER (rank IS NOT NULL) AS fr, arg_max(rank, struct_pack(a := iteration, b := start_us, c := ord)) FILTER (rank IS NOT NULL) AS lr, max(rank) AS mr, min(rank) AS mnr FROM r GROUP BY trace_id, loop)"""


@query(
    "a17_w02_loop_trends",
    f"WITH {_TRENDS} SELECT trace_id, loop, rounds, CASE WHEN ns >= 2 THEN CASE WHEN ls > fs THEN 'improved' WHEN ls < fs THEN 'regressed' WHEN ms > fs OR mns < fs THEN 'mixed' ELSE 'plateaued' END WHEN nr >= 2 THEN CASE WHEN lr > fr THEN 'improved' WHEN lr < fr THEN 'regressed' WHEN mr > fr OR mnr < fr THEN 'mixed' ELSE 'plateaued' END ELSE 'unscored' END AS trend, CASE WHEN ns >= 2 THEN 'score' WHEN nr >= 2 THEN 'outcome' ELSE 'none' END AS basis, fs AS first_score, ls AS last_score, ms AS best_score FROM g",
)
def a17(spark, sf):
    return W.trends(ev(spark, sf))


@query("a19_span_structure", "SELECT sum(n)::BIGINT AS spans, sum(roots)::BIGINT AS rootless, sum(greatest(roots - 1, 0))::BIGINT AS extra_roots, count(*) FILTER (roots = 0) AS runs_without_root, (SELECT count(*) FROM ev a WHERE parent_span_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.span_id = a.parent_span_id)) AS orphans FROM (SELECT trace_id, count(*) AS n, count(*) FILTER (parent_span_id IS NULL) AS roots FROM ev GROUP BY trace_id)")
def a19(spark, sf):
    return A.span_structure(ev(spark, sf))


@query("a23_action_counts", "SELECT trace_id, count(*) FILTER (action = 'verify') AS verify, count(*) FILTER (action = 'edit') AS edit, count(*) FILTER (action = 'read') AS read, count(*) FILTER (action = 'tool') AS tool, count(*) FILTER (action = 'claim') AS claim, count(*) FILTER (action = 'other') AS other FROM act GROUP BY trace_id")
def a23(spark, sf):
    return A.action_counts(load(spark, sf, "act"))


@query("a24_identities", "SELECT trace_id, CASE WHEN count(DISTINCT cwd) = 1 THEN min(cwd) END AS session, count(DISTINCT cwd) > 1 AS conflict FROM ev GROUP BY trace_id")
def a24(spark, sf):
    return A.identities(ev(spark, sf))


@query("a25_spend", "SELECT model, count(*) AS records, sum(tokens)::BIGINT AS tokens, round(sum(cost_usd), 2) AS usd, count(cost_usd) AS usd_known, count(*) - count(cost_usd) AS usd_unknown FROM ord WHERE parent_span_id IS NOT NULL GROUP BY model")
def a25(spark, sf):
    return A.spend(load(spark, sf, "ord").filter("parent_span_id is not null"), "model")


@query("a35_top_loop_tools", f"WITH {_LOOPS}, t AS (SELECT trace_id, tool, sum(occurrences)::BIGINT AS occurrences FROM loops GROUP BY trace_id, tool) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY occurrences DESC, tool) AS rank FROM t) WHERE rank <= 3")
def a35(spark, sf):
    return A.top_loop_tools(A.stuck_loops(ev(spark, sf), DAY_US))


@query("a30_trace_stats", "SELECT harness, count(*) AS spans, count(DISTINCT trace_id) AS runs, count(DISTINCT span_id) AS ids FROM ev GROUP BY harness")
def a30(spark, sf):
    return ev(spark, sf).groupBy("harness").agg(F.count("*").alias("spans"), F.countDistinct("trace_id").alias("runs"), F.countDistinct("span_id").alias("ids"))


_FRESH = """f AS (SELECT *, name = 'user.prompt' AND actor = 'human' AS human, (kind = 'LLM' OR name LIKE 'message.assistant%') AND name <> 'user.prompt' AND trim(content) <> '' AS fresh FROM chat),
p AS (SELECT *, max(CASE WHEN fresh THEN step END) OVER w AS last_assistant, max(CASE WHEN human THEN step END) OVER w AS last_human FROM f WINDOW w AS (PARTITION BY trace_id ORDER BY step, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
re AS (SELECT * FROM p WHERE human AND last_assistant IS NOT NULL AND (last_human IS NULL OR last_assistant > last_human))"""


@query("w03_j07_reaction_turns", f"WITH {_FRESH} SELECT trace_id, step, last_assistant FROM re")
def w03(spark, sf):
    return W.reactions(load(spark, sf, "chat")).select("trace_id", "step", "last_assistant")


def _reacted(label: str) -> str:
    return "regexp_matches(lower(content), '" + C.REACTIONS[label].replace("'", "''") + "')"


_SIGNALS = ", ".join(f"count(*) FILTER ({_reacted(n)}) AS {n}" for n in C.REACTIONS)


@query("a20_reaction_counts", f"WITH {_FRESH} SELECT trace_id, count(*) AS turns, {_SIGNALS} FROM re GROUP BY trace_id")
def a20(spark, sf):
    text = F.lower("content")
    return W.reactions(load(spark, sf, "chat")).groupBy("trace_id").agg(F.count("*").alias("turns"), *(F.count_if(C.matches(text, p)).alias(n) for n, p in C.REACTIONS.items()))


@query("o02_trigger_pairs", f"WITH {_FRESH}, s AS (SELECT trace_id, step, 2 * {_reacted('correction')}::INT + {_reacted('praise')}::INT AS strength FROM re) SELECT * FROM s ORDER BY strength DESC, trace_id, step LIMIT 10")
def o02(spark, sf):
    text = F.lower("content")
    strength = 2 * C.matches(text, C.REACTIONS["correction"]).cast("int") + C.matches(text, C.REACTIONS["praise"]).cast("int")
    return W.reactions(load(spark, sf, "chat")).select("trace_id", "step", strength.alias("strength")).orderBy(F.desc("strength"), "trace_id", "step").limit(10)


_ACTS = "edits AS (SELECT *, sum(CASE WHEN action = 'edit' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY start_us, ord) AS e FROM act), vse AS (SELECT trace_id, count(*) FILTER (action = 'verify') AS verifications FROM (SELECT *, max(e) OVER (PARTITION BY trace_id) AS l FROM edits) WHERE e = l GROUP BY trace_id HAVING count(*) FILTER (action = 'verify') >= 2)"


@query("w04_verifications_since_edit", f"WITH {_ACTS} SELECT *, CASE WHEN verifications >= 3 THEN 'high' ELSE 'medium' END AS severity FROM vse")
def w04(spark, sf):
    return W.verifications_since_edit(load(spark, sf, "act"))


_CLAIMS = "cl AS (SELECT trace_id, max(struct_pack(a := start_us, b := ord)) FILTER (action = 'claim') AS c, max(start_us) FILTER (action = 'verify') AS v FROM act GROUP BY trace_id), unv AS (SELECT trace_id, c.b AS ord FROM cl WHERE c IS NOT NULL AND (v IS NULL OR v <= c.a))"


@query("j08_unverified_claims", f"WITH {_CLAIMS} SELECT * FROM unv")
def j08(spark, sf):
    from ..operators.joins import unverified_claims

    return unverified_claims(load(spark, sf, "act"))


@query(
    "t09_t08_live_rules",
    f"WITH {_ACTS}, {_CLAIMS}, rate AS (SELECT trace_id, count(*) AS tools, count(*) FILTER (status_code = 'ERROR') / count(*) AS n FROM act WHERE is_tool GROUP BY trace_id) SELECT trace_id, 'same-failing-command' AS rule, CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS severity, count(*)::DOUBLE AS n FROM act WHERE is_tool AND status_code = 'ERROR' GROUP BY trace_id, tool, content HAVING count(*) >= 2 UNION ALL SELECT trace_id, 'verification-without-change', CASE WHEN verifications >= 3 THEN 'high' ELSE 'medium' END, verifications FROM vse UNION ALL SELECT trace_id, 'claim-without-verification', 'medium', 1 FROM unv UNION ALL SELECT trace_id, 'high-tool-error-rate', CASE WHEN n >= 0.75 THEN 'high' ELSE 'medium' END, round(n, 9) FROM rate WHERE tools >= 4 AND n >= 0.5",
)
def t09(spark, sf):
    from ..operators.findings import live_rules

    return live_rules(load(spark, sf, "act"))


@query("w05_retry_followed", "SELECT tool, count(*) FILTER (status_code = 'ERROR') AS failed, count(*) FILTER (status_code = 'ERROR' AND later) AS followed FROM (SELECT *, lead(1) OVER (PARTITION BY trace_id, tool ORDER BY start_us, ord) IS NOT NULL AS later FROM ev WHERE kind = 'TOOL') GROUP BY tool")
def w05(spark, sf):
    return A.tool_use(ev(spark, sf)).groupBy("tool").agg(F.sum("errors").alias("failed"), F.sum("retried").alias("followed"))


@query("w06_monotone_usage", "WITH s AS (SELECT trace_id, input_tokens > lag(input_tokens) OVER w AS g, output_tokens < lag(output_tokens) OVER w AS d FROM ev WHERE kind = 'LLM' AND input_tokens IS NOT NULL AND output_tokens IS NOT NULL WINDOW w AS (PARTITION BY trace_id ORDER BY start_us, ord)) SELECT trace_id, count(*) AS turns, bool_and(g) AS input_growth, bool_and(d) AS output_decay FROM s GROUP BY trace_id HAVING count(*) >= 3")
def w06(spark, sf):
    return W.monotone_usage(ev(spark, sf).filter("kind = 'LLM'"))


@query("w07_s22_assistant_steps", "SELECT trace_id, step, role, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY step, span_id)::BIGINT AS assistant_step FROM chat")
def w07(spark, sf):
    return W.numbered_steps(load(spark, sf, "chat")).select("trace_id", "step", "role", "assistant_step")


@query("w08_time_order", "SELECT trace_id, count(*) FILTER (b) AS out_of_order FROM (SELECT trace_id, end_us < lag(end_us) OVER (PARTITION BY trace_id ORDER BY ord) AS b FROM ev) GROUP BY trace_id")
def w08(spark, sf):
    return W.time_order(ev(spark, sf))


@query("w09_n06_carried_model", "SELECT trace_id, ord, coalesce(last_value(model IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(model IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS carried FROM ev")
def w09(spark, sf):
    return W.carried(ev(spark, sf), "model").select("trace_id", "ord", "carried")


@query("w10_s13_fifo_pairs", "WITH c AS (SELECT *, row_number() OVER (PARTITION BY trace_id, args ORDER BY ord) AS n FROM ev WHERE name = 'click' AND args IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY trace_id, args ORDER BY ord) AS n FROM ev WHERE name = 'view' AND args IS NOT NULL) SELECT c.trace_id, c.args, c.n, c.span_id AS call_id, r.span_id AS result_id FROM c LEFT JOIN r USING (trace_id, args, n)")
def w10(spark, sf):
    known = ev(spark, sf).filter("args is not null")
    return W.fifo_pairs(known.filter("name = 'click'"), known.filter("name = 'view'"), ["trace_id", "args"])


@query("w11_first_seen", "SELECT trace_id, tool, ord FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, tool ORDER BY ord) AS n FROM ev WHERE tool IS NOT NULL) WHERE n = 1")
def w11(spark, sf):
    return W.first_seen(ev(spark, sf).filter("tool is not null"), ["trace_id", "tool"]).select("trace_id", "tool", "ord")


@query("w12_last_child", "SELECT parent_span_id, max(ord) AS last_child FROM ev WHERE parent_span_id IS NOT NULL GROUP BY parent_span_id")
def w12(spark, sf):
    return ev(spark, sf).filter("parent_span_id is not null").groupBy("parent_span_id").agg(F.max("ord").alias("last_child"))


@query("o01_latest_per_harness", "SELECT harness, span_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY harness ORDER BY start_us DESC, ord DESC) AS rank FROM ev) WHERE rank <= 5")
def o01(spark, sf):
    return W.last_per_group(ev(spark, sf), ["harness"], 5).select("harness", "span_id", "rank")


@query("o04_capped_examples", f"WITH {_LOOPS}, r AS (SELECT *, row_number() OVER (ORDER BY occurrences DESC, trace_id, tool, args, first_us) AS n, count(*) OVER () AS total FROM loops) SELECT trace_id, tool, args, occurrences, greatest(total - 20, 0) AS omitted FROM r WHERE n <= 20")
def o04(spark, sf):
    loops = A.stuck_loops(ev(spark, sf), DAY_US)
    omitted = loops.agg(F.greatest(F.count("*") - 20, F.lit(0)).alias("omitted"))
    top = loops.orderBy(F.desc("occurrences"), "trace_id", "tool", "args", "first_us").limit(20)
    return top.join(omitted, F.lit(True)).select("trace_id", "tool", "args", "occurrences", "omitted")  # one row of totals


@query("n05_model_calls", "WITH s AS (SELECT trace_id, ord, concat_ws('/', coalesce(model, '-'), args) AS g FROM ev), c AS (SELECT trace_id, coalesce(g <> lag(g) OVER (PARTITION BY trace_id ORDER BY ord), TRUE) AS ch FROM s) SELECT trace_id, count(*) FILTER (ch) AS model_calls, count(*) AS rows FROM c GROUP BY trace_id")
def n05(spark, sf):
    return W.model_calls(ev(spark, sf))


@query("n10_latest_task", "WITH t AS (SELECT trace_id, sum(CASE WHEN kind = 'LLM' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY ord) AS task FROM ev), m AS (SELECT *, max(task) OVER (PARTITION BY trace_id) AS l FROM t) SELECT trace_id, max(task)::BIGINT AS task, count(*) AS rows FROM m WHERE task = l GROUP BY trace_id")
def n10(spark, sf):
    return W.latest_task(ev(spark, sf))
