"""Aggregates over spans: one partial and one final step each, keyed by trace, tool or run.

Unknown values stay null: a token count or cost that was not captured is never taken as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def is_tool() -> Column:
    return F.col("kind") == "TOOL"


def is_llm() -> Column:
    return F.col("kind") == "LLM"


def is_error() -> Column:
    return F.col("status_code") == "ERROR"


def is_root() -> Column:
    return F.col("parent_span_id").isNull()


def duration_ms() -> Column:
    return (F.col("end_us") - F.col("start_us")) / 1000


def tool_counts(spans: DataFrame) -> DataFrame:
    """Calls and errors of each tool."""
    return spans.filter(is_tool()).groupBy("tool").agg(F.count("*").alias("calls"), F.count_if(is_error()).alias("errors"))


def session_records(spans: DataFrame) -> DataFrame:
    """One wide row for each session: sizes, errors, tokens, cost, time bounds."""
    known = F.col("cost_usd").isNotNull() & is_llm()
    rows = spans.groupBy("trace_id").agg(
        F.count("*").alias("spans"),
        F.count_if(is_llm()).alias("turns"),
        F.count_if(is_tool()).alias("tool_calls"),
        F.count_if(is_tool() & is_error()).alias("tool_errors"),
        F.sum(F.when(is_llm(), F.col("input_tokens"))).alias("input_tokens"),
        F.sum(F.when(is_llm(), F.col("output_tokens"))).alias("output_tokens"),
        F.count_if(known).alias("usd_known"),
        F.count_if(is_llm() & F.col("cost_usd").isNull()).alias("usd_unknown"),
        F.round(F.sum(F.when(is_llm(), F.col("cost_usd"))), 6).alias("usd"),
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
        F.min("start_us").alias("first_us"),
        F.max(F.greatest("start_us", "end_us")).alias("last_us"),
    )
    return rows.withColumn("error_rate", F.round(F.try_divide("tool_errors", "tool_calls"), 9))


def time_bounds(spans: DataFrame) -> DataFrame:
    """First and last instant over starts and ends."""
    return spans.groupBy("trace_id").agg(F.least(F.min("start_us"), F.min("end_us")).alias("first_us"), F.greatest(F.max("start_us"), F.max("end_us")).alias("last_us"))


def first_known(spans: DataFrame, columns: list[str], order: str = "ord") -> DataFrame:
    """The first value that is not null of each column, in row order."""
    return spans.groupBy("trace_id").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def corpus_totals(records: DataFrame) -> DataFrame:
    """Totals of the corpus over session records."""
    return records.agg(
        F.count("*").alias("sessions"),
        F.sum("spans").alias("spans"),
        F.sum("tool_calls").alias("tool_calls"),
        F.sum("tool_errors").alias("tool_errors"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("usd_unknown").alias("usd_unknown"),
        F.count_if(F.col("tool_errors") > 0).alias("sessions_with_errors"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
    )


def tool_use(spans: DataFrame) -> DataFrame:
    """Per run and tool: captured and repeated arguments, errors, errors followed by a later call, latency."""
    later = F.lead(F.lit(1)).over(Window.partitionBy("trace_id", "tool").orderBy("start_us", "ord")).isNotNull()
    calls = spans.filter(is_tool()).withColumn("followed", later)
    rows = calls.groupBy("trace_id", "tool").agg(
        F.count("*").alias("calls"),
        F.count("args").alias("captured"),
        F.countDistinct("args").alias("different"),
        F.count_if(is_error()).alias("errors"),
        F.count_if(is_error() & F.col("followed")).alias("retried"),
        F.round(F.sum(duration_ms()), 3).alias("latency_sum_ms"),
    )
    return rows.select("trace_id", "tool", "calls", "captured", (F.col("captured") - F.col("different")).alias("duplicates"), "errors", "retried", "latency_sum_ms")


def run_metrics(by_tool: DataFrame) -> DataFrame:
    """Rates of each run over its tools."""
    rows = by_tool.groupBy("trace_id").agg(*(F.sum(c).alias(c) for c in ("calls", "captured", "duplicates", "errors", "retried")))
    rate = lambda a, b: F.round(F.try_divide(a, b), 9)
    return rows.select("trace_id", "calls", "captured", rate("duplicates", "calls").alias("duplicate_rate"), rate("retried", "errors").alias("retry_rate"), rate("errors", "calls").alias("error_rate"))


def weighted_latency(by_tool: DataFrame) -> DataFrame:
    """Mean latency of each tool, weighted by calls."""
    return by_tool.groupBy("tool").agg(F.round(F.sum("latency_sum_ms") / F.sum("calls"), 4).alias("mean_latency_ms"), F.sum("calls").alias("calls"))


def stuck_loops(spans: DataFrame, gap_us: int = 60_000_000, least: int = 3) -> DataFrame:
    """Islands of calls of one tool with the same captured arguments, at most gap apart, of at least so many calls.

    Calls that are expected to block are left out, and so are calls without captured arguments.
    """
    calls = spans.filter(is_tool() & F.col("args").isNotNull() & ~F.col("expected_blocking"))
    order = Window.partitionBy("trace_id", "tool", "args").orderBy("start_us", "ord")
    starts = F.coalesce((F.col("start_us") - F.lag("start_us").over(order) > gap_us).cast("int"), F.lit(1))
    marked = calls.withColumn("starts", starts).withColumn("island", F.sum("starts").over(order))
    rows = marked.groupBy("trace_id", "tool", "args", "island").agg(F.count("*").alias("occurrences"), F.min("start_us").alias("first_us"), (F.max("start_us") - F.min("start_us")).alias("window_us"))
    return rows.filter(F.col("occurrences") >= least).drop("island")


def affected_ratio(loops: DataFrame, spans: DataFrame) -> DataFrame:
    """Runs with a loop against all runs."""
    runs = spans.agg(F.countDistinct("trace_id").alias("runs"))
    hit = loops.agg(F.countDistinct("trace_id").alias("affected"), F.count("*").alias("loops"))
    return hit.join(runs, F.lit(True)).select("affected", "loops", "runs", F.round(F.try_divide("affected", "runs"), 9).alias("affected_ratio"))  # one row each


def failure_clusters(spans: DataFrame) -> DataFrame:
    """Failed runs (an error at the root) by class, with the earliest run as example."""
    failed = spans.filter(is_root() & is_error()).withColumn("failure_class", F.lit("unknown"))
    return failed.groupBy("failure_class", "status_message").agg(F.countDistinct("trace_id").alias("runs"), F.min_by("trace_id", F.struct("start_us", "trace_id")).alias("example_run"))


def run_envelopes(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.bool_or(is_root() & is_error()).alias("failed"))


def distributions(spans: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """n, min, mean, p50, p95 and max of each measure; exact percentiles, linear between ranks."""
    measures = F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(c.cast("double") for c in columns.values()))))
    long = spans.select(measures.alias("measure", "x")).filter("x is not null")
    sizes = long.groupBy("measure").agg(F.count("x").alias("n"), F.min("x").alias("min"), F.round(F.avg("x"), 6).alias("mean"), F.max("x").alias("max"))
    middle = quantiles(long, [0.5, 0.95]).groupBy("measure").agg(*(F.round(F.max(F.when(F.col("share") == share, F.col("value"))), 6).alias(name) for name, share in (("p50", 0.5), ("p95", 0.95))))
    return sizes.join(middle, "measure").select("measure", "n", "min", "mean", "p50", "p95", "max")


def token_totals(spans: DataFrame) -> DataFrame:
    """Direct usage (model calls) and aggregate usage (containers), kept apart."""
    agent = F.col("kind") == "AGENT"
    return spans.groupBy("trace_id").agg(
        F.sum(F.when(is_llm(), F.col("input_tokens"))).alias("direct_input"),
        F.sum(F.when(is_llm(), F.col("output_tokens"))).alias("direct_output"),
        F.sum(F.when(agent, F.col("input_tokens"))).alias("aggregate_input"),
        F.sum(F.when(agent, F.col("output_tokens"))).alias("aggregate_output"),
    )


def cost_provenance(spans: DataFrame) -> DataFrame:
    """Observed, estimated (tokens but no cost) and uncaptured costs of model calls."""
    seen, tokens = F.col("cost_usd").isNotNull(), F.col("input_tokens").isNotNull()
    rows = spans.filter(is_llm()).agg(F.count_if(seen).alias("observed"), F.count_if(~seen & tokens).alias("estimated"), F.count_if(~seen & ~tokens).alias("uncaptured"), F.count("*").alias("records"))
    return rows.withColumn("known_fraction", F.round(F.try_divide("observed", "records"), 9))


def terminal_outcomes(spans: DataFrame) -> DataFrame:
    return spans.filter(is_root()).groupBy("status_code").agg(F.count("*").alias("runs"))


def models_by_runs(spans: DataFrame) -> DataFrame:
    name = F.concat(F.coalesce("model", F.lit("unknown")), F.lit("@otlp"))
    return spans.filter(is_llm()).groupBy(name.alias("model")).agg(F.countDistinct("trace_id").alias("runs"), F.count("*").alias("calls"))


def spend(rows: DataFrame, key: str) -> DataFrame:
    """Spend of each key: records, tokens and cost, with how many costs are known and unknown."""
    return rows.groupBy(key).agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost_usd"), 2).alias("usd"), F.count_if(F.col("cost_usd").isNotNull()).alias("usd_known"), F.count_if(F.col("cost_usd").isNull()).alias("usd_unknown"))


def link_kinds(edges: DataFrame) -> DataFrame:
    """Links by kind, with how many point at nothing."""
    return edges.groupBy(F.coalesce("link_kind", F.lit("unspecified")).alias("link_kind")).agg(F.count("*").alias("links"), F.count_if(F.col("cause_id").isNull()).alias("dangling"))


def span_structure(spans: DataFrame) -> DataFrame:
    """Roots, runs without or with more than one root, and spans whose parent is absent."""
    ids = spans.select(F.col("span_id").alias("parent_span_id")).distinct()
    orphans = spans.filter("parent_span_id is not null").join(ids, "parent_span_id", "left_anti").agg(F.count("*").alias("orphans"))
    per = spans.groupBy("trace_id").agg(F.count_if(is_root()).alias("roots"), F.count("*").alias("n"))
    totals = per.agg(F.sum("n").alias("spans"), F.sum("roots").alias("rootless"), F.sum(F.greatest(F.col("roots") - 1, F.lit(0))).alias("extra_roots"), F.count_if(F.col("roots") == 0).alias("runs_without_root"))
    return totals.join(orphans, F.lit(True))  # one row each


def identities(spans: DataFrame) -> DataFrame:
    """The one session id of each trace, or a conflict."""
    rows = spans.groupBy("trace_id").agg(F.countDistinct("cwd").alias("ids"), F.min("cwd").alias("cwd"))
    return rows.select("trace_id", F.when(F.col("ids") == 1, F.col("cwd")).alias("session"), (F.col("ids") > 1).alias("conflict"))


def action_counts(actions: DataFrame) -> DataFrame:
    """Actions of each kind by trace, in columns."""
    return actions.groupBy("trace_id").agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("verify", "edit", "read", "tool", "claim", "other")))


def top_loop_tools(loops: DataFrame, n: int = 3) -> DataFrame:
    """The tools with the most repeated calls of each run."""
    rows = loops.groupBy("trace_id", "tool").agg(F.sum("occurrences").alias("occurrences"))
    best = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("occurrences"), "tool"))
    return rows.withColumn("rank", best.cast("long")).filter(F.col("rank") <= n)
