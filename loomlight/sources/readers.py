"""Sources: span files, chat trajectories, session logs; good rows, withheld fields and quarantine kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.classifiers import inferred_kind, status_code
from ..functions.scalars import iso_to_epoch_ms
from ..operators.collection import completed_links
from .lines import numbered_lines, physical_lines, text_of


def _text(v: Column, *paths: str) -> Column:
    return F.coalesce(*(F.try_variant_get(v, p, "string") for p in paths))


def _number(v: Column, kind: str, *paths: str) -> Column:
    return F.coalesce(*(F.try_variant_get(v, p, kind) for p in paths))


# Attribute names by which sources tell the same thing, the first that is there counts.
ALIASES = {
    "model": ['$["gen_ai.request.model"]', '$["gen_ai.response.model"]', '$["llm.model_name"]'],
    "input_tokens": ['$["gen_ai.usage.input_tokens"]', '$["llm.token_count.prompt"]'],
    "output_tokens": ['$["gen_ai.usage.output_tokens"]', '$["llm.token_count.completion"]'],
    "cost_usd": ['$["gen_ai.usage.cost.total"]', '$["llm.cost.total"]'],
    "tool": ['$["gen_ai.tool.name"]', '$["tool.name"]'],
    "loop_id": ['$["agent.loop.id"]'],
    "outcome": ['$["agent.outcome"]'],
    "agent": ['$["agent.name"]', '$["inference.agent_name"]', '$["gen_ai.agent.name"]'],
    "session_id": ['$["session.id"]'],
    # fixed values, in order
    "args": ['$["input.value"]', '$["tool.input"]', "$.tool_input", '$["tool.arguments"]', "$.tool_arguments", "$.arguments", "$.args", "$.full_command"],
    "content": ["$.content", '$["input.value"]', '$["output.value"]'],
}


def _link(x: Column) -> Column:
    return F.struct(_text(x, "$.trace_id").alias("trace_id"), _text(x, "$.span_id").alias("span_id"), _text(x, '$.attributes["agent.link.kind"]').alias("kind"))


def read_spans(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Spans of JSON lines, and the lines that aren't spans with a reason. Foreign rows never fail the read."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rows = numbered_lines(spark, path).withColumn("v", F.try_parse_json("value"))
    span = F.try_variant_get("v", "$.span_id", "string")
    reason = F.when(F.col("v").isNull(), "not JSON").when(F.schema_of_variant("v").startswith("OBJECT") == F.lit(False), "not an object").when(F.coalesce(F.trim(span), F.lit("")) == "", "no span id")
    marked = rows.withColumn("reason", reason)
    quarantine = marked.filter("reason is not null").select("file", "line", "reason", F.sha2("value", 256).alias("sha256"))
    attributes = F.try_variant_get("v", "$.attributes", "variant")
    good = marked.filter("reason is null").withColumn("a", attributes)
    a, v = F.col("a"), F.col("v")
    start, end = (iso_to_epoch_ms(_text(v, p)) for p in ("$.start_time", "$.end_time"))
    declared = _text(a, '$["openinference.span.kind"]')
    tool, model = _text(a, *ALIASES["tool"]), _text(a, *ALIASES["model"])
    name = F.coalesce(_text(v, "$.name"), F.lit(""))
    trace = F.coalesce(_text(v, "$.trace_id"), F.concat(F.lit("file:"), F.sha2("file", 256)))
    spans = good.select(
        trace.alias("trace_id"),
        _text(v, "$.span_id").alias("span_id"),
        F.nullif(F.trim(F.coalesce(_text(v, "$.parent_span_id"), F.lit(""))), F.lit("")).alias("parent_span_id"),
        name.alias("name"),
        start.alias("start_ms"),
        F.when(end >= start, end).alias("end_ms"),
        (end < start).alias("end_withheld"),
        status_code(_text(v, "$.status.code")).alias("status_code"),
        _text(v, "$.status.message").alias("status_message"),
        inferred_kind(F.coalesce(_text(v, "$.kind"), declared), F.coalesce(_text(a, '$["span.type"]'), F.lit("")), name, model, tool).alias("kind"),
        model.alias("model"),
        tool.alias("tool"),
        *(_number(a, "bigint", *ALIASES[c]).alias(c) for c in ("input_tokens", "output_tokens")),
        _number(a, "double", *ALIASES["cost_usd"]).alias("cost_usd"),
        *(_text(a, *ALIASES[c]).alias(c) for c in ("loop_id", "outcome", "agent", "session_id", "content")),
        _number(a, "double", '$["agent.loop.iteration"]').alias("iteration"),
        _number(a, "double", '$["agent.outcome.score"]').alias("score"),
        F.when(F.coalesce(_text(a, '$["tool.args_captured"]'), F.lit("true")) != "false", _text(a, *ALIASES["args"])).alias("args"),
        completed_links(F.transform(F.try_variant_get(v, "$.links", "array<variant>"), _link), trace).alias("links"),
        F.to_json("v").alias("canonical"),
        "file",
        "line",
    )
    return spans, quarantine


def merged(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One span of each identity, and repeats or conflicts with file and line."""
    order = Window.partitionBy("trace_id", "span_id").orderBy("file", "line")
    marked = spans.withColumn("n", F.row_number().over(order)).withColumn("kept", F.first("canonical").over(order))
    issue = F.when(F.col("kept") == F.col("canonical"), "repeat").otherwise("conflicting-span-id")
    return marked.filter("n = 1").drop("n", "kept"), marked.filter("n > 1").select("trace_id", "span_id", issue.alias("issue"), "file", "line")


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """file, is_spans: whether one of the first five lines of a file has a span id and a name."""
    order = Window.partitionBy("file").orderBy("line")
    head = numbered_lines(spark, path).withColumn("n", F.row_number().over(order)).filter("n <= 5").withColumn("v", F.try_parse_json("value"))
    there = lambda p: F.coalesce(F.trim(F.try_variant_get("v", p, "string")) != "", F.lit(False))
    return head.groupBy("file").agg(F.bool_or(there("$.span_id") & there("$.name")).alias("is_spans"))


def chat_spans(messages: DataFrame) -> DataFrame:
    """Trajectories (trajectory_id, messages array) to a root and a span for each message; steps count assistant messages."""
    rows = messages.select("trajectory_id", F.posexplode("messages").alias("ord", "m")).select("trajectory_id", "ord", "m.role", "m.content")
    order = Window.partitionBy("trajectory_id").orderBy("ord")
    children = rows.select(
        F.col("trajectory_id").alias("trace_id"),
        F.concat_ws(":", "trajectory_id", F.col("ord").cast("string")).alias("span_id"),
        F.col("trajectory_id").alias("parent_span_id"),
        F.when(F.col("role") == "assistant", "LLM").otherwise("CHAIN").alias("kind"),
        F.sum((F.col("role") == "assistant").cast("int")).over(order).alias("step"),
        "content",
    )
    roots = messages.select(F.col("trajectory_id").alias("trace_id"), F.col("trajectory_id").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.lit("AGENT").alias("kind"), F.lit(None).cast("long").alias("step"), F.lit(None).cast("string").alias("content"))
    return roots.unionByName(children)


def sandbox_spans(events: DataFrame) -> DataFrame:
    """Sandbox events (run, ord, type, data, ts) to spans; a missing time is that of the event before."""
    order = Window.partitionBy("run").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    timed = events.withColumn("ts", F.last("ts", ignorenulls=True).over(order))
    children = timed.select(F.col("run").alias("trace_id"), F.concat_ws(":", "run", F.col("ord").cast("string")).alias("span_id"), F.col("run").alias("parent_span_id"), F.col("type").alias("name"), "ts", F.when(F.col("type") == "error", "ERROR").otherwise("UNSET").alias("status_code"))
    roots = timed.groupBy("run").agg(F.min("ts").alias("ts"), F.when(F.bool_or(F.col("type") == "error"), "ERROR").otherwise("OK").alias("status_code")).select(F.col("run").alias("trace_id"), F.col("run").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.lit("sandbox").alias("name"), "ts", "status_code")
    return roots.unionByName(children)


def tool_calls_with_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls and results of one id in either order; a result without call is kept and marked."""
    joined = calls.join(results, ["trace_id", "call_id"], "full_outer")
    return joined.withColumn("orphan_result", F.col("tool").isNull())


def journal_events(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a journal; an unterminated last line is dropped, other unreadable lines are counted as invalid."""
    lines = physical_lines(spark, path).filter("terminated").select("file", "line", text_of(F.col("raw")).alias("value")).filter(F.trim("value") != "")
    v = F.try_parse_json("value")
    kind = F.try_variant_get(v, "$.kind", "string")
    return lines.select("file", "line", kind.alias("kind"), F.coalesce(kind.isin("begin", "event"), F.lit(False)).alias("valid"), F.try_variant_get(v, "$.event.kind", "string").alias("event"), F.try_variant_get(v, "$.event.id", "string").alias("id"), F.try_variant_get(v, "$.event.parent", "string").alias("parent"))


def detect_format(rows: DataFrame) -> DataFrame:
    """The format that all rows (or, for sandbox events, one) show, in order of precedence."""
    chat = F.bool_and(F.col("role").isin("user", "assistant", "system"))
    return rows.agg(F.when(chat, "chat").when(F.bool_or(F.col("role") == "raw"), "sandbox").otherwise("unknown").alias("format"), F.count("*").alias("n"))
