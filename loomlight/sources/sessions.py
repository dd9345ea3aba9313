"""Session logs of coding assistants as one shape of rows.

trace_id, ord, kind (LLM, TOOL, CHAIN), role, ts_ms, model, input_tokens, output_tokens, tool, call_id,
arguments, output, failed, content. Calls and results are joined by id, or in order of their
name where a log has no ids. Fields that a log doesn't hold are null, never 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import iso_to_epoch_ms
from .codex_exec import codex_exec
from .lines import numbered_lines

FIELDS = {
    "trace_id": "string", "ord": "long", "kind": "string", "role": "string", "ts_ms": "long", "model": "string", "input_tokens": "long", "output_tokens": "long",
    "tool": "string", "call_id": "string", "arguments": "string", "output": "string", "failed": "boolean", "content": "string",
}


def _get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def shaped(rows: DataFrame) -> DataFrame:
    """All FIELDS, null where rows lack them."""
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return numbered_lines(spark, path).select("file", F.col("line").cast("long").alias("ord"), F.try_parse_json("value").alias("v")).filter("v is not null")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    return whole.filter("v is not null")


def _each(rows: DataFrame, path: str, name: str, position: str) -> DataFrame:
    """A row for each element of an array in v."""
    items = F.coalesce(F.try_variant_get("v", path, "array<variant>"), F.array().cast("array<variant>"))
    return rows.select("*", F.posexplode(items).alias(position, name))


def with_results(rows: DataFrame) -> DataFrame:
    """Tool calls with output and failure of their result, which comes before or after; results without a call are kept and marked by role."""
    calls = rows.filter("role is null or role <> 'tool_result'")
    results = rows.filter("role = 'tool_result'").groupBy("trace_id", "call_id").agg(F.first("output", True).alias("r_output"), F.bool_or("failed").alias("r_failed"), F.min("ord").alias("r_ord"))
    joined = calls.join(results, ["trace_id", "call_id"], "full_outer")
    lone = F.col("ord").isNull()
    return shaped(
        joined.withColumn("output", F.coalesce("output", "r_output")).withColumn("failed", F.coalesce("failed", "r_failed"))
        .withColumn("role", F.when(lone, "orphan_result").otherwise(F.col("role"))).withColumn("kind", F.when(lone, "TOOL").otherwise(F.col("kind"))).withColumn("ord", F.coalesce("ord", "r_ord"))
    )


def fifo_results(rows: DataFrame) -> DataFrame:
    """Gives calls and results of a name the same id by order, where a log has no ids."""
    order = Window.partitionBy("trace_id", "tool", F.col("role") == "tool_result").orderBy("ord")
    return rows.withColumn("call_id", F.when(F.col("tool").isNotNull(), F.concat_ws("#", "tool", F.row_number().over(order).cast("string"))))


def claude(spark: SparkSession, path: str) -> DataFrame:
    """Messages with content parts; usage is cumulative while a message streams, so the largest counts, once for each message."""
    rows = _lines(spark, path)
    m = rows.filter(_get("v", "$.type").isin("user", "assistant")).select(
        F.coalesce(_get("v", "$.sessionId"), F.col("file")).alias("trace_id"), "ord", _get("v", "$.type").alias("role"), iso_to_epoch_ms(_get("v", "$.timestamp")).alias("ts_ms"),
        _get("v", "$.message.id").alias("message"), _get("v", "$.message.model").alias("model"), _get("v", "$.message.usage.input_tokens", "bigint").alias("input_tokens"), _get("v", "$.message.usage.output_tokens", "bigint").alias("output_tokens"),
        _get("v", "$.message.content").alias("plain"), F.try_variant_get("v", "$.message.content", "array<variant>").alias("parts"),
    )
    turns = m.withColumn("text", F.coalesce(F.when(F.col("parts").isNull(), F.col("plain")), F.array_join(F.transform(F.filter("parts", lambda p: _get(p, "$.type") == "text"), lambda p: _get(p, "$.text")), "\n")))
    turns = turns.groupBy("trace_id", "role", F.coalesce("message", F.concat(F.lit("line "), F.col("ord").cast("string"))).alias("message")).agg(
        F.min("ord").alias("ord"), F.min("ts_ms").alias("ts_ms"), F.max("model").alias("model"), F.max("input_tokens").alias("input_tokens"), F.max("output_tokens").alias("output_tokens"),
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])), "\n").alias("content"),
    )
    turns = turns.withColumn("kind", F.when(F.col("role") == "assistant", "LLM").otherwise("CHAIN"))
    parts = m.select("trace_id", "ord", "ts_ms", F.explode("parts").alias("p"))
    kind = _get("p", "$.type")
    calls = parts.filter(kind == "tool_use").select("trace_id", "ord", "ts_ms", F.lit("TOOL").alias("kind"), _get("p", "$.id").alias("call_id"), _get("p", "$.name").alias("tool"), F.to_json(F.try_variant_get("p", "$.input", "variant")).alias("arguments"))
    results = parts.filter(kind == "tool_result").select("trace_id", "ord", F.lit("tool_result").alias("role"), _get("p", "$.tool_use_id").alias("call_id"), _get("p", "$.content").alias("output"), F.coalesce(_get("p", "$.is_error", "boolean"), F.lit(False)).alias("failed"))
    return shaped(turns).unionByName(with_results(shaped(calls).unionByName(shaped(results))))


def codex(spark: SparkSession, path: str) -> DataFrame:
    """Response items and token counts; equal consecutive totals are one call, a model known later holds for the rows before."""
    rows = _lines(spark, path)
    kind, sub = _get("v", "$.type"), _get("v", "$.payload.type")
    order = Window.partitionBy("file").orderBy("ord")
    base = rows.withColumn("session", F.first(F.when(kind == "session_meta", _get("v", "$.payload.id")), True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("known", F.when(kind == "turn_context", _get("v", "$.payload.model")))
    base = base.withColumn("model", F.coalesce(F.last("known", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first("known", True).over(order.rowsBetween(0, Window.unboundedFollowing))))
    base = base.select(F.coalesce("session", "file").alias("trace_id"), "ord", iso_to_epoch_ms(_get("v", "$.timestamp")).alias("ts_ms"), "model", kind.alias("k"), sub.alias("s"), "v")
    text = F.array_join(F.transform(F.coalesce(F.try_variant_get("v", "$.payload.content", "array<variant>"), F.array().cast("array<variant>")), lambda p: _get(p, "$.text")), "\n")
    turns = base.filter("k = 'response_item' and s = 'message'").select("trace_id", "ord", "ts_ms", "model", _get("v", "$.payload.role").alias("role"), text.alias("content")).withColumn("kind", F.when(F.col("role") == "assistant", "LLM").otherwise("CHAIN"))
    calls = base.filter("k = 'response_item' and s in ('function_call', 'custom_tool_call')").select("trace_id", "ord", "ts_ms", F.lit("TOOL").alias("kind"), _get("v", "$.payload.call_id").alias("call_id"), _get("v", "$.payload.name").alias("tool"), F.coalesce(_get("v", "$.payload.arguments"), _get("v", "$.payload.input")).alias("arguments"))
    results = base.filter("k = 'response_item' and s in ('function_call_output', 'custom_tool_call_output')").select("trace_id", "ord", F.lit("tool_result").alias("role"), _get("v", "$.payload.call_id").alias("call_id"), _get("v", "$.payload.output").alias("output"))
    usage = base.filter("k = 'event_msg' and s = 'token_count'").withColumn("total", F.to_json(F.try_variant_get("v", "$.payload.info.total_token_usage", "variant")))
    changed = F.coalesce(F.col("total") != F.lag("total").over(Window.partitionBy("trace_id").orderBy("ord")), F.lit(True))
    usage = usage.withColumn("changed", changed).filter("changed").select("trace_id", "ord", "ts_ms", "model", F.lit("LLM").alias("kind"), F.lit("usage").alias("role"), _get("v", "$.payload.info.last_token_usage.input_tokens", "bigint").alias("input_tokens"), _get("v", "$.payload.info.last_token_usage.output_tokens", "bigint").alias("output_tokens"))
    return shaped(turns).unionByName(shaped(usage)).unionByName(with_results(shaped(calls).unionByName(shaped(results))))


def gemini(spark: SparkSession, path: str) -> DataFrame:
    """One document for each chat, with messages and their tool calls inside."""
    rows = _each(_documents(spark, path), "$.messages", "m", "at").select(F.coalesce(_get("v", "$.sessionId"), F.col("file")).alias("trace_id"), (F.col("at") * 1000).cast("long").alias("ord"), "m")
    turns = rows.select("trace_id", "ord", F.when(_get("m", "$.type") == "gemini", "LLM").otherwise("CHAIN").alias("kind"), _get("m", "$.type").alias("role"), iso_to_epoch_ms(_get("m", "$.timestamp")).alias("ts_ms"), _get("m", "$.model").alias("model"), _get("m", "$.tokens.input", "bigint").alias("input_tokens"), _get("m", "$.tokens.output", "bigint").alias("output_tokens"), _get("m", "$.content").alias("content"))
    calls = _each(rows.withColumnRenamed("m", "v"), "$.toolCalls", "c", "i")
    calls = calls.select("trace_id", (F.col("ord") + F.col("i") + 1).alias("ord"), F.lit("TOOL").alias("kind"), iso_to_epoch_ms(_get("v", "$.timestamp")).alias("ts_ms"), _get("c", "$.id").alias("call_id"), _get("c", "$.name").alias("tool"), F.to_json(F.try_variant_get("c", "$.args", "variant")).alias("arguments"), F.to_json(F.try_variant_get("c", "$.result", "variant")).alias("output"), (_get("c", "$.status") == "error").alias("failed"))
    return shaped(turns).unionByName(shaped(calls))


def qwen(spark: SparkSession, path: str) -> DataFrame:
    """Flat records; results meet calls of their name in order."""
    rows = _lines(spark, path).select(F.coalesce(_get("v", "$.sessionId"), F.col("file")).alias("trace_id"), (F.col("ord") * 1000).alias("ord"), "v")
    parts = _each(rows, "$.message.parts", "p", "i").withColumn("ord", F.col("ord") + F.col("i"))
    ts = iso_to_epoch_ms(_get("v", "$.timestamp"))
    texts = parts.filter(_get("p", "$.text").isNotNull()).select("trace_id", "ord", F.when(_get("v", "$.type") == "assistant", "LLM").otherwise("CHAIN").alias("kind"), _get("v", "$.type").alias("role"), ts.alias("ts_ms"), _get("v", "$.model").alias("model"), _get("v", "$.usageMetadata.promptTokenCount", "bigint").alias("input_tokens"), _get("v", "$.usageMetadata.candidatesTokenCount", "bigint").alias("output_tokens"), _get("p", "$.text").alias("content"))
    calls = parts.filter(_get("p", "$.functionCall.name").isNotNull()).select("trace_id", "ord", F.lit("TOOL").alias("kind"), ts.alias("ts_ms"), _get("p", "$.functionCall.name").alias("tool"), F.to_json(F.try_variant_get("p", "$.functionCall.args", "variant")).alias("arguments"))
    results = parts.filter(_get("p", "$.functionResponse.name").isNotNull()).select("trace_id", "ord", F.lit("tool_result").alias("role"), _get("p", "$.functionResponse.name").alias("tool"), F.to_json(F.try_variant_get("p", "$.functionResponse.response", "variant")).alias("output"), (_get("v", "$.toolCallResult.status") == "error").alias("failed"))
    return shaped(texts).unionByName(with_results(fifo_results(shaped(calls).unionByName(shaped(results)))))


def _content_log(spark: SparkSession, path: str, message: str = "message") -> DataFrame:
    """Logs of lines with a message of role and content parts (text, call, result)."""
    rows = _lines(spark, path)
    order = Window.partitionBy("file").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = F.when(_get("v", "$.type").isin("session", "session_start"), _get("v", "$.id"))
    rows = rows.withColumn("trace_id", F.coalesce(F.max(start).over(order), F.col("file"))).filter(_get("v", "$.type") == message)
    return rows.withColumn("ts_ms", iso_to_epoch_ms(_get("v", "$.timestamp"))).withColumn("ord", F.col("ord") * 1000)


def factory(spark: SparkSession, path: str, settings: str | None = None) -> DataFrame:
    """Messages with parts; the model and the session's totals stand in a settings file beside it."""
    rows = _content_log(spark, path)
    parts = _each(rows, "$.message.content", "p", "i").withColumn("ord", F.col("ord") + F.col("i"))
    role, kind = _get("v", "$.message.role"), _get("p", "$.type")
    texts = parts.filter(kind == "text").select("trace_id", "file", "ord", "ts_ms", F.when(role == "assistant", "LLM").otherwise("CHAIN").alias("kind"), role.alias("role"), _get("p", "$.text").alias("content"))
    calls = parts.filter(kind == "tool_use").select("trace_id", "ord", "ts_ms", F.lit("TOOL").alias("kind"), _get("p", "$.id").alias("call_id"), _get("p", "$.name").alias("tool"), F.to_json(F.try_variant_get("p", "$.input", "variant")).alias("arguments"))
    results = parts.filter(kind == "tool_result").select("trace_id", "ord", F.lit("tool_result").alias("role"), _get("p", "$.tool_use_id").alias("call_id"), _get("p", "$.content").alias("output"), _get("p", "$.is_error", "boolean").alias("failed"))
    if settings:
        side = _documents(spark, settings).select(F.regexp_replace("file", "\\.settings\\.json$", "").alias("stem"), _get("v", "$.model").alias("model"))
        texts = texts.withColumn("stem", F.regexp_replace("file", "\\.jsonl$", "")).join(side, "stem", "left")
    return shaped(texts).unionByName(with_results(shaped(calls).unionByName(shaped(results))))


def pi(spark: SparkSession, path: str) -> DataFrame:
    """Messages with parts; a tool result is a message of its own and may come before its call."""
    rows = _content_log(spark, path)
    role = _get("v", "$.message.role")
    parts = _each(rows, "$.message.content", "p", "i")
    text = parts.filter((_get("p", "$.type") == "text") & (role != "toolResult")).groupBy("trace_id", "ord", "ts_ms", role.alias("role"), _get("v", "$.message.model").alias("model"), _get("v", "$.message.usage.input", "bigint").alias("input_tokens"), _get("v", "$.message.usage.output", "bigint").alias("output_tokens")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", _get("p", "$.text").alias("t")))), lambda x: x["t"]), "\n").alias("content")).withColumn("kind", F.when(F.col("role") == "assistant", "LLM").otherwise("CHAIN"))
    calls = parts.filter(_get("p", "$.type") == "toolCall").select("trace_id", (F.col("ord") + F.col("i")).alias("ord"), "ts_ms", F.lit("TOOL").alias("kind"), _get("p", "$.id").alias("call_id"), _get("p", "$.name").alias("tool"), F.to_json(F.try_variant_get("p", "$.arguments", "variant")).alias("arguments"))
    results = rows.filter(role == "toolResult").select("trace_id", "ord", F.lit("tool_result").alias("role"), _get("v", "$.message.toolCallId").alias("call_id"), F.to_json(F.try_variant_get("v", "$.message.content", "variant")).alias("output"), _get("v", "$.message.isError", "boolean").alias("failed"))
    return shaped(text).unionByName(with_results(shaped(calls).unionByName(shaped(results))))


def amp(spark: SparkSession, path: str) -> DataFrame:
    """One document for each thread."""
    rows = _each(_documents(spark, path), "$.messages", "m", "at").select(F.coalesce(_get("v", "$.id"), F.col("file")).alias("trace_id"), (F.col("at") * 1000).cast("long").alias("ord"), F.col("m").alias("v"))
    parts = _each(rows, "$.content", "p", "i").withColumn("ord", F.col("ord") + F.col("i"))
    role, kind = _get("v", "$.role"), _get("p", "$.type")
    texts = parts.filter(kind == "text").select("trace_id", "ord", F.when(role == "assistant", "LLM").otherwise("CHAIN").alias("kind"), role.alias("role"), _get("v", "$.usage.model").alias("model"), _get("v", "$.usage.inputTokens", "bigint").alias("input_tokens"), _get("v", "$.usage.outputTokens", "bigint").alias("output_tokens"), _get("p", "$.text").alias("content"))
    calls = parts.filter(kind == "tool_use").select("trace_id", "ord", F.lit("TOOL").alias("kind"), _get("p", "$.id").alias("call_id"), _get("p", "$.name").alias("tool"), F.to_json(F.try_variant_get("p", "$.input", "variant")).alias("arguments"))
    results = parts.filter(kind == "tool_result").select("trace_id", "ord", F.lit("tool_result").alias("role"), _get("p", "$.toolUseID").alias("call_id"), F.to_json(F.try_variant_get("p", "$.run", "variant")).alias("output"))
    return shaped(texts).unionByName(with_results(shaped(calls).unionByName(shaped(results))))


def copilot(spark: SparkSession, path: str) -> DataFrame:
    """Events; a usage event holds for the next message."""
    rows = _lines(spark, path).select(F.col("file").alias("trace_id"), "ord", _get("v", "$.type").alias("t"), iso_to_epoch_ms(_get("v", "$.timestamp")).alias("ts_ms"), "v")
    order = Window.partitionBy("trace_id").orderBy("ord")
    group = F.sum((F.col("t") == "assistant.message").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("g", F.coalesce(group, F.lit(0)))
    own = Window.partitionBy("trace_id", "g").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda p: F.last(F.when(F.col("t") == "assistant.usage", _get("v", p, "bigint")), True).over(own)
    turns = marked.withColumn("input_tokens", last("$.data.inputTokens")).withColumn("output_tokens", last("$.data.outputTokens")).filter("t in ('assistant.message', 'user.message')").select("trace_id", "ord", "ts_ms", F.when(F.col("t") == "assistant.message", "LLM").otherwise("CHAIN").alias("kind"), F.col("t").alias("role"), "input_tokens", "output_tokens", _get("v", "$.data.content").alias("content"))
    calls = rows.filter("t = 'tool.execution_start'").select("trace_id", "ord", "ts_ms", F.lit("TOOL").alias("kind"), _get("v", "$.data.toolCallId").alias("call_id"), _get("v", "$.data.toolName").alias("tool"), F.to_json(F.try_variant_get("v", "$.data.arguments", "variant")).alias("arguments"))
    results = rows.filter("t = 'tool.execution_complete'").select("trace_id", "ord", F.lit("tool_result").alias("role"), _get("v", "$.data.toolCallId").alias("call_id"), F.to_json(F.try_variant_get("v", "$.data.result", "variant")).alias("output"), (~F.coalesce(_get("v", "$.data.success", "boolean"), F.lit(True))).alias("failed"))
    return shaped(turns).unionByName(with_results(shaped(calls).unionByName(shaped(results))))


def forge(spark: SparkSession, path: str) -> DataFrame:
    """A dump of one conversation."""
    rows = _each(_documents(spark, path), "$.context.messages", "m", "at").select(F.coalesce(_get("v", "$.context.conversation_id"), F.col("file")).alias("trace_id"), (F.col("at") * 1000).cast("long").alias("ord"), F.col("m").alias("v"))
    role = F.lower(_get("v", "$.message.text.role"))
    texts = rows.filter(role.isNotNull()).select("trace_id", "ord", F.when(role == "assistant", "LLM").otherwise("CHAIN").alias("kind"), role.alias("role"), _get("v", "$.message.text.model").alias("model"), _get("v", "$.usage.prompt_tokens", "bigint").alias("input_tokens"), _get("v", "$.usage.completion_tokens", "bigint").alias("output_tokens"), _get("v", "$.message.text.content").alias("content"))
    calls = _each(rows, "$.message.text.tool_calls", "c", "i").select("trace_id", (F.col("ord") + F.col("i") + 1).alias("ord"), F.lit("TOOL").alias("kind"), _get("c", "$.call_id").alias("call_id"), _get("c", "$.name").alias("tool"), F.to_json(F.try_variant_get("c", "$.arguments", "variant")).alias("arguments"))
    results = rows.filter(_get("v", "$.message.tool.call_id").isNotNull()).select("trace_id", "ord", F.lit("tool_result").alias("role"), _get("v", "$.message.tool.call_id").alias("call_id"), F.to_json(F.try_variant_get("v", "$.message.tool.output", "variant")).alias("output"), _get("v", "$.message.tool.output.is_error", "boolean").alias("failed"))
    return shaped(texts).unionByName(with_results(shaped(calls).unionByName(shaped(results))))


def opencode(spark: SparkSession, messages: str, parts: str) -> DataFrame:
    """Two stores, messages and their parts, joined by message id."""
    m = _documents(spark, messages).select(_get("v", "$.id").alias("message"), _get("v", "$.sessionID").alias("trace_id"), _get("v", "$.role").alias("role"), _get("v", "$.modelID").alias("model"), _get("v", "$.time.created", "bigint").alias("ts_ms"), _get("v", "$.tokens.input", "bigint").alias("input_tokens"), _get("v", "$.tokens.output", "bigint").alias("output_tokens"))
    p = _documents(spark, parts).select(_get("v", "$.messageID").alias("message"), _get("v", "$.id").alias("part"), _get("v", "$.type").alias("type"), "v")
    joined = m.join(p, "message", "left")
    joined = joined.withColumn("ord", F.row_number().over(Window.partitionBy("trace_id").orderBy("ts_ms", "message", "part")).cast("long"))
    texts = joined.filter("type is null or type = 'text'").withColumn("content", _get("v", "$.text")).withColumn("kind", F.when(F.col("role") == "assistant", "LLM").otherwise("CHAIN"))
    tools = joined.filter("type = 'tool'").select("trace_id", "ord", "ts_ms", F.lit("TOOL").alias("kind"), _get("v", "$.callID").alias("call_id"), _get("v", "$.tool").alias("tool"), F.to_json(F.try_variant_get("v", "$.state.input", "variant")).alias("arguments"), _get("v", "$.state.output").alias("output"), (_get("v", "$.state.status") == "error").alias("failed"))
    return shaped(texts).unionByName(shaped(tools))


#: Readers by the name of the assistant; register() adds to them.
ADAPTERS: dict[str, Callable[..., DataFrame]] = {"claude-code": claude, "codex": codex, "opencode": opencode, "gemini": gemini, "qwen": qwen, "factory": factory, "pi": pi, "amp": amp, "github-copilot": copilot, "forge": forge, "codex-exec": codex_exec}
ALIASES = {"codex-json": "codex-exec", "claude": "claude-code", "copilot": "github-copilot"}


def register(name: str, reader: Callable[..., DataFrame]) -> None:
    ADAPTERS[name] = reader


def adapter(name: str) -> Callable[..., DataFrame]:
    """The reader of a name or alias; an unknown one raises."""
    found = ADAPTERS.get(ALIASES.get(name, name))
    if found is None:
        raise KeyError(f"no adapter {name!r}; there are {', '.join(sorted(ADAPTERS))}")
    return found
