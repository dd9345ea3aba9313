"""Rows of other programs: which of six formats a file holds, and spans of two of them.

A file has a format if all its rows show it, in the order listed; events of sandboxes count if one row does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classifiers import inferred_kind, status_code
from ..functions.scalars import capped, first_text, instant, iso_to_epoch_ms, nanos_to_ms
from .lines import json_lines, numbered_lines

# Formats by precedence, how rows of recorded sessions are marked, and types of sandbox events.
FORMATS = ["policy-evidence", "openinference", "intelligence-spans", "chat-trajectory", "sandbox-events"]
SESSION_KIND = ".policy_evidence.session"
SANDBOX_EVENTS = ["start", "raw", "result", "done", "error"]
# Attributes that tell the same, the first that is there counts.
MODELS = ["llm.model_name", "model", "gen_ai.request.model"]
TOOLS = ["tool.name", "tool_name", "mcp.tool.name"]
CONTENTS = ["user_prompt", "gen_ai.prompt.messages", "log.content.task"]
INPUT_TOKENS = ["gen_ai.usage.input_tokens", "llm.token_count.prompt"]
OUTPUT_TOKENS = ["gen_ai.usage.output_tokens", "llm.token_count.completion"]
COSTS = ["gen_ai.usage.cost.total", "llm.cost.total"]


def _at(v: Column, *names: str) -> Column:
    return F.try_variant_get(v, "$" + "".join(f'["{n}"]' for n in names), "variant")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _text(v: Column, *names: str) -> Column:
    """A text that isn't empty; null for anything else."""
    x = _at(v, *names)
    return F.when(_is(x, "STRING"), F.nullif(F.try_variant_get(x, "$", "string"), F.lit("")))


def row_formats(v: Column) -> dict[str, Column]:
    """Whether a row (variant) shows each format."""
    text = lambda n: _is(_at(v, n), "STRING")
    may = lambda n, kind: _at(v, n).isNull() | _is(_at(v, n), kind)
    there = lambda n: _at(v, n).isNotNull() & ~_is(_at(v, n), "VOID")
    no_parent = _at(v, "parent_span_id").isNull() | _is(_at(v, "parent_span_id"), "VOID") | text("parent_span_id")
    kind = F.lower(F.coalesce(*(_text(v, n) for n in ("type", "event", "name", "kind"))))
    return {
        "policy-evidence": F.coalesce(F.try_variant_get(v, "$.kind", "string").endswith(SESSION_KIND), F.lit(False)),
        "openinference": text("trace_id") & text("span_id") & no_parent & text("name") & text("start_time") & text("end_time") & _is(_at(v, "status"), "OBJECT") & _is(_at(v, "attributes"), "OBJECT") & may("resource", "OBJECT") & may("scope", "OBJECT") & may("links", "ARRAY"),
        "intelligence-spans": text("trace_id") & text("name") & _is(_at(v, "attributes"), "OBJECT") & (there("start_unix_nano") | there("start_time") | there("received_at")),
        "chat-trajectory": _is(_at(v, "messages"), "ARRAY") | (text("role") & there("content")),
        "sandbox-events": F.coalesce(kind.isin(*SANDBOX_EVENTS), F.lit(False)),
    }


def formats(rows: DataFrame) -> DataFrame:
    """file, format (null: none), rows of each file; rows: file, v (variant, null for what is no JSON)."""
    shown = row_formats(F.col("v"))
    each = [F.bool_or(shown[n]) if n == "sandbox-events" else F.bool_and(F.coalesce(shown[n], F.lit(False))) for n in FORMATS]
    return rows.groupBy("file").agg(F.coalesce(*(F.when(test, F.lit(n)) for n, test in zip(FORMATS, each, strict=True))).alias("format"), F.count("*").alias("rows"))


def detected(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """formats() of files of JSON lines."""
    return formats(numbered_lines(spark, path).select("file", F.try_parse_json("value").alias("v")))


def span_files(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The files of spans at a path, and the others with the format that they hold instead.

    A named file is always read. Of a folder, only what lies in folders named otlp counts if
    there are such; files are taken in the order of their names, at any depth.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jsonl,ndjson}").load(path)
    names = sorted(r.path for r in found.select("path").collect())  # names of files alone
    if not names:
        found = spark.read.format("binaryFile").load(path).select("path").limit(2).collect()
        if len(found) != 1:
            raise FileNotFoundError(f"no files of JSON lines under {path}")
        return [found[0].path], spark.createDataFrame([], "file string, format string, rows long")
    if len(names) == 1 and names[0].rstrip("/").endswith(path.rstrip("/").rsplit("/", 1)[-1]):
        return names, spark.createDataFrame([], "file string, format string, rows long")
    names = [n for n in names if "/otlp/" in n] or names
    seen = formats(json_lines(spark, names))
    kinds = {r.file: r.format for r in seen.select("file", "format").collect()}  # a row for each file
    plain = lambda n: n.replace("file:///", "file:/")
    spans = {plain(f) for f, kind in kinds.items() if kind in ("openinference", "intelligence-spans")}
    kept = [n for n in names if plain(n) in spans]
    if not kept:
        raise FileNotFoundError(f"no files of spans under {path}: {len(names)} files hold something else")
    return kept, seen.filter(F.col("format").isNull() | ~F.col("format").isin("openinference", "intelligence-spans"))


def _time(v: Column, *names: str) -> Column:
    parts = [F.coalesce(F.when(_is(_at(v, n), "STRING"), iso_to_epoch_ms(_text(v, n))), instant(F.try_variant_get(v, f'$["{n}"]', "double"))) for n in names]
    return F.coalesce(*parts)


def _number(v: Column, kind: str, names: list[str]) -> Column:
    a = _at(v, "attributes")
    return F.coalesce(F.try_variant_get(v, f'$["{names[0]}"]', kind), *(F.try_variant_get(a, f'$["{n}"]', kind) for n in names[1:]))


def intelligence_spans(rows: DataFrame) -> DataFrame:
    """Spans of rows (file, line, v) that have attributes and one of several times; ids that are absent come from the row's digest."""
    v, a = F.col("v"), _at(F.col("v"), "attributes")
    digest = F.sha2(F.to_json(v), 256)
    start = F.coalesce(nanos_to_ms(F.try_variant_get(v, "$.start_unix_nano", "decimal(38,0)")), _time(v, "start_time", "received_at"))
    end = F.coalesce(nanos_to_ms(F.try_variant_get(v, "$.end_unix_nano", "decimal(38,0)")), _time(v, "end_time"), start)
    name = F.coalesce(_text(v, "name"), F.lit("intelligence.span"))
    of = lambda names: first_text(*(_text(a, n) for n in names))
    model, tool = F.coalesce(_text(v, "model"), of(MODELS)), of(TOOLS)
    kind = inferred_kind(of(["openinference.span.kind"]), F.coalesce(_text(a, "span.type"), F.lit("")), name, model, tool)
    return rows.select(
        F.coalesce(_text(v, "trace_id"), F.substring(digest, 1, 32)).alias("trace_id"), F.coalesce(_text(v, "id"), F.substring(F.sha2(F.concat(F.lit("span\0"), F.to_json(v)), 256), 1, 16)).alias("span_id"),
        _text(v, "parent_span_id").alias("parent_span_id"), name.alias("name"), start.alias("start_ms"), F.when(end >= start, end).alias("end_ms"),
        status_code(F.coalesce(_text(v, "status_code"), _text(v, "status", "code"))).alias("status_code"), F.coalesce(_text(v, "status_message"), _text(v, "status", "message")).alias("status_message"),
        kind.alias("kind"), model.alias("model"), tool.alias("tool"),
        _number(v, "bigint", ["input_tokens", *INPUT_TOKENS]).alias("input_tokens"), _number(v, "bigint", ["output_tokens", *OUTPUT_TOKENS]).alias("output_tokens"), _number(v, "double", ["cost_usd", *COSTS]).alias("cost_usd"),
        of(CONTENTS).alias("content"), F.coalesce(_text(v, "session_id"), of(["session.id"])).alias("session_id"), "file", "line",
    )


def session_spans(rows: DataFrame) -> DataFrame:
    """One AGENT span for each recorded session of rows (file, line, v)."""
    v = F.col("v")
    digest = F.sha2(F.to_json(v), 256)
    number = lambda *names: F.try_variant_get(_at(v, *names[:-1]) if len(names) > 1 else v, f'$["{names[-1]}"]', "bigint")
    start = F.coalesce(_time(_at(v, "metrics"), "firstSpanAt"), _time(v, "generatedAt"), number("session", "mtimeMs"))
    totals = ("execution", "execution", "tokenUsage", "totals")
    said = F.to_json(F.struct(*(_at(v, n).alias(n) for n in ("session", "repo", "metrics", "signals", "provenance"))))
    return rows.select(
        F.coalesce(_text(v, "session", "sessionId"), F.substring(digest, 1, 32)).alias("trace_id"), F.concat(F.lit("policy:"), F.substring(digest, 1, 16)).alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"),
        F.lit("policy_evidence.session").alias("name"), start.alias("start_ms"), F.coalesce(_time(_at(v, "metrics"), "lastSpanAt"), start).alias("end_ms"), F.lit("UNSET").alias("status_code"), F.lit(None).cast("string").alias("status_message"),
        F.lit("AGENT").alias("kind"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("tool"), number(*totals, "input").alias("input_tokens"), number(*totals, "output").alias("output_tokens"), F.lit(None).cast("double").alias("cost_usd"),
        capped(said).alias("content"), _text(v, "session", "sessionId").alias("session_id"), "file", "line",
    )
