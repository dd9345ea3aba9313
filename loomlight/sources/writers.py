"""Sinks: JSON lines of spans, evidence rows, redacted text, uploads by idempotency key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from ..functions.classifiers import redacted


def span_lines(spans: DataFrame) -> DataFrame:
    """Spans of read_spans() as JSON lines that read_spans() gives back."""
    iso = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    attributes = F.create_map(
        F.lit("openinference.span.kind"), F.col("kind"),
        F.lit("gen_ai.request.model"), F.col("model"),
        F.lit("gen_ai.tool.name"), F.col("tool"),
        F.lit("gen_ai.usage.input_tokens"), F.col("input_tokens").cast("string"),
        F.lit("gen_ai.usage.output_tokens"), F.col("output_tokens").cast("string"),
        F.lit("gen_ai.usage.cost.total"), F.col("cost_usd").cast("string"),
        F.lit("agent.loop.id"), F.col("loop_id"),
        F.lit("agent.loop.iteration"), F.col("iteration").cast("string"),
        F.lit("agent.outcome"), F.col("outcome"),
        F.lit("agent.outcome.score"), F.col("score").cast("string"),
        F.lit("agent.name"), F.col("agent"),
        F.lit("session.id"), F.col("session_id"),
        F.lit("input.value"), F.col("args"),
        F.lit("content"), F.col("content"),
    )
    link = lambda x: F.struct(x["trace_id"].alias("trace_id"), x["span_id"].alias("span_id"), F.struct(x["kind"].alias("agent.link.kind")).alias("attributes"))
    row = F.struct(
        "trace_id", "span_id", "parent_span_id", "name", iso("start_ms").alias("start_time"), iso("end_ms").alias("end_time"),
        F.struct(F.concat(F.lit("STATUS_CODE_"), F.col("status_code")).alias("code"), F.col("status_message").alias("message")).alias("status"),
        F.map_filter(attributes, lambda k, v: v.isNotNull()).alias("attributes"), F.transform("links", link).alias("links"),
    )
    return spans.select(F.to_json(row).alias("value"))


def write_spans(spans: DataFrame, path: str) -> None:
    span_lines(spans).write.mode("overwrite").text(path)


def metadata_only(spans: DataFrame) -> DataFrame:
    """Without contents and messages."""
    return spans.drop("content", "args", "status_message", "canonical")


def redact_spans(spans: DataFrame, columns: tuple[str, ...] = ("content", "args", "status_message")) -> DataFrame:
    return spans.withColumns({c: redacted(F.col(c)) for c in columns if c in spans.columns})


def evidence_rows(findings: DataFrame) -> DataFrame:
    """A row for each reference of each finding (id, severity, evidence array)."""
    return findings.select("id", "severity", F.posexplode_outer("evidence").alias("ref", "uri"))


def upload(rows: DataFrame, key: str, send: Callable[[str, list[Row]], None], size: int = 500) -> None:
    """Sends rows in batches from the executors, each under a key made of its rows, so that a task that runs again sends the same keys."""
    import hashlib

    def each(part: Iterator[Row]) -> None:
        batch: list[Row] = []

        def flush() -> None:
            if batch:
                send(hashlib.sha256("\0".join(str(r[key]) for r in batch).encode()).hexdigest()[:32], list(batch))
                batch.clear()

        for row in part:
            batch.append(row)
            if len(batch) == size:
                flush()
        flush()

    rows.sortWithinPartitions(key).foreachPartition(each)


def manifest(spark, path: str) -> DataFrame:
    """path, bytes and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
