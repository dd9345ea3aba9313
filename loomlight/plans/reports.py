"""Reports in Markdown and packs of files, from small results only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classifiers import is_expected_blocking
from ..operators import aggregates as A
from ..operators import validation as V
from ..sources import readers, writers

#: Rows of a table that a report shows; the tables themselves are whole.
SHOWN = 20


def table(df: DataFrame, most: int = SHOWN) -> str:
    """A Markdown table of the first rows, and how many more there are."""
    rows = df.limit(most + 1).collect()
    out = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    out += ["| " + " | ".join("unknown" if v is None else str(v) for v in r) + " |" for r in rows[:most]]
    return "\n".join(out + (["", "More rows are not shown."] if len(rows) > most else []))


def span_columns(spans: DataFrame) -> DataFrame:
    """What read_spans() gives, with the columns that operators ask for."""
    link = F.get("links", F.lit(0))
    return spans.withColumns({
        "start_us": F.col("start_ms") * 1000,
        "end_us": F.col("end_ms") * 1000,
        "ord": F.monotonically_increasing_id(),
        "expected_blocking": F.coalesce(is_expected_blocking(F.col("tool"), F.col("args")), F.lit(False)),
        "link_span_id": link["span_id"],
        "link_kind": link["kind"],
    })


def validation_report(spark: SparkSession, path: str) -> tuple[str, bool]:
    """What a file of spans can answer, and whether any span could be read."""
    good, bad = readers.read_spans(spark, path)
    spans = span_columns(readers.merged(good)[0])
    ok = not spans.isEmpty()
    found = V.findings(spans)
    parts = ["# Validation", f"ok: {str(ok).lower()}", "## Findings", table(found.orderBy("severity", "code")), "## Capabilities", table(V.capabilities(found, V.evidence(spans)).orderBy("capability")), "## Lines that are not spans", table(bad.orderBy("file", "line"))]
    return "\n\n".join(parts) + "\n", ok


def analysis_report(spark: SparkSession, path: str) -> str:
    """Tools, loops, failures and costs of a file of spans; durations only where the times allow."""
    good, _ = readers.read_spans(spark, path)
    spans = span_columns(readers.merged(good)[0])
    able = {r.capability: r.available for r in V.capabilities(V.findings(spans), V.evidence(spans)).collect()}
    parts = ["# Analysis", "## Tools", table(A.tool_counts(spans).orderBy(F.desc("calls"), "tool")), "## Repeated calls", table(A.stuck_loops(spans).orderBy(F.desc("occurrences"))), "## Failed runs", table(A.failure_clusters(spans)), "## Costs", table(A.cost_provenance(spans))]
    parts += ["## Latency", table(A.weighted_latency(A.tool_use(spans)).orderBy("tool"))] if able["latency-analysis"] else ["## Latency", "The inputs are incomplete: latency-analysis is not available."]
    return "\n\n".join(parts) + "\n"


def write_pack(spark: SparkSession, path: str, findings: DataFrame, folder: str) -> None:
    """Findings, evidence rows and spans of an investigation, with a manifest last."""
    good, _ = readers.read_spans(spark, path)
    findings.write.mode("overwrite").json(f"{folder}/findings")
    writers.evidence_rows(findings).write.mode("overwrite").json(f"{folder}/evidence")
    writers.write_spans(readers.merged(good)[0], f"{folder}/spans")
    writers.manifest(spark, folder).write.mode("overwrite").json(f"{folder}/manifest")
