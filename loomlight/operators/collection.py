"""What a collection of runs leaves behind besides its spans: files, links, kinships, unreadable rows, findings."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown_summary(text: Column) -> Column:
    """lines, headings and has_toc of a Markdown text; a null text is empty."""
    c = F.coalesce(text, F.lit(""))
    parts = F.split(c, "\n")
    lines = F.when(c == "", 0).when(c.endswith("\n"), F.size(parts) - 1).otherwise(F.size(parts))
    headings = F.size(F.filter(parts, lambda x: x.rlike(r"^#{1,6}\s+\S")))
    toc = c.rlike(r"(?i)\btable of contents\b") | c.rlike(r"(?m)^\s*-\s+\[[^\]]+\]\(#[^)]+\)")
    return F.struct(lines.cast("int").alias("lines"), headings.alias("headings"), toc.alias("has_toc"))


def json_line_counts(lines: DataFrame, *by: str) -> DataFrame:
    """rows and invalid_rows of JSON lines (column value) in each file; blank lines don't count."""
    given = lines.filter(F.trim("value") != "")
    return given.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(F.try_parse_json("value").isNull()).alias("invalid_rows"))


def json_line_keys(lines: DataFrame, *by: str) -> DataFrame:
    """In how many rows of each file a key of the outermost object stands; other rows have no keys."""
    valid = lines.filter(F.try_parse_json("value").isNotNull())
    return valid.select(*by, F.explode(F.array_distinct(F.json_object_keys("value"))).alias("key")).groupBy(*by, "key").agg(F.count("*").alias("n"))


def unreadable_rows(spans: DataFrame, issues: DataFrame) -> DataFrame:
    """source, inherited, rows, kinds: what spans of a source say was unreadable before, and what is now.

    spans: source, unreadable_rows, unreadable_kinds (comma-joined). issues: source, kind.
    The greatest inherited number counts, once; kinds are joined in order.
    """
    kinds = F.split(F.coalesce("unreadable_kinds", F.lit("")), ",")
    before = spans.select("source", F.greatest(F.coalesce("unreadable_rows", F.lit(0)), F.lit(0)).cast("long").alias("inherited"), kinds.alias("kinds"), F.lit(0).alias("new"))
    now = issues.select("source", F.lit(0).cast("long").alias("inherited"), F.array("kind").alias("kinds"), F.lit(1).alias("new"))
    totals = before.union(now).groupBy("source").agg(F.max("inherited").alias("inherited"), F.sum("new").alias("new"), F.flatten(F.collect_set("kinds")).alias("kinds"))
    named = F.array_sort(F.array_distinct(F.filter("kinds", lambda x: x != "")))
    return totals.select("source", "inherited", (F.col("inherited") + F.col("new")).alias("rows"), F.array_join(named, ",").alias("kinds"))


_SINCE = re.compile(r"(\d+)\s*([mhd])", re.IGNORECASE)
_UNIT_MS = {"m": 60_000, "h": 3_600_000, "d": 86_400_000}


def since_ms(value: str, now_ms: int) -> int:
    """Epoch milliseconds of a window before now (30m, 2h, 7d) or of an ISO date; anything else raises."""
    window = _SINCE.fullmatch(value)
    if window:
        return now_ms - int(window[1]) * _UNIT_MS[window[2].lower()]
    try:
        at = datetime.fromisoformat(value)
    except ValueError as error:
        raise ValueError(f"expected 30m, 2h, 7d or an ISO date, not {value!r}") from error
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


# Operations of agents that name other sessions.
SPAWN = ["spawn_agent"]
RESUME = ["send_input", "send_message", "followup_task"]


def session_kin(spans: DataFrame) -> DataFrame:
    """session, children, spawned, resumed (sorted arrays) of each session; a spawned child isn't resumed too.

    spans: session, child_ids and agent_ids (JSON arrays of ids), operation, lifecycle_child.
    """
    ids = lambda c: F.coalesce(F.filter(F.from_json(c, "array<string>"), lambda x: x != ""), F.array().cast("array<string>"))
    direct, agents, none = ids("child_ids"), ids("agent_ids"), F.array().cast("array<string>")
    spawns, resumes = (F.coalesce(F.col("operation").isin(x), F.lit(False)) for x in (SPAWN, RESUME))
    named = spans.select(
        "session",
        F.array_distinct(F.concat(direct, F.when(spawns | resumes, agents).otherwise(none), F.array_compact(F.array(F.nullif("lifecycle_child", F.lit("")))))).alias("children"),
        F.when(spawns, F.concat(direct, agents)).otherwise(none).alias("spawned"),
        F.when(resumes, F.concat(direct, agents)).otherwise(none).alias("resumed"),
    )
    whole = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    kin = named.groupBy("session").agg(*(whole(c).alias(c) for c in ("children", "spawned", "resumed")))
    return kin.withColumn("resumed", F.array_except("resumed", "spawned"))


def skill_documents(kind: Column, status_code: Column, command: Column) -> Column:
    """Names of the skills whose document a successful tool call printed."""
    reads = (kind == "TOOL") & (status_code == "OK") & command.rlike(r"\b(?:cat|sed|head|tail|less|more|awk)\b")
    named = F.regexp_extract_all(command, F.lit(r"(?:^|[\\/'\"])([^\\/'\"\s]+)[\\/]SKILL\.md\b"), F.lit(1))
    return F.when(reads, F.array_distinct(F.filter(named, lambda x: x.rlike("^[A-Za-z][A-Za-z0-9-]*$")))).otherwise(F.array().cast("array<string>"))


def completed_links(links: Column, trace_id: Column) -> Column:
    """Links with a target; those without a trace belong to the span's own."""
    named = F.filter(links, lambda x: F.coalesce(F.trim(x["span_id"]), F.lit("")) != "")
    own = lambda x: F.coalesce(F.when(F.trim(x["trace_id"]) != "", x["trace_id"]), trace_id)
    return F.transform(named, lambda x: F.struct(own(x).alias("trace_id"), x["span_id"].alias("span_id"), x["kind"].alias("kind")))


def stamped(spans: DataFrame, values: dict[str, Column]) -> DataFrame:
    """The spans with the values where they have none of their own."""
    return spans.withColumns({c: F.coalesce(F.col(c), x) if c in spans.columns else x for c, x in values.items()})


def stamped_sessions(spans: DataFrame, fallback: Column) -> DataFrame:
    """Spans without a session_id take the only one of their run, or the fallback; runs with several stay as they are."""
    by_run = spans.groupBy("trace_id").agg(F.min("session_id").alias("only"), F.max("session_id").alias("other"))
    known = spans.join(by_run, "trace_id")
    session = F.when(F.col("only") != F.col("other"), F.col("session_id")).otherwise(F.coalesce("session_id", "only", fallback))
    return known.withColumn("session_id", session).drop("only", "other")


def incompleteness(totals: DataFrame) -> DataFrame:
    """Findings that counts of one row call for: area, severity, part, whole.

    totals: tool_calls, captured_calls, runs, missing_sessions, groups, measurable_groups, loops, quiet_calls and
    quiet_errors (of runs that didn't fail), failed_runs, corrective, skill_runs.
    """
    c = F.col
    arguments, sessions = (F.coalesce(F.try_divide(part, c(whole)), F.lit(1.0)) for part, whole in ((c("captured_calls"), "tool_calls"), (c("runs") - c("missing_sessions"), "runs")))
    worst, unmeasured = F.least(arguments, sessions), c("groups") - c("measurable_groups")
    coverage = F.when(worst < 0.5, "high").when((worst < 0.9) | (unmeasured > 0), "medium").otherwise("low")
    gaps = c("tool_calls") - c("captured_calls") + c("missing_sessions") + unmeasured
    rows = [
        ("instrumentation", gaps > 0, coverage, gaps, c("tool_calls") + c("runs") + c("groups")),
        ("repeated-calls", c("loops") > 0, F.when(c("loops") >= 10, "high").otherwise("medium"), c("loops"), c("runs")),
        ("tool-errors", c("quiet_errors") > 0, F.when(c("quiet_errors") >= 0.25 * c("quiet_calls"), "high").otherwise("medium"), c("quiet_errors"), c("quiet_calls")),
        ("reliability", c("failed_runs") > 0, F.when(c("failed_runs") >= 0.1 * c("runs"), "high").otherwise("medium"), c("failed_runs"), c("runs")),
        ("communication", c("corrective") > 0, F.when(c("corrective") >= 10, "high").otherwise("medium"), c("corrective"), c("runs")),
        ("workflow", (unmeasured == 0) & (c("groups") > 0) & (c("skill_runs") == 0), F.lit("low"), c("skill_runs"), c("groups")),
    ]
    found = F.array(*(F.struct(F.lit(area).alias("area"), fires.alias("fires"), severity.alias("severity"), part.cast("long").alias("part"), whole.cast("long").alias("whole")) for area, fires, severity, part, whole in rows))
    return totals.select(F.explode(found).alias("r")).select("r.*").filter("fires").drop("fires")
