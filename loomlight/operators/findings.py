"""Ranked findings: thresholds as data, one small test each over aggregates of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Severities by rank, findings listed, and the thresholds at which sessions and files are told of.
SEVERITY = ["high", "medium", "low"]
MOST_FINDINGS = 25
UNATTRIBUTED_HIGH, LOOPS_HIGH, LOOP_SESSIONS_HIGH = 0.25, 10, 0.3
ERRORS, ERROR_RATE, ERRORS_HIGH, ERROR_RATE_HIGH = 10, 0.1, 50, 0.3
LARGE_TOKENS, LARGE_TOKENS_MEDIUM = 500_000, 1_000_000
LONG_DOC, LONG_DOC_MEDIUM, LONG_NOTE, LONG_NOTE_MEDIUM = 100, 200, 40, 120
NOTES = ["reflection", "handoff"]


def inspect(sessions: DataFrame, files: DataFrame, most: int = MOST_FINDINGS) -> DataFrame:
    """id, severity, impact of what a session index shows; by severity, impact and id.

    sessions: trace_id, attributed, loops, calls, errors, tokens; files of context: path, root,
    kind, lines, has_toc, rows, invalid_rows, linked_rows. Each table is summed once.
    """
    c, none = F.col, F.lit(0).cast("long")
    rate = F.coalesce(F.try_divide("errors", "calls"), F.lit(0.0))
    failing, large = (c("errors") >= ERRORS) | (rate >= ERROR_RATE), c("tokens") >= LARGE_TOKENS
    of_sessions = sessions.agg(
        F.count("*").alias("n"), F.count_if(~c("attributed")).alias("unattributed"), F.count_if(c("loops") > 0).alias("looping"), F.coalesce(F.sum("loops"), none).alias("loops"),
        F.count_if(failing).alias("failing"), F.coalesce(F.sum(F.when(failing, c("errors"))), none).alias("errors"), F.max(F.when(failing, rate)).alias("worst"), F.max(F.when(large, c("tokens"))).alias("largest"),
    )
    no_toc = ~F.coalesce(c("has_toc"), F.lit(True))
    doc, note = (c("kind") == "instruction-doc") & (c("lines") >= LONG_DOC) & no_toc, c("kind").isin(*NOTES) & (c("lines") >= LONG_NOTE) & no_toc
    unlinked = F.when((c("kind") == "skill-runs") & (c("linked_rows") < c("rows")), c("rows") - c("linked_rows"))
    of_files = files.agg(
        F.count("*").alias("files"), F.countDistinct("root").alias("roots"), F.count_if(c("kind") == "instruction-doc").alias("docs"), F.max(F.when(doc, c("lines"))).alias("long_doc"), F.max(F.when(note, c("lines"))).alias("long_note"),
        F.coalesce(F.sum("invalid_rows"), none).alias("invalid"), F.sum(unlinked).alias("unlinked"), F.coalesce(F.bool_or(unlinked.isNotNull() & (c("linked_rows") == 0)), F.lit(False)).alias("never_linked"),
    )
    high = lambda test, other="medium", top="high": F.when(F.coalesce(test, F.lit(False)), top).otherwise(other)
    some, context = c("n") > 0, (c("n") == 0) | (c("files") > 0)
    rules = [
        ("index.no-sessions", ~some, F.lit("high"), F.lit(100)),
        ("repo.missing-attribution", some & (c("unattributed") > 0), high(c("unattributed") >= UNATTRIBUTED_HIGH * c("n")), c("unattributed")),
        ("session.repeated-call-loops", some & (c("looping") > 0), high((c("loops") >= LOOPS_HIGH) | (c("looping") / F.greatest("n", F.lit(1)) >= LOOP_SESSIONS_HIGH)), c("loops")),
        ("session.tool-errors", some & (c("failing") > 0), high((c("errors") >= ERRORS_HIGH) | (c("worst") >= ERROR_RATE_HIGH)), c("errors")),
        ("session.large-token-runs", some & c("largest").isNotNull(), high(c("largest") >= LARGE_TOKENS_MEDIUM, "low", "medium"), c("largest")),
        ("context.none-indexed", some & (c("files") == 0), F.lit("medium"), c("n")),
        ("context.no-instruction-docs", context & (c("roots") > 0) & (c("docs") == 0), F.lit("medium"), c("roots")),
        ("context.long-docs-without-toc", context & c("long_doc").isNotNull(), high(c("long_doc") >= LONG_DOC_MEDIUM, "low", "medium"), c("long_doc")),
        ("context.long-narrative-docs-without-toc", context & c("long_note").isNotNull(), high(c("long_note") >= LONG_NOTE_MEDIUM, "low", "medium"), c("long_note")),
        ("context.invalid-jsonl", context & (c("invalid") > 0), F.lit("high"), c("invalid")),
        ("context.skill-run-trace-links", context & c("unlinked").isNotNull(), high(c("never_linked"), "low", "medium"), c("unlinked")),
    ]
    rows = F.array_compact(F.array(*(F.when(fires, F.struct(F.lit(i).alias("id"), severity.alias("severity"), impact.cast("long").alias("impact"))) for i, fires, severity, impact in rules)))
    return ranked(of_sessions.join(of_files, F.lit(True)).select(F.inline(rows)), most)  # one row each


def ranked(found: DataFrame, most: int) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("severity"))
    return found.orderBy(rank, F.desc("impact"), "id").limit(most)


def live_rules(actions: DataFrame) -> DataFrame:
    """The four rules of a live session: repeated failing command, verification without change, claim without check, error rate.

    trace_id, rule, severity, n. actions: trace_id, action, tool, content, status_code, is_tool, start_us, ord.
    """
    from .joins import unverified_claims
    from .windows import verifications_since_edit

    failing = actions.filter(F.col("is_tool") & (F.col("status_code") == "ERROR")).groupBy("trace_id", "tool", "content").agg(F.count("*").alias("n")).filter("n >= 2")
    one = failing.select("trace_id", F.lit("same-failing-command").alias("rule"), F.when(F.col("n") >= 3, "high").otherwise("medium").alias("severity"), F.col("n").cast("double"))
    two = verifications_since_edit(actions).select("trace_id", F.lit("verification-without-change"), "severity", F.col("verifications").cast("double"))
    three = unverified_claims(actions).select("trace_id", F.lit("claim-without-verification"), F.lit("medium"), F.lit(1.0))
    rate = actions.filter("is_tool").groupBy("trace_id").agg(F.count("*").alias("tools"), F.count_if(F.col("status_code") == "ERROR").alias("errors")).withColumn("n", F.col("errors") / F.col("tools"))
    four = rate.filter("tools >= 4 and n >= 0.5").select("trace_id", F.lit("high-tool-error-rate"), F.when(F.col("n") >= 0.75, "high").otherwise("medium"), F.round("n", 9))
    return one.union(two).union(three).union(four)


def analyst_route(signals: DataFrame) -> DataFrame:
    """The analysts that a run's signals call for, besides the baseline."""
    extra = F.array_compact(F.array(F.when(F.col("failures") > 0, F.lit("failure")), F.when(F.col("loops") > 0, F.lit("loop")), F.when(F.col("corrective") > 0, F.lit("reaction"))))
    return signals.select("trace_id", F.array_join(F.concat(F.array(F.lit("baseline")), extra), ",").alias("analysts"))


def exclusion(cases: DataFrame) -> DataFrame:
    """Why a case can't be replayed, the first reason that holds; null if it can."""
    reason = F.when(F.col("steps").isNull(), "no raw trajectory").when(F.col("image").isNull(), "no image").when(F.col("gold").isNull(), "no gold").when(F.col("submit_only"), "submit-only gold")
    return cases.withColumn("reason", reason)


def verdicts(rows: DataFrame) -> DataFrame:
    """divergent, reproduced or fix-flipped."""
    return rows.withColumn("verdict", F.when(~F.col("replayed"), "divergent").when(F.col("flipped"), "fix-flipped").otherwise("reproduced"))


# Fixed value: the tool by which a session uses a skill.
SKILL_TOOL = "Skill"


def adoption(spans: DataFrame) -> DataFrame:
    """Sessions by capability for skills (supported beats unsupported beats unknown), and how many use one."""
    rank = F.when(F.col("harness") == "claude-code", 2).when(F.col("harness") == "codex", 1).otherwise(0)
    skill = (F.col("kind") == "TOOL") & (F.col("tool") == SKILL_TOOL)
    per = spans.groupBy("trace_id").agg(F.max(rank).alias("rank"), F.count_if(skill).alias("skills"))
    rows = per.withColumn("capability", F.when((F.col("rank") == 2) | (F.col("skills") > 0), "supported").when(F.col("rank") == 1, "unsupported").otherwise("unknown"))
    return rows.groupBy("capability").agg(F.count("*").alias("sessions"), F.count_if(F.col("skills") > 0).alias("with_skill"), F.sum("skills").alias("skill_calls")).withColumn("penetration", F.round(F.when(F.col("capability") == "supported", F.try_divide("with_skill", "sessions")), 9))
