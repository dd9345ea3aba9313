"""Recorded runs against their replays: steps aligned by position, cases judged, rates over all cases.

recorded: case_id, step, command, returncode, signature (of a failure); rerun: case_id, step,
command, returncode, output; attempts at a fix: case_id, attempt, executed, vanished.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: percent of divergent steps up to which a case counts as replayed.
MOST_DIVERGENT = 10


def failing_steps(recorded: DataFrame) -> DataFrame:
    """case_id, target: the first step of each case that failed."""
    return recorded.filter("returncode <> 0").groupBy("case_id").agg(F.min("step").alias("target"))


def aligned(recorded: DataFrame, rerun: DataFrame) -> DataFrame:
    """case_id, step and what differs there: same, command, returncode, missing (not run again) or extra (not recorded)."""
    a = recorded.select("case_id", "step", F.struct("command", "returncode", "signature").alias("a"))
    b = rerun.select("case_id", "step", F.struct("command", "returncode", "output").alias("b"))
    differs = (
        F.when(F.col("b").isNull(), "missing")
        .when(F.col("a").isNull(), "extra")
        .when(~F.col("a.command").eqNullSafe(F.col("b.command")), "command")
        .when(~F.col("a.returncode").eqNullSafe(F.col("b.returncode")), "returncode")
        .otherwise("same")
    )
    return a.join(b, ["case_id", "step"], "full_outer").withColumn("difference", differs)


def replayed_cases(recorded: DataFrame, rerun: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each target (case_id, target): steps run again before it, how many diverge, whether its end and its failure's mark agree, and whether the case counts as replayed.

    A case counts if at most MOST_DIVERGENT percent of the steps before diverge and the target's return code agrees.
    """
    steps = targets.join(aligned(recorded, rerun), "case_id", "left")
    before, at = F.col("step") < F.col("target"), F.col("step") == F.col("target")
    executed = before & F.col("b").isNotNull()
    seen = F.coalesce(F.col("b.output").contains(F.col("a.signature")), F.lit(False))
    rows = steps.groupBy("case_id", "target").agg(
        F.count_if(executed).alias("prefix_executed"),
        F.count_if(executed & (F.col("difference") != "same")).alias("divergences"),
        F.max(F.when(at, F.col("a.returncode"))).alias("recorded_returncode"),
        F.coalesce(F.bool_or(F.when(at, F.col("a.returncode").isNotNull() & F.col("a.returncode").eqNullSafe(F.col("b.returncode")))), F.lit(False)).alias("returncode_match"),
        F.coalesce(F.bool_or(F.when(at, seen)), F.lit(False)).alias("signature_match"),
    )
    exact = F.coalesce(F.try_divide(F.col("divergences") * 100, F.col("prefix_executed")), F.lit(0.0))
    return rows.withColumn("divergence_pct", F.round(exact, 1)).withColumn("replayed", (exact <= MOST_DIVERGENT) & F.col("returncode_match"))


def fixes(attempts: DataFrame) -> DataFrame:
    """case_id, executed (any attempt was), first_executed (the first was), flipped_at: the first attempt after which the failure was gone."""
    return attempts.groupBy("case_id").agg(
        F.bool_or("executed").alias("executed"),
        F.bool_or((F.col("attempt") == 1) & F.col("executed")).alias("first_executed"),
        F.min(F.when(F.col("executed") & F.col("vanished"), F.col("attempt"))).alias("flipped_at"),
    )


def rates(cases: DataFrame, fixed: DataFrame) -> DataFrame:
    """rate, numerator, denominator, value of the five headline rates; the value is null where there is nothing to divide by."""
    rows = cases.join(fixed, "case_id", "left")
    ran, flipped = F.coalesce("executed", F.lit(False)), F.col("flipped_at").isNotNull()
    failed = ran & F.coalesce(F.col("recorded_returncode") != 0, F.lit(False))
    parts = {
        "replayability": (F.col("replayed"), F.lit(True)),
        "signature-strict": (F.col("replayed") & F.col("signature_match"), F.lit(True)),
        "fix-flip": (ran & flipped, ran),
        "fix-flip-nonzero": (failed & flipped, failed),
        "fix-flip-first": (F.col("flipped_at") == 1, F.coalesce("first_executed", F.lit(False))),
    }
    counts = rows.agg(*(F.struct(F.count_if(n).alias("numerator"), F.count_if(d).alias("denominator")).alias(name) for name, (n, d) in parts.items()))
    long = counts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("rate"), F.col(f"`{n}`.numerator"), F.col(f"`{n}`.denominator")) for n in parts))))
    return long.withColumn("value", F.round(F.try_divide("numerator", "denominator"), 9))


def flips_by_attempt(fixed: DataFrame) -> DataFrame:
    """How many cases flipped at each attempt."""
    return fixed.filter("flipped_at is not null").groupBy(F.col("flipped_at").alias("attempt")).agg(F.count("*").alias("cases"))
