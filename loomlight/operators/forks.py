"""Where a forked session begins in a log that repeats its parent's turns: a ladder of evidence, the best rung first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import uuid7_ms

#: Fixed value: seconds between a turn and the session's start that count as the same time.
BAND_S = 2
_UUID7 = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def uuid7_time(x: Column) -> Column:
    """Milliseconds of a version-7 UUID; null for any other text."""
    return F.when(x.rlike(_UUID7), uuid7_ms(x))


def fork_boundaries(children: DataFrame, turns: DataFrame, band_s: int = BAND_S) -> DataFrame:
    """child, rung, state, turn_id, matches of each child.

    children: child (a log), session_id, started_s; turns: child, turn_id, started_s, the turns that
    start in the log. Rungs: "exact", a turn with the session's own id; "created", if ids are version-7 UUIDs,
    the earliest turn made at or after the session; "near", the one turn that starts within the
    band. The first rung with a match decides: with one turn it is "resolved", with several
    it stays "ambiguous"; without any rung the child is "missing". A turn told twice counts once.
    """
    made, turned = uuid7_time(F.col("session_id")), uuid7_time(F.col("turn_id"))
    both = children.join(turns.withColumnRenamed("started_s", "turn_s").distinct(), "child", "left")
    both = both.withColumn("made", F.when(turned >= made, turned))
    near = F.abs(F.col("turn_s") - F.col("started_s")) <= band_s
    # turns that are told with several times count once, by the first of them that holds
    once = both.groupBy("child", "session_id", "turn_id").agg(F.bool_or(F.col("turn_id") == F.col("session_id")).alias("exact"), F.min("made").alias("made"), F.bool_or(near).alias("near"))
    # how many turns share each time, then the earliest time
    timed = once.groupBy("child", "made").agg(
        F.count_if("exact").alias("exact"), F.min(F.when(F.col("exact"), F.col("turn_id"))).alias("exact_turn"),
        F.count("turn_id").alias("n"), F.min("turn_id").alias("turn"),
        F.count_if("near").alias("near"), F.min(F.when(F.col("near"), F.col("turn_id"))).alias("near_turn"),
    )
    rungs = timed.groupBy("child").agg(
        F.sum("exact").alias("exact"), F.min("exact_turn").alias("exact_turn"),
        F.min(F.when(F.col("made").isNotNull(), F.struct("made", "n", "turn"))).alias("created"),
        F.sum("near").alias("near"), F.min("near_turn").alias("near_turn"),
    )
    rung = F.when(F.col("exact") > 0, "exact").when(F.col("created").isNotNull(), "created").when(F.col("near") > 0, "near")
    by = lambda a, b, c: F.when(F.col("rung") == "exact", a).when(F.col("rung") == "created", b).when(F.col("rung") == "near", c)
    found = rungs.withColumn("rung", rung).withColumn("matches", F.coalesce(by(F.col("exact"), F.col("created.n"), F.col("near")), F.lit(0)))
    turn = F.when(F.col("matches") == 1, by(F.col("exact_turn"), F.col("created.turn"), F.col("near_turn")))
    state = F.when(F.col("matches") == 0, "missing").when(F.col("matches") == 1, "resolved").otherwise("ambiguous")
    return found.select("child", "rung", state.alias("state"), turn.alias("turn_id"), "matches")
