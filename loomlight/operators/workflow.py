"""Sessions that belong together: expansion from seeds over parents and children, with typed issues.

sessions: session_id, path, parent_id, child_ids (array). No path is guessed: a reference to an id
that no session has, or that several files claim, is an issue and is not followed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written
from .graphs import cycles

#: Fixed value: sessions that an expansion may reach.
MOST_SESSIONS = 100


class WorkflowLimit(ValueError):
    """More sessions are connected than may be reached."""


def references(sessions: DataFrame) -> DataFrame:
    """session_id, other, relation (parent or child)."""
    parents = sessions.filter("parent_id is not null").select("session_id", F.col("parent_id").alias("other"), F.lit("parent").alias("relation"))
    return parents.union(sessions.select("session_id", F.explode("child_ids"), F.lit("child"))).distinct()


def expanded(sessions: DataFrame, seeds: DataFrame, most: int = MOST_SESSIONS) -> tuple[DataFrame, DataFrame]:
    """(session_id, distance) of all sessions that the seeds (session_id) reach over references, and the issues (kind, session_id, other) of those.

    Breadth first: a round looks only at what the sessions found last refer to. More than
    `most` sessions are an error, found without expanding further. Issues: missing-session,
    ambiguous-session, parent-conflict (children's parents as told by both sides differ; other: the parents that
    claim the child, comma-joined), parent-cycle (other: the least session of the cycle).
    """
    paths = sessions.groupBy("session_id").agg(F.countDistinct("path").alias("paths"))
    said = written(references(sessions))
    known = written(paths)
    followed = said.join(known.filter("paths = 1").select(F.col("session_id").alias("other")), "other").select("session_id", "other")
    found = frontier = written(seeds.select("session_id").distinct().join(known.filter("paths = 1"), "session_id", "left_semi").select("session_id", F.lit(0).alias("distance")))
    distance = 0
    while True:
        if found.limit(most + 1).count() > most:
            raise WorkflowLimit(f"more than {most} sessions are connected; raise the limit only after looking at the selected tree")
        distance += 1
        near = followed.join(frontier.select("session_id"), "session_id", "left_semi").select(F.col("other").alias("session_id")).distinct()
        frontier = written(near.join(found.select("session_id"), "session_id", "left_anti").limit(most + 1).select("session_id", F.lit(distance).alias("distance")))
        if frontier.isEmpty():
            break
        found = written(found.union(frontier))
    members = found.select("session_id")
    own = said.join(members, "session_id", "left_semi")
    outside = own.join(members.select(F.col("session_id").alias("other")), "other", "left_anti").join(known.select(F.col("session_id").alias("other"), "paths"), "other", "left")
    lost = outside.select(F.when(F.col("paths") > 1, "ambiguous-session").otherwise("missing-session").alias("kind"), "session_id", "other").distinct()
    inside = own.join(members.select(F.col("session_id").alias("other")), "other", "left_semi")
    claimed = inside.filter("relation = 'child'").groupBy(F.col("other").alias("session_id")).agg(F.array_sort(F.collect_set("session_id")).alias("claimed"))
    declared = sessions.join(members, "session_id", "left_semi").groupBy("session_id").agg(F.min("parent_id").alias("declared"))
    present = members.select(F.col("session_id").alias("declared"), F.lit(True).alias("present"))
    none = F.array().cast("array<string>")
    both = declared.join(claimed, "session_id", "left").join(present, "declared", "left").withColumn("claimed", F.coalesce("claimed", none))
    other_parent = F.exists("claimed", lambda x: ~x.eqNullSafe(F.col("declared")))
    unsaid = F.coalesce("present", F.lit(False)) & ~F.coalesce(F.array_contains("claimed", F.col("declared")), F.lit(False))
    conflicts = both.filter((F.size("claimed") > 1) | other_parent | unsaid).select(F.lit("parent-conflict").alias("kind"), "session_id", F.array_join("claimed", ",").alias("other"))
    ring = cycles(declared.select(F.col("session_id").alias("node"), F.col("declared").alias("parent")))
    loops = ring.select(F.lit("parent-cycle").alias("kind"), F.col("node").alias("session_id"), F.col("cycle").alias("other"))
    return found, lost.union(conflicts).union(loops)
