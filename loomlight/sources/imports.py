"""Import of trajectories: written by all tasks to a staging folder, receipted, and published by one rename or not at all.

rows: traj_id, step_count; steps: traj_id, step_id and what a step says. Nothing appears under
the output's name before everything is written, checked and receipted; a failure leaves neither
the output nor the staging folder. An import holds a lock beside the output, so that two of
the same output don't run at once.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extras import step_constraints


class ImportRefused(ValueError):
    """The input breaks a rule, or the output is there already."""


def digest_of(keys: Column, value: Column) -> list[Column]:
    """Aggregates that together are a digest of values at their keys, whatever the order in which they come; one pass, partial sums."""
    one = F.sha2(F.concat(keys.cast("string"), F.lit("\0"), value), 256)
    return [F.sum(F.conv(F.substring(one, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]


def _combined(parts: list[str]) -> Column:
    return F.sha2(F.concat_ws(":", *(F.col(p).cast("string") for p in parts)), 256)


def receipts(steps: DataFrame) -> DataFrame:
    """traj_id, steps, sha256 of each trajectory's steps."""
    content = F.to_json(F.struct(*sorted(c for c in steps.columns if c != "traj_id")))
    sums = digest_of(F.col("step_id"), content)
    own = steps.groupBy("traj_id").agg(F.count("*").alias("steps"), *(s.alias(f"d{i}") for i, s in enumerate(sums)))
    return own.select("traj_id", "steps", _combined(["steps", *(f"d{i}" for i in range(len(sums)))]).alias("sha256"))


@contextlib.contextmanager
def _locked(files: object, lock: object, said: str) -> Iterator[None]:
    try:
        files.create(lock, False).close()
    except Exception as there:
        raise ImportRefused(f"another import of {said} runs, or was cut off: {lock}") from there
    try:
        yield
    finally:
        files.delete(lock, False)


def import_trajectories(spark: SparkSession, rows: DataFrame, steps: DataFrame, out: str, revision: str, leaks: DataFrame | None = None) -> dict:
    """Writes steps by trajectory, receipts and a summary to `out`, and returns the summary.

    Refused: an output that is there, a trajectory whose steps aren't 1 to its declared number,
    a row told twice, and any row of `leaks` (what a scan for labels found).
    """
    jvm = spark.sparkContext._jvm
    path = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    target = path(out.rstrip("/"))
    files, parent, name = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target.getParent(), target.getName()
    if parent is None or not name:
        raise ImportRefused("the output must not be the root of a file system")
    files.mkdirs(parent)
    staging = f"{parent}/.{name}.tmp-{uuid.uuid4().hex}"
    with _locked(files, path(f"{parent}/.{name}.lock"), out):
        if files.exists(target):
            raise ImportRefused(f"{out} exists")
        repeated = rows.groupBy("traj_id").count().filter("count > 1").select("traj_id", F.lit("repeated row").alias("problem"))
        problems = repeated.union(step_constraints(steps, rows.select("traj_id", "step_count")))
        if leaks is not None:
            problems = problems.union(leaks.select(leaks.columns[0], F.lit("label in a step")))
        first = problems.orderBy("traj_id", "problem").limit(5).collect()
        if first:
            raise ImportRefused("; ".join(f"{r.traj_id}: {r.problem}" for r in first))
        try:
            steps.repartition("traj_id").sortWithinPartitions("traj_id", "step_id").write.partitionBy("traj_id").json(f"{staging}/steps")
            # receipts are of what was written, read again
            kinds = steps.schema
            kept = spark.read.schema(kinds).json(f"{staging}/steps")
            receipts(kept.select(*steps.columns)).orderBy("traj_id").write.json(f"{staging}/receipts")
            made = spark.read.schema("traj_id string, steps long, sha256 string").json(f"{staging}/receipts")
            asked = receipts(steps).select(F.col("traj_id").cast("string").alias("traj_id"), F.col("sha256").alias("input"))
            changed = made.join(asked, "traj_id", "full_outer").filter(~F.col("sha256").eqNullSafe(F.col("input")))
            if not changed.isEmpty():
                raise ImportRefused("what was written differs from the input")
            whole = digest_of(F.col("traj_id"), F.col("sha256"))
            n, total, *sums = made.agg(F.count("*"), F.coalesce(F.sum("steps"), F.lit(0)), *whole).first()
            summary = {"revision": revision, "traces": n, "steps": total, "digest": ":".join(str(s or 0) for s in sums), "leak_scan": "passed" if leaks is not None else "not asked"}
            with contextlib.closing(files.create(path(f"{staging}/import.json"), False)) as stream:
                stream.write(bytearray(json.dumps(summary, sort_keys=True).encode()))
            if files.exists(target) or not files.rename(path(staging), target):
                raise ImportRefused(f"{out} could not be published")
        except BaseException:
            files.delete(path(staging), True)
            raise
    return summary
