"""Receipts, truncation, lifecycles, sampling, corpus constraints, integrity digests."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sources that changed, came or went between two bindings."""
    both = before.withColumnRenamed("sha256", "a").join(after.withColumnRenamed("sha256", "b"), "path", "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("path")


def truncated(x: Column, most: int = 16_384) -> Column:
    """struct of value (at most so many bytes, cut between characters), bytes, sha256 of the whole and whether it was cut."""
    size = F.octet_length(x)
    head = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(x, "utf-8"), 1, most).cast("string")), "�+$", "")
    return F.struct(F.when(size > most, head).otherwise(x).alias("value"), size.alias("bytes"), F.sha2(x, 256).alias("sha256"), (size > most).alias("truncated"))


def lifecycles(events: DataFrame) -> DataFrame:
    """State of each thread after its events in order: started, completed, failed, interrupted; a start opens a finished one again.

    events: trace_id, ord, event.
    """
    ordered = events.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("ord", "event"))).alias("events"))
    start = F.struct(F.lit("none").alias("state"), F.lit(0).alias("starts"))

    def step(acc: Column, e: Column) -> Column:
        name = e["event"]
        state = F.when(name == "started", "started").when((acc["state"] == "started") & name.isin("completed", "failed", "interrupted"), name).otherwise(acc["state"])
        return F.struct(state.alias("state"), (acc["starts"] + (name == "started").cast("int")).alias("starts"))

    return ordered.select("trace_id", F.aggregate("events", start, step).alias("s")).select("trace_id", "s.state", F.col("s.starts").cast("long").alias("starts"))


def step_constraints(steps: DataFrame, declared: DataFrame) -> DataFrame:
    """Trajectories whose steps aren't 1..n, are repeated, or aren't as many as declared.

    steps: traj_id, step_id; declared: traj_id, step_count.
    """
    own = steps.groupBy("traj_id").agg(F.count("*").alias("n"), F.countDistinct("step_id").alias("different"), F.min("step_id").alias("low"), F.max("step_id").alias("high"))
    both = declared.join(own, "traj_id", "full_outer")
    problem = F.when(F.col("n").isNull(), "no steps").when(F.col("step_count").isNull(), "not declared").when(F.col("n") != F.col("different"), "repeated step").when((F.col("low") != 1) | (F.col("high") != F.col("n")), "gap").when(F.col("n") != F.col("step_count"), "count differs")
    return both.withColumn("problem", problem).filter("problem is not null").select("traj_id", "problem")


def seeded_sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows that depend on the seed and the keys alone, however the rows are dealt."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def distinct_behaviours(vectors: DataFrame, n: int, block: int = 4096) -> DataFrame:
    """n rows of each label that are far from each other: the first by id, then again and again the farthest from those taken.

    vectors: vec_id, label, embedding. Each of n rounds takes one row a label by a distributed
    maximum of the least distance to the rows taken before, ties to the smallest id, so no task
    holds a whole label. block is not used any more.
    """
    rows = vectors.select("vec_id", "label", "embedding")
    taken = rows.groupBy("label").agg(F.min(F.struct("vec_id", "embedding")).alias("row")).select("label", F.array("row").alias("taken"))
    apart = lambda x: F.aggregate(F.zip_with("embedding", x["embedding"], lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, d: s + d)
    for _ in range(n - 1):
        left = rows.join(taken, "label").filter(~F.exists("taken", lambda x: x["vec_id"] == F.col("vec_id")))
        far = left.select("label", "vec_id", "embedding", F.array_min(F.transform("taken", apart)).alias("gap"))
        best = far.groupBy("label").agg(F.max(F.struct("gap", (-F.col("vec_id")).alias("first"), "embedding")).alias("best"))
        best = best.select("label", F.array(F.struct((-F.col("best.first")).cast(vectors.schema["vec_id"].dataType).alias("vec_id"), F.col("best.embedding").alias("embedding"))).alias("more"))
        taken = taken.join(best, "label", "left").select("label", F.concat("taken", F.coalesce("more", F.slice("taken", 1, 0))).alias("taken"))
    return taken.select("label", F.explode("taken").alias("row")).select("row.vec_id", "label")


def deep_values(json_text: Column, key: str, depth: int = 6) -> Column:
    """Scalar values of a key at any depth up to the bound, as strings."""

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        def walk(v: object, left: int) -> Iterator[str]:
            if left < 0:
                return
            if isinstance(v, dict):
                for k, x in v.items():
                    if k == key and not isinstance(x, (dict, list)) and x is not None:
                        yield x if isinstance(x, str) else json.dumps(x)
                    yield from walk(x, left - 1)
            elif isinstance(v, list):
                for x in v:
                    yield from walk(x, left - 1)

        def one(t: str | None) -> list[str]:
            try:
                return list(walk(json.loads(t), depth)) if t else []
            except ValueError:
                return []

        return texts.map(one)

    return find(json_text)


def integrity_spans(receipts: DataFrame) -> DataFrame:
    """Receipts as failed child spans, and one digest of each file's receipts in order."""
    spans = receipts.select(F.col("file").alias("trace_id"), F.concat(F.lit("corrupt:"), F.col("line").cast("string")).alias("span_id"), F.lit("ERROR").alias("status_code"), F.concat(F.lit("unreadable line "), F.col("line").cast("string")).alias("status_message"), "line", "sha256")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "sha256"))), lambda r: r["sha256"]), "\n")
    return spans.join(receipts.groupBy(F.col("file").alias("trace_id")).agg(F.sha2(ordered, 256).alias("digest")), "trace_id")


def repo_of_paths(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The folder that a key's texts name most, two levels deep, ties to the first by name."""
    paths = texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit("/[A-Za-z0-9._-]+/[A-Za-z0-9._-]+"), F.lit(0))).alias("folder"))
    counts = paths.groupBy(key, "folder").agg(F.count("*").alias("n"))
    return counts.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "folder"))).filter("at = 1").select(key, "folder", "n")
