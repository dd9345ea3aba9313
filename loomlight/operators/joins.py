"""Joins: links to causes, orphans, as-of, claims without check, set differences.

Equality joins throughout, so that Spark can shuffle or broadcast by size; ranges come as a
residual condition or as a window over both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def link_edges(spans: DataFrame) -> DataFrame:
    """Each link with its cause (the first span of that id), or with none; spans may have an array of links or one."""
    causes = spans.groupBy("span_id").agg(F.min_by(F.struct("trace_id", "iteration"), "ord").alias("cause")).select(F.col("span_id").alias("link_span_id"), F.col("link_span_id").alias("cause_id"), F.col("cause.trace_id").alias("cause_trace"))
    if "links" in spans.columns:
        links = spans.select("span_id", "trace_id", F.explode("links").alias("l")).select("span_id", "trace_id", F.col("l.span_id").alias("link_span_id"), F.col("l.kind").alias("link_kind"))
    else:
        links = spans.filter("link_span_id is not null").select("span_id", "trace_id", "link_span_id", "link_kind")
    return links.join(causes, "link_span_id", "left")


def orphans(spans: DataFrame) -> DataFrame:
    """Spans whose parent is in no trace."""
    ids = spans.select(F.col("span_id").alias("parent_span_id")).distinct()
    return spans.filter("parent_span_id is not null").join(ids, "parent_span_id", "left_anti")


def rerooted(spans: DataFrame) -> DataFrame:
    """Spans with their parent, or null where that isn't in the same trace."""
    parents = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("there")).distinct()
    return spans.join(parents, ["trace_id", "parent_span_id"], "left").withColumn("parent_span_id", F.when(F.col("there"), F.col("parent_span_id"))).drop("there")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """For each left row the latest right value at or before it, by key: one sort over both sides, no range join. A null key matches none."""
    both = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType)).unionByName(right.select(key, at, F.col(value).alias("_value")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(at, "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.when(F.col(key).isNotNull(), F.last("_value", ignorenulls=True).over(order))
    return both.withColumn(value, latest).filter("_side = 1").drop("_side", "_value")


def unverified_claims(actions: DataFrame) -> DataFrame:
    """The last claim of each trace, if no verification starts later: compares with the latest verification, no range join."""
    rows = actions.groupBy("trace_id").agg(F.max(F.when(F.col("action") == "claim", F.struct("start_us", "ord"))).alias("claim"), F.max(F.when(F.col("action") == "verify", F.col("start_us"))).alias("verified_us"))
    open_ = F.col("verified_us").isNull() | (F.col("verified_us") <= F.col("claim.start_us"))
    return rows.filter(F.col("claim").isNotNull() & open_).select("trace_id", F.col("claim.ord").alias("ord"))


def linked_runs(runs: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """How many runs belong to a selected session, and how many don't."""
    found = runs.join(sessions.select(key).distinct().withColumn("selected", F.lit(True)), key, "left")
    return found.agg(F.count_if("selected").alias("linked"), F.count_if(F.col("selected").isNull()).alias("unlinked"))


def edge_differences(declared: DataFrame, referenced: DataFrame) -> DataFrame:
    """Edges (parent, child) that only one of two sources has."""
    both = declared.select("parent", "child", F.lit(True).alias("a")).distinct().join(referenced.select("parent", "child", F.lit(True).alias("b")).distinct(), ["parent", "child"], "full_outer")
    return both.filter("a is null or b is null").select("parent", "child", F.when(F.col("a"), "declared").otherwise("referenced").alias("only_in"))


def interval_pairs(left: DataFrame, right: DataFrame, width_us: int) -> DataFrame:
    """Rows of one key at most width apart: each right row stands in its bucket of time and both beside it, so the join is on equality."""
    bucket = F.expr(f"start_us div {width_us}")
    near = right.select("trace_id", F.col("span_id").alias("right_id"), F.col("start_us").alias("right_us"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    pairs = left.select("trace_id", F.col("span_id").alias("left_id"), F.col("start_us").alias("left_us"), bucket.alias("bucket")).join(near, ["trace_id", "bucket"])
    return pairs.filter(F.abs(F.col("left_us") - F.col("right_us")) <= width_us).select("trace_id", "left_id", "right_id")


def bag_difference(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Left rows less as many of equal keys as right has, the first ones."""
    counts = right.groupBy(*keys).agg(F.count("*").alias("taken"))
    numbered = left.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return numbered.join(counts, keys, "left").filter(F.col("n") > F.coalesce("taken", F.lit(0))).drop("n", "taken")


def first_resolvable(findings: DataFrame, corpora: DataFrame, key: str, priority: str, value: str) -> DataFrame:
    """The value of the corpus with the least priority that has the key."""
    best = corpora.groupBy(key).agg(F.min_by(value, priority).alias(value))
    return findings.join(best, key, "left")


def identity_merge(rows: DataFrame, keys: list[str], content: str, order: str) -> tuple[DataFrame, DataFrame]:
    """First row of each identity, and a verdict on each later one: repeat or conflict."""
    window = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("n", F.row_number().over(window)).withColumn("first_content", F.first(content).over(window))
    verdict = F.when(F.col("first_content") == F.col(content), "repeat").otherwise("conflict")
    return marked.filter("n = 1").drop("n", "first_content"), marked.filter("n > 1").withColumn("verdict", verdict).drop("n", "first_content")


def only_in_first_source(rows: DataFrame, identity: str, source: str) -> DataFrame:
    """Rows whose source is the first that has their identity."""
    first = Window.partitionBy(identity)
    return rows.withColumn("least", F.min(source).over(first)).filter(F.col("least") == F.col(source)).drop("least")


def not_yet(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key and hash the state doesn't hold."""
    return rows.join(state.select(*keys).distinct(), keys, "left_anti")


def without_ambiguous_parents(rows: DataFrame, node: str, identity: str, parent: str) -> DataFrame:
    """All rows, with dropped_edge: an edge to a node that several identities claim is dropped, its row stays."""
    claims = rows.groupBy(F.col(node).alias(parent)).agg((F.countDistinct(identity) > 1).alias("ambiguous")).filter("ambiguous")
    found = rows.join(claims, parent, "left").withColumn("dropped_edge", F.coalesce("ambiguous", F.lit(False)))
    return found.withColumn(parent, F.when(~F.col("dropped_edge"), F.col(parent))).drop("ambiguous")
