"""Exact quantiles by distributed selection: no task sees more than a range of a measure's different values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import small, written


def quantiles(values: DataFrame, shares: list[float]) -> DataFrame:
    """measure, share, value of (measure, x): linear between the ranks around share * (n - 1); nulls don't count.

    Equal values are counted first, so a value that comes often is one row. Ranges of values are
    dealt to tasks; counts by range tell which ranges hold the wanted ranks, and only those are
    ranked value by value.
    """
    counts = values.filter("x is not null").groupBy("measure", "x").agg(F.count("*").alias("n"))
    dealt = written(counts.repartitionByRange("measure", "x").withColumn("part", F.spark_partition_id()))
    # a row for each range of each measure
    ranges = dealt.groupBy("measure", "part").agg(F.sum("n").alias("n"), F.min("x").alias("low"))
    own = Window.partitionBy("measure").orderBy("low")
    placed = ranges.withColumn("start", F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("measure")))
    at = F.col("share") * (F.col("total") - 1)
    wanted = placed.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("at", at).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    hits = written(wanted.filter("rank >= start and rank < start + n").select("measure", "part", "share", "at", "rank", "start"))
    chosen = dealt.join(small(hits.select("measure", "part").distinct()), ["measure", "part"])
    within = Window.partitionBy("measure", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = chosen.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    found = ranked.join(small(hits), ["measure", "part"]).filter("rank >= start + before and rank < start + before + n")
    low, high = F.min_by("x", "rank"), F.max_by("x", "rank")
    return found.groupBy("measure", "share").agg((low + (F.max("at") - F.floor(F.max("at"))) * (high - low)).alias("value"))
