"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PART_ROWS, compact, release


def _star(links: DataFrame, own: bool, parts: int) -> DataFrame:
    """Joins each u's neighbours to the smallest of them (or of them and u)."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least, "u").withColumn("m", F.least("u", "m"))
    moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if not own else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).coalesce(parts).distinct().coalesce(parts)


def _state(links: DataFrame) -> int:
    """A number that tells whether links have changed."""
    return links.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that links reach) of every node with a link.

    links: u, v, in any direction. Links never grow in number; each round is written to the
    checkpoint folder, so a lost executor costs a round at most.
    """
    now, count = compact(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    before = _state(now)
    while count:
        parts = max(1, -(-2 * count // PART_ROWS))
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, own=False, parts=parts)
        # small stars look from the larger end of each link
        turned = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now, count = compact(_star(turned, own=True, parts=parts))
        after = _state(now)
        if after == before:
            break
        before = after
    release(now.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (node, component) after further links (u, v): only the components that these join are looked at."""
    of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    ends = links.join(of("u"), "u", "left").join(of("v"), "v", "left")
    moved = components(ends.select(F.coalesce("u_part", "u").alias("u"), F.coalesce("v_part", "v").alias("v")))
    after = moved.select(F.col("node").alias("component"), F.col("component").alias("new"))
    known = parts.join(after, "component", "left").select("node", F.coalesce("new", "component").alias("component"))
    return compact(known.union(moved.join(parts.select("node"), "node", "left_anti")))[0]
