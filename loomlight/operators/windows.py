"""Ordered computations: trends, resets, pairing, carrying forward, first sight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trends(rounds: DataFrame) -> DataFrame:
    """Trend of each (trace, loop): improved, regressed, mixed, plateaued or unscored.

    With two scored rounds at least the scores decide, else the outcomes, ranked error, fail,
    pass. Order: iteration, then start, then id.
    """
    rank = F.when(F.col("outcome") == "error", 0).when(F.col("outcome") == "fail", 1).when(F.col("outcome") == "pass", 2).cast("double")
    rows = rounds.filter("loop_id is not null or iteration is not null").withColumn("loop", F.coalesce("loop_id", F.concat(F.lit("(unnamed loop in "), "trace_id", F.lit(")")))).withColumn("rank", rank)
    at = F.struct("iteration", "start_us", "ord")

    def ends(c: str) -> list[Column]:
        when = F.when(F.col(c).isNotNull(), at)
        return [F.count(c).alias(f"n_{c}"), F.min_by(c, when).alias(f"first_{c}"), F.max_by(c, when).alias(f"last_{c}"), F.max(c).alias(f"max_{c}"), F.min(c).alias(f"min_{c}")]

    grouped = rows.groupBy("trace_id", "loop").agg(F.count("*").alias("rounds"), *ends("score"), *ends("rank"))

    def trend(c: str) -> Column:
        first, last, top, low = (F.col(f"{x}_{c}") for x in ("first", "last", "max", "min"))
        return F.when(last > first, "improved").when(last < first, "regressed").when((top > first) | (low < first), "mixed").otherwise("plateaued")

    scored, ranked = F.col("n_score") >= 2, F.col("n_rank") >= 2
    return grouped.select(
        "trace_id",
        "loop",
        "rounds",
        F.when(scored, trend("score")).when(ranked, trend("rank")).otherwise("unscored").alias("trend"),
        F.when(scored, "score").when(ranked, "outcome").otherwise("none").alias("basis"),
        "first_score",
        "last_score",
        F.col("max_score").alias("best_score"),
    )


def reactions(turns: DataFrame) -> DataFrame:
    """Human turns that follow a fresh assistant turn, with that turn's step.

    A human turn uses up the assistant text before it; turns of others neither count nor reset,
    empty assistant texts don't count as fresh.
    """
    order = Window.partitionBy("trace_id").orderBy(F.coalesce("step", F.lit(9007199254740991)), "span_id").rowsBetween(Window.unboundedPreceding, -1)
    assistant = (F.col("kind") == "LLM") | F.col("name").startswith("message.assistant")
    fresh = assistant & (F.col("name") != "user.prompt") & (F.trim("content") != "")
    human = (F.col("name") == "user.prompt") & (F.col("actor") == "human")
    rows = turns.withColumn("last_assistant", F.max(F.when(fresh, F.col("step"))).over(order)).withColumn("last_human", F.max(F.when(human, F.col("step"))).over(order))
    return rows.filter(human & F.col("last_assistant").isNotNull() & (F.col("last_human").isNull() | (F.col("last_assistant") > F.col("last_human"))))


def verifications_since_edit(actions: DataFrame) -> DataFrame:
    """Verifications after the last edit of each trace; medium from two, high from three."""
    order = Window.partitionBy("trace_id").orderBy("start_us", "ord")
    rows = actions.withColumn("edits", F.sum((F.col("action") == "edit").cast("int")).over(order))
    last = rows.withColumn("last", F.max("edits").over(Window.partitionBy("trace_id"))).filter("edits = last")
    found = last.groupBy("trace_id").agg(F.count_if(F.col("action") == "verify").alias("verifications"))
    return found.filter("verifications >= 2").withColumn("severity", F.when(F.col("verifications") >= 3, "high").otherwise("medium"))


def monotone_usage(turns: DataFrame, least: int = 3) -> DataFrame:
    """Runs whose input tokens only grow, or whose output tokens only shrink, over the turns that have both."""
    paired = turns.filter("input_tokens is not null and output_tokens is not null")
    order = Window.partitionBy("trace_id").orderBy("start_us", "ord")
    steps = paired.withColumn("grew", F.col("input_tokens") > F.lag("input_tokens").over(order)).withColumn("shrank", F.col("output_tokens") < F.lag("output_tokens").over(order))
    rows = steps.groupBy("trace_id").agg(F.count("*").alias("turns"), F.bool_and("grew").alias("input_growth"), F.bool_and("shrank").alias("output_decay"))
    return rows.filter(F.col("turns") >= least)


def numbered_steps(turns: DataFrame) -> DataFrame:
    """Assistant steps numbered through, others carry the step they stand in."""
    order = Window.partitionBy("trace_id").orderBy("step", "span_id")
    return turns.withColumn("assistant_step", F.sum((F.col("role") == "assistant").cast("int")).over(order))


def carried(rows: DataFrame, column: str) -> DataFrame:
    """The last known value of a column at each row, and the next known one where none came before."""
    order = Window.partitionBy("trace_id").orderBy("ord")
    before = F.last(column, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(column, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("carried", F.coalesce(before, after))


def time_order(rows: DataFrame) -> DataFrame:
    """Rows of each trace that start before the row ahead of them in file order."""
    order = Window.partitionBy("trace_id").orderBy("ord")
    return rows.withColumn("back", F.col("end_us") < F.lag("end_us").over(order)).groupBy("trace_id").agg(F.count_if("back").alias("out_of_order"))


def first_seen(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key, in order."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).filter("n = 1").drop("n")


def fifo_pairs(calls: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Calls and results of one name joined in the order in which they came."""
    order = Window.partitionBy(*keys).orderBy("ord")
    left = calls.withColumn("n", F.row_number().over(order).cast("long")).select(*keys, "n", F.col("span_id").alias("call_id"))
    right = results.withColumn("n", F.row_number().over(order).cast("long")).select(*keys, "n", F.col("span_id").alias("result_id"))
    return left.join(right, [*keys, "n"], "left").select(*keys, "n", "call_id", "result_id")


def last_per_group(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n latest rows of each key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("start_us"), F.desc("ord"))).cast("long")).filter(F.col("rank") <= n)


def model_calls(rows: DataFrame) -> DataFrame:
    """Consecutive rows with the same cumulative usage are one call."""
    order = Window.partitionBy("trace_id").orderBy("ord")
    signature = F.concat_ws("/", F.coalesce(F.col("model"), F.lit("-")), F.col("args"))
    changed = F.coalesce(signature != F.lag(signature).over(order), F.lit(True))
    return rows.withColumn("changed", changed).groupBy("trace_id").agg(F.count_if("changed").alias("model_calls"), F.count("*").alias("rows"))


def latest_task(rows: DataFrame) -> DataFrame:
    """Rows of the latest task of each trace; a task starts with a model call."""
    order = Window.partitionBy("trace_id").orderBy("ord")
    tasks = rows.withColumn("task", F.sum((F.col("kind") == "LLM").cast("int")).over(order))
    return tasks.withColumn("last", F.max("task").over(Window.partitionBy("trace_id"))).filter("task = last").groupBy("trace_id").agg(F.max("task").alias("task"), F.count("*").alias("rows"))
