"""Strict reader of event streams of one run: a stream that doesn't keep to its life cycle gives no rows, but a reason.

A stream is a file of JSON lines: thread.started once and first, then turns, each with items, each
turn closed by turn.completed, turn.failed or error. Lines that are no such events are counted,
not refused. The state before each line comes from windows over its file, so a stream of any length
is read by Spark's sort and never held by a function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import capped, instant, iso_to_epoch_ms
from .lines import json_lines

# Events of the stream, kinds of items with their tools, and where an event may tell its time.
EVENTS = ["thread.started", "turn.started", "turn.completed", "turn.failed", "item.started", "item.completed", "error"]
TOOLS = {"command_execution": "exec_command", "file_change": "apply_patch"}
TIMES = ["timestamp", "created_at", "started_at", "completed_at", "timestamp_ms", "started_at_ms", "completed_at_ms"]
_CLOSING = ["turn.completed", "turn.failed", "error"]


def _events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    get = lambda p, kind="string": F.try_variant_get("v", f"$.{p}", kind)
    times = [F.coalesce(F.when(get(t, "double").isNotNull(), instant(get(t, "double"))), iso_to_epoch_ms(get(t))) for t in TIMES]
    rows = json_lines(spark, path).select(
        "file", "line", get("type").alias("type"), get("thread_id").alias("thread_id"), get("item.id").alias("id"), get("item.type").alias("item_type"), get("item.status").alias("item_status"),
        F.coalesce(*times).alias("ts_ms"), get("item.exit_code", "bigint").alias("exit_code"), get("item.command").alias("command"), F.to_json(get("item.changes", "variant")).alias("changes"), get("item.changes[0].path").alias("changed"),
        get("item.aggregated_output").alias("output"), get("item.text").alias("text"), F.coalesce(get("item.message"), get("error.message"), get("message")).alias("message"),
        *(get(f"usage.{n}", "bigint").alias(n) for n in ("input_tokens", "output_tokens")), *((get(f"usage.{n}").isNotNull() & F.coalesce(get(f"usage.{n}", "bigint") < 0, F.lit(True))).alias(f"bad_{n}") for n in ("input_tokens", "output_tokens")),
    )
    known = rows.withColumn("known", F.coalesce(F.col("type").isin(*EVENTS), F.lit(False)))
    own = Window.partitionBy("file", "known").orderBy("line")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col("type") == "turn.started", F.lit("turn.started")).when(F.col("type").isin(*_CLOSING), F.lit("closed"))
    return (
        known.withColumn("n", F.row_number().over(own))
        .withColumn("active", F.coalesce(F.last(at, ignorenulls=True).over(before) == "turn.started", F.lit(False)))
        .withColumn("turn", F.count_if(F.col("type") == "turn.started").over(own.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        .withColumn("tool", F.when(F.col("type").isin("item.started", "item.completed"), F.try_element_at(F.create_map(*(F.lit(x) for p in TOOLS.items() for x in p)), F.col("item_type"))))
    )


def _line_faults(e: DataFrame) -> DataFrame:
    """file, line, reason of events that can't stand where they do."""
    kind, tool, done = F.col("type"), F.col("tool").isNotNull(), F.col("type") == "item.completed"
    faults = [
        ((kind == "thread.started") & (F.col("n") > 1), "thread.started is not the first event"),
        ((kind != "thread.started") & (F.col("n") == 1), "an event came before thread.started"),
        ((kind == "thread.started") & F.coalesce(F.col("thread_id") == "", F.lit(True)), "thread.started has no thread_id"),
        ((kind == "turn.started") & F.col("active"), "turn.started came before the prior turn ended"),
        (kind.isin("item.started", "item.completed", "turn.completed", "turn.failed") & ~F.col("active"), "an event of a turn came without an active turn"),
        ((tool | (done & F.col("item_type").isin("agent_message", "error"))) & F.coalesce(F.col("id") == "", F.lit(True)), "an item has no id"),
        (tool & (kind == "item.started") & F.coalesce(F.col("item_status") != "in_progress", F.lit(False)), "a started item is not in progress"),
        (tool & done & ~F.coalesce(F.col("item_status").isin("completed", "failed"), F.lit(False)), "a completed item is neither completed nor failed"),
        ((F.col("item_type") == "command_execution") & tool & F.coalesce(F.col("command") == "", F.lit(True)), "a command has no text"),
        ((F.col("item_type") == "file_change") & tool & F.coalesce(F.col("changed") == "", F.lit(True)), "a change of files names no file"),
        (kind.isin("turn.failed", "error") & F.coalesce(F.col("message") == "", F.lit(True)), "a failure has no message"),
        ((kind == "turn.completed") & (F.col("bad_input_tokens") | F.col("bad_output_tokens")), "usage is no count of tokens"),
    ]
    reason = F.coalesce(*(F.when(test, F.lit(text)) for test, text in faults))
    return e.filter("known").select("file", "line", reason.alias("reason")).filter("reason is not null")


def _item_faults(e: DataFrame) -> DataFrame:
    """The same between the lines of an item: told twice, of another type, or still open when its turn completes."""
    started, completed = F.col("type") == "item.started", F.col("type") == "item.completed"
    told = e.filter("known and active and (tool is not null or (type = 'item.completed' and item_type in ('agent_message', 'error')))")
    items = told.groupBy("file", "turn", "id").agg(
        F.count_if(started).alias("starts"), F.count_if(completed).alias("ends"), F.countDistinct("item_type").alias("types"), F.max("line").alias("line"),
        F.min(F.when(completed, F.col("line"))).alias("first_end"), F.max(F.when(started, F.col("line"))).alias("last_start"),
    )
    closed = e.filter("known and type = 'turn.completed'").select("file", "turn").distinct().withColumn("completed", F.lit(True))
    reason = (
        F.when((F.col("starts") > 1) | (F.col("first_end") < F.col("last_start")), "an item started more than once")
        .when(F.col("ends") > 1, "an item completed more than once")
        .when(F.col("types") > 1, "an item changed its type")
        .when((F.col("starts") > 0) & (F.col("ends") == 0) & F.col("completed"), "a turn completed with an open item")
    )
    return items.join(closed, ["file", "turn"], "left").select("file", "line", reason.alias("reason")).filter("reason is not null")


def _stream_faults(e: DataFrame) -> DataFrame:
    """The same of whole streams: without any event, still in a turn at their end, or without an end."""
    last = F.max(F.when(F.col("known"), F.struct("line", "type", "active")))
    rows = e.groupBy("file").agg(F.count_if("known").alias("events"), F.max("line").alias("line"), last.alias("last"), F.count_if(F.col("known") & F.col("type").isin(*_CLOSING)).alias("ends"))
    open_turn = (F.col("last.type") == "turn.started") | (F.col("last.active") & ~F.col("last.type").isin(*_CLOSING))
    reason = F.when(F.col("events") == 0, "no event of a run").when(open_turn, "the stream ended in a turn").when(F.col("ends") == 0, "the stream has no end")
    return rows.select("file", "line", reason.alias("reason")).filter("reason is not null")


def rejections(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line, reason: the first fault of each stream that breaks its life cycle."""
    e = _events(spark, path)
    every = _line_faults(e).union(_item_faults(e)).union(_stream_faults(e))
    return every.groupBy("file").agg(F.min(F.struct("line", "reason")).alias("f")).select("file", "f.line", "f.reason")


def codex_exec(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows in the shape of session logs, of the streams that keep to their life cycle."""
    from .sessions import shaped

    e = _events(spark, path)
    threads = e.filter("known and type = 'thread.started'").groupBy("file").agg(F.min("thread_id").alias("trace_id"))
    good = e.filter("known").join(rejections(spark, path).select("file"), "file", "left_anti").join(threads, "file")
    row = lambda kind, **columns: [F.col("trace_id"), F.col("line").alias("ord"), F.lit(kind).alias("kind"), F.col("ts_ms"), *(c.alias(n) for n, c in columns.items())]
    code = F.col("exit_code")
    failed: Column = (F.col("item_status") == "failed") | F.coalesce(code != 0, F.lit(False))
    interrupted = good.filter("type = 'turn.failed' or type = 'error'").select("file", "turn", F.lit(True).alias("interrupted")).distinct()
    ended = good.filter("type = 'item.completed'").select("file", "turn", "id")
    tools = good.filter("tool is not null and type = 'item.completed'").select(*row("TOOL", tool=F.col("tool"), call_id=F.concat_ws(":", "turn", "id"), arguments=F.coalesce("command", "changes"), output=F.col("output"), failed=failed))
    unfinished = good.filter("tool is not null and type = 'item.started'").join(ended, ["file", "turn", "id"], "left_anti").join(interrupted, ["file", "turn"])
    cut = unfinished.select(*row("TOOL", tool=F.col("tool"), call_id=F.concat_ws(":", "turn", "id"), arguments=F.coalesce("command", "changes"), failed=F.lit(True)))
    said = good.filter("type = 'item.completed' and item_type = 'agent_message' and text <> ''").select(*row("CHAIN", role=F.lit("assistant"), content=capped("text")))
    turns = good.filter("type in ('turn.completed', 'turn.failed') or (type = 'error' and active)").select(*row("LLM", role=F.lit("assistant"), input_tokens=F.col("input_tokens"), output_tokens=F.col("output_tokens"), failed=F.col("type") != "turn.completed"))
    errors = good.filter("type = 'error' or (type = 'item.completed' and item_type = 'error')").select(*row("CHAIN", failed=F.lit(True), content=capped("message")))
    parts = [shaped(x) for x in (tools, cut, said, turns, errors)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
