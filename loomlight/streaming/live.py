"""Live sessions on Structured Streaming: first sight, windows, whole-session rules, alerts that only grow.

The rules are those of the batch (operators.findings.live_rules). session_events() keeps what
they need of each session as state and forgets a session that has been idle; watch_sessions() reads the
whole history of the sessions that a micro-batch touched again, so that any rules can be given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.findings import live_rules


#: How long after its last file a folder counts as active, and the least time between two looks.
ACTIVE_WINDOW, LEAST_INTERVAL_MS = "30 minutes", 250


def follow(spark: SparkSession, path: str, schema: StructType | str, max_files: int = 100, active: str | None = None) -> DataFrame:
    """JSON lines of a folder as a stream; a trigger takes so many new files at most. active: files older than the newest by more than this are passed over."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return (reader.option("maxFileAge", active) if active else reader).json(path)


def unseen(spans: DataFrame, time: str = "ts", delay: str = "30 minutes", keys: tuple[str, ...] = ("harness", "session_id", "span_id")) -> DataFrame:
    """Spans not met before; a key is forgotten when the watermark has passed it."""
    return spans.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, delay: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts of tumbling or sliding windows; late rows count until the watermark passes their window."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", delay).groupBy(window, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def session_counts(events: DataFrame, gap: str, delay: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Sessions of a key that a gap ends."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))


def _row(names: list[str], *values: object) -> Row:
    return Row(**dict(zip(names, values, strict=True)))


def _clear(*states: object) -> None:
    for state in states:
        state.clear()


class Growth(StatefulProcessor):
    """The largest value of a key so far; a row for each larger one. A key is forgotten after the TTL."""

    def __init__(self, keys: list[str], value: str, ttl_ms: int | None) -> None:
        self.keys, self.value, self.ttl_ms = keys, value, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.most = handle.getValueState("most", "most long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        most = max((r[self.value] for r in rows if r[self.value] is not None), default=None)
        if most is not None and (not self.most.exists() or most > self.most.get()[0]):
            self.most.update((most,))
            yield _row([*self.keys, self.value], *key, most)


#: Spark's store for state of several variables.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, with the state store that these streams need; a session setting, so the caller decides."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


def growing(counts: DataFrame, keys: list[str], value: str, ttl_ms: int | None = 24 * 3_600_000) -> DataFrame:
    """Rows whose value is larger than any before of their key: alerts when a loop grows, not when it is seen again. Needs with_state_store()."""
    names = ", ".join(f"{k} {counts.schema[k].dataType.simpleString()}" for k in keys)
    return counts.groupBy(*keys).transformWithState(Growth(keys, value, ttl_ms), f"{names}, {value} long", "append", "ProcessingTime")


_EVENT = "trace_id string, event string, rule string, severity string, n double, subject string"
_EVENT_NAMES = [x.split()[0] for x in _EVENT.split(", ")]
#: What is known of a session: calls, failed calls, and where its latest edit, claim and check stand.
_TOTALS = "tools long, errors long, edit_us long, edit_ord long, claim_us long, claim_ord long, verify_us long, spans long, last_ms long"


def _digest(*parts: str | None) -> str:
    return hashlib.sha256("\0".join(x or "" for x in parts).encode()).hexdigest()[:16]


class SessionRules(StatefulProcessor):
    """The four live rules of a session, kept up to date by what arrives, in any order.

    State of a session: totals; the checks since its latest edit; how often each failing
    command came; the spans and findings that were met before. All of it goes when the
    watermark has passed the session's last span by idle_ms.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", _TOTALS)
        self.checks = handle.getListState("checks", "us long, ord long")
        self.failing = handle.getMapState("failing", "command string", "n long")
        self.seen = handle.getMapState("seen", "ord long", "yes boolean")
        self.emitted = handle.getMapState("emitted", "finding string", "yes boolean")

    def _findings(self, t: dict, checks: list, failed: dict[str, int]) -> Iterator[tuple[str, str, float, str]]:
        """rule, severity, n, subject."""
        for command, n in failed.items():
            if n >= 2:
                yield "same-failing-command", "high" if n >= 3 else "medium", float(n), command
        if len(checks) >= 2:
            yield "verification-without-change", "high" if len(checks) >= 3 else "medium", float(len(checks)), ""
        if t["claim_us"] is not None and (t["verify_us"] is None or t["verify_us"] <= t["claim_us"]):
            yield "claim-without-verification", "medium", 1.0, ""
        if t["tools"] >= 4 and t["errors"] / t["tools"] >= 0.5:
            rate = t["errors"] / t["tools"]
            yield "high-tool-error-rate", "high" if rate >= 0.75 else "medium", round(rate, 9), ""

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        names = [x.split()[0] for x in _TOTALS.split(", ")]
        first = not self.totals.exists()
        t = dict(zip(names, [0, 0, None, None, None, None, None, 0, 0] if first else self.totals.get(), strict=True))
        checks = [] if first else [tuple(x) for x in self.checks.get()]
        touched: dict[str, int] = {}
        for r in rows:
            if self.seen.containsKey((r.ord,)):
                continue
            self.seen.updateValue((r.ord,), (True,))
            at = (r.start_us, r.ord)
            t["spans"] += 1
            t["last_ms"] = max(t["last_ms"], r.start_us // 1000)
            if r.is_tool:
                t["tools"] += 1
                if r.status_code == "ERROR":
                    t["errors"] += 1
                    command = _digest(r.tool, r.content)
                    if command not in touched:
                        touched[command] = self.failing.getValue((command,))[0] if self.failing.containsKey((command,)) else 0
                    touched[command] += 1
            if r.action == "edit" and (t["edit_us"] is None or at > (t["edit_us"], t["edit_ord"])):
                t["edit_us"], t["edit_ord"] = at
            elif r.action == "verify":
                checks.append(at)
                t["verify_us"] = r.start_us if t["verify_us"] is None else max(t["verify_us"], r.start_us)
            elif r.action == "claim" and (t["claim_us"] is None or at > (t["claim_us"], t["claim_ord"])):
                t["claim_us"], t["claim_ord"] = at
        if t["edit_us"] is not None:
            checks = [c for c in checks if c > (t["edit_us"], t["edit_ord"])]
        self.totals.update(tuple(t[n] for n in names))
        self.checks.put(checks) if checks else self.checks.clear()
        for command, n in touched.items():
            self.failing.updateValue((command,), (n,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(t["last_ms"] + self.idle_ms)
        if first:
            yield _row(_EVENT_NAMES, key[0], "session", None, None, float(t["spans"]), None)
        for rule, severity, n, subject in self._findings(t, checks, touched):
            finding = _digest(rule, str(n), subject)
            if not self.emitted.containsKey((finding,)):
                self.emitted.updateValue((finding,), (True,))
                yield _row(_EVENT_NAMES, key[0], "finding", rule, severity, n, subject)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        spans = float(self.totals.get()[7])
        _clear(self.totals, self.checks, self.failing, self.seen, self.emitted)
        yield _row(_EVENT_NAMES, key[0], "idle", None, None, spans, None)


def session_events(actions: DataFrame, idle: int = 30 * 60_000, delay: str = "10 minutes") -> DataFrame:
    """What happens to sessions, as a stream: their first sight, each new finding, and their end after idle milliseconds without a span.

    actions: trace_id, ord (a span's identity in its session), start_us, tool, content,
    status_code, is_tool, action. Findings equal those of the batch over all that has come;
    one goes out again only when its number changes. Needs with_state_store().
    """
    timed = actions.withColumn("ts", F.timestamp_micros("start_us")).withWatermark("ts", delay)
    return timed.groupBy("trace_id").transformWithState(SessionRules(idle), _EVENT, "append", "EventTime")


def ticked(events: DataFrame, emit: Callable[[DataFrame, dict], None], checkpoint: str, once: bool = False, every_ms: int = 5000) -> StreamingQuery:
    """Gives each micro-batch of session_events() to emit, with a tick: its number and how many sessions, findings and ended sessions it has."""

    def batch(rows: DataFrame, number: int) -> None:
        counts = {r.event: r["count"] for r in rows.groupBy("event").count().collect()}  # three kinds
        emit(rows, {"batch": number, "sessions": counts.get("session", 0), "findings": counts.get("finding", 0), "idle": counts.get("idle", 0)})

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(LEAST_INTERVAL_MS, every_ms)} milliseconds")).start()


def watch_sessions(actions: DataFrame, store: str, emit: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, every: str = "5 seconds", rules: Callable[[DataFrame], DataFrame] = live_rules) -> StreamingQuery:
    """Runs the rules over each touched session's whole history and emits findings not emitted before.

    store: folder of two tables, the actions by session and the findings that went out. Both
    are written by batch id, so a batch that runs again replaces its own rows.
    """
    spark = actions.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        rows.write.mode("overwrite").parquet(f"{store}/actions/batch={number}")
        touched = rows.select("trace_id").distinct()
        history = spark.read.parquet(f"{store}/actions").filter(F.col("batch") <= number).drop("batch").join(touched, "trace_id", "left_semi")
        found = rules(history).withColumn("finding", F.substring(F.sha2(F.concat_ws("\0", "trace_id", "rule", F.col("n").cast("string")), 256), 1, 16))
        try:
            out = spark.read.parquet(f"{store}/emitted").filter(F.col("batch") < number).select("finding")
            found = found.join(out, "finding", "left_anti")
        except Exception as missing:  # nothing went out yet
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
        found.write.mode("overwrite").parquet(f"{store}/emitted/batch={number}")
        emit(spark.read.schema(found.schema).parquet(f"{store}/emitted/batch={number}"), number)

    writer = actions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def replayed(actions: DataFrame) -> DataFrame:
    """The batch version: the findings of every session."""
    return live_rules(actions)
