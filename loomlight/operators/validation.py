"""Findings about the spans themselves, capabilities that they block, and faithful export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written
from .graphs import cycles

# Finding codes with severity and the capabilities that each blocks.
CODES = {
    "no-spans": ("error", ["all"]),
    "invalid-input": ("error", ["all"]),
    "invalid-span": ("error", ["all"]),
    "truncated-input": ("warn", []),
    "duplicate-span-id": ("warn", ["cost-attribution"]),
    "redeclared-span": ("info", []),
    "non-hex-id": ("info", []),
    "missing-trace-id": ("warn", ["cost-attribution"]),
    "orphan-parent": ("warn", ["cost-attribution"]),
    "cyclic-parent": ("warn", ["cost-attribution"]),
    "cross-trace-parent": ("warn", ["cost-attribution"]),
    "flat-hierarchy": ("warn", ["cost-attribution"]),
    "invalid-timestamp": ("warn", ["latency-analysis"]),
    "negative-duration": ("warn", ["latency-analysis"]),
    "invalid-status": ("warn", []),
    "unknown-span-kind": ("warn", []),
    "missing-model": ("warn", ["cost-attribution"]),
    "no-usage": ("warn", ["token-accounting"]),
    "missing-tool-name": ("warn", ["tool-usage"]),
    "dangling-link": ("warn", ["steering-chain"]),
}
CAPABILITIES = ["token-accounting", "cost-attribution", "tool-usage", "loop-convergence", "tree-comparison", "steering-chain", "latency-analysis"]
KINDS = ["AGENT", "CHAIN", "LLM", "TOOL", "EVALUATOR", "RETRIEVER", "UNKNOWN"]
#: Entries that one validation looks at.
BOUND = 250_000


def row_findings(spans: DataFrame) -> DataFrame:
    """code, spans: how often each defect that shows in a row alone occurs. One pass over the spans."""
    tests = {
        "non-hex-id": ~F.coalesce(F.col("trace_id").rlike("^[0-9a-f]{32}$") & F.col("span_id").rlike("^[0-9a-f]{16}$"), F.lit(False)),
        "missing-trace-id": F.coalesce(F.trim("trace_id"), F.lit("")) == "",
        "invalid-timestamp": F.col("start_us").isNull() | F.col("end_us").isNull(),
        "negative-duration": F.col("end_us") < F.col("start_us"),
        "invalid-status": F.col("status_code").isNull() | ~F.col("status_code").isin("OK", "ERROR", "UNSET"),
        "unknown-span-kind": ~F.col("kind").isin(*KINDS),
        "missing-model": (F.col("kind") == "LLM") & F.col("model").isNull(),
        "no-usage": (F.col("kind") == "LLM") & F.col("input_tokens").isNull() & F.col("output_tokens").isNull(),
        "missing-tool-name": (F.col("kind") == "TOOL") & F.col("tool").isNull(),
    }
    counts = spans.agg(*(F.count_if(t).alias(c) for c, t in tests.items()))
    rows = F.explode(F.map_from_arrays(F.array(*map(F.lit, tests)), F.array(*(F.col(f"`{c}`") for c in tests))))
    return counts.select(rows.alias("code", "spans")).filter("spans > 0")


def structure_findings(spans: DataFrame) -> DataFrame:
    """code, spans for defects between rows: parents, runs, repeats, links."""
    ids = spans.groupBy("span_id").agg(F.countDistinct("trace_id").alias("in_runs"), F.count("*").alias("n"), F.min("trace_id").alias("a_trace"))
    parents = ids.select(F.col("span_id").alias("parent_span_id"), "in_runs", "a_trace")
    children = spans.filter("parent_span_id is not null").select("trace_id", "parent_span_id").join(parents, "parent_span_id", "left")
    by_parent = children.agg(F.count_if(F.col("in_runs").isNull()).alias("orphan-parent"), F.count_if((F.col("in_runs") == 1) & (F.col("a_trace") != F.col("trace_id"))).alias("cross-trace-parent"))
    repeats = ids.agg(F.count_if(F.col("in_runs") > 1).alias("duplicate-span-id"), F.count_if((F.col("in_runs") == 1) & (F.col("n") > 1)).alias("redeclared-span"))
    flat = spans.groupBy("trace_id").agg(F.count("*").alias("n"), F.count("parent_span_id").alias("edges")).agg(F.count_if((F.col("n") > 1) & (F.col("edges") == 0)).alias("flat-hierarchy"))
    links = spans.filter("link_span_id is not null").select(F.col("link_span_id").alias("span_id")).join(ids.select("span_id", "n"), "span_id", "left").agg(F.count_if(F.col("n").isNull()).alias("dangling-link"))
    one = [by_parent, repeats, flat, links]
    long = [t.select(F.lit(c).alias("code"), F.col(f"`{c}`").alias("spans")) for t in one for c in t.columns]
    return reduce(DataFrame.union, long).filter("spans > 0")


def window(spans: DataFrame, order: list[str], bound: int = BOUND) -> tuple[DataFrame, DataFrame]:
    """The first entries in input order, as many as one validation looks at, and truncated-input with the number of the others."""
    rest = spans.agg(F.greatest(F.count("*") - bound, F.lit(0)).alias("spans")).filter("spans > 0")
    return spans.orderBy(*order).limit(bound), rest.select(F.lit("truncated-input").alias("code"), "spans")


def cyclic_parents(spans: DataFrame) -> DataFrame:
    """code, spans: how many spans are their own ancestors within their run."""
    node = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("\0", "trace_id", c))
    ring = cycles(spans.select(node("span_id").alias("node"), node("parent_span_id").alias("parent")).filter("node is not null").distinct())
    return ring.agg(F.countDistinct("node").alias("spans")).filter("spans > 0").select(F.lit("cyclic-parent").alias("code"), "spans")


def input_findings(entries: DataFrame) -> DataFrame:
    """code, spans of an input's entries (is_object, span_id): none at all, none that can be read, no spans among them, or some that are none."""
    span = F.col("is_object") & (F.coalesce(F.trim("span_id"), F.lit("")) != "")
    n = entries.agg(F.count("*").alias("n"), F.count_if("is_object").alias("objects"), F.count_if(span).alias("spans"))
    one = lambda code, holds, size: F.when(holds, F.struct(F.lit(code).alias("code"), size.alias("spans")))
    none = F.lit(0).cast("long")
    rows = F.array_compact(F.array(one("invalid-input", (F.col("n") > 0) & (F.col("objects") == 0), F.col("n")), one("no-spans", F.col("spans") == 0, none), one("invalid-span", F.col("n") > F.col("spans"), F.col("n") - F.col("spans"))))
    return n.select(F.inline(rows))


def described(found: DataFrame) -> DataFrame:
    """Adds severity and what each code blocks."""
    table = [(c, s, ",".join(b)) for c, (s, b) in CODES.items()]
    return found.join(F.broadcast(found.sparkSession.createDataFrame(table, "code string, severity string, blocks string")), "code")  # the fixed table of codes


def findings(spans: DataFrame) -> DataFrame:
    """code, severity, blocks, spans of all that the spans themselves show, over every one of them."""
    return described(row_findings(spans).union(structure_findings(spans)))


def validated(entries: DataFrame, order: list[str], bound: int = BOUND) -> DataFrame:
    """All codes over the first entries of an input: those of its shape, of rows, of structure, of cycles, and what was cut off.

    An entry that is no span blocks nothing while others are spans.
    """
    seen, cut = window(entries, order, bound)
    seen = written(seen)
    spans = seen.filter(F.col("is_object") & (F.coalesce(F.trim("span_id"), F.lit("")) != ""))
    shape = written(input_findings(seen))
    found = described(shape.union(row_findings(spans)).union(structure_findings(spans)).union(cyclic_parents(spans)).union(cut))
    some = (F.col("code") == "invalid-span") & ~F.col("nothing")
    nothing = shape.agg(F.coalesce(F.bool_or(F.col("code") == "no-spans"), F.lit(False)).alias("nothing"))
    marked = found.join(nothing, F.lit(True))  # one row
    return marked.select("code", "spans", F.when(some, "warn").otherwise(F.col("severity")).alias("severity"), F.when(some, "").otherwise(F.col("blocks")).alias("blocks"))


def capabilities(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """capability, available: there is evidence (capability, there) and no finding blocks it."""
    blocked = found.select(F.explode(F.when(F.col("blocks") == "all", F.array(*map(F.lit, CAPABILITIES))).otherwise(F.split("blocks", ","))).alias("capability")).filter("capability <> ''").distinct().withColumn("blocked", F.lit(True))
    rows = evidence.join(blocked, "capability", "left")
    return rows.select("capability", (F.col("there") & F.col("blocked").isNull()).alias("available"), F.when(F.col("blocked"), "blocked").when(~F.col("there"), "no evidence").alias("reason"))


# What each capability feeds, and whether a report has it.
ANALYSES = {
    "token-accounting": ("execution facts → Direct model usage (input/output/reasoning/cache token totals)", True),
    "cost-attribution": ("execution facts → Cost coverage (observed vs estimated USD)", True),
    "tool-usage": ("tool-usage table + per-tool duplicate/retry/error rates + stuck-loop detection", True),
    "loop-convergence": ("round-over-round convergence (did round N+1 improve on N)", True),
    "tree-comparison": ("arm-vs-arm comparison across branches of one run — NOT YET IMPLEMENTED in this package", False),
    "steering-chain": ("steering chain (which verdict caused which retry)", True),
    "latency-analysis": ("latency + critical-path timing distributions", True),
}


def gated(found: DataFrame) -> DataFrame:
    """capability, analysis, state and reason of each capability (capability, available, reason): available, unbuilt, or skipped for its reason."""
    table = found.sparkSession.createDataFrame([(c, a, b) for c, (a, b) in ANALYSES.items()], "capability string, analysis string, built boolean")
    rows = found.join(F.broadcast(table), "capability")  # the fixed table of capabilities
    state = F.when(~F.col("available"), "skipped").when(~F.col("built"), "unbuilt").otherwise("available")
    return rows.select("capability", "analysis", state.alias("state"), F.when(~F.col("available"), F.coalesce("reason", F.lit("no reason recorded"))).alias("reason"))


def evidence(spans: DataFrame) -> DataFrame:
    """capability, there: whether the spans hold anything to answer with."""
    tests = {
        "token-accounting": F.bool_or(F.col("input_tokens").isNotNull()),
        "cost-attribution": F.bool_or(F.col("cost_usd").isNotNull()),
        "tool-usage": F.bool_or(F.col("tool").isNotNull()),
        "loop-convergence": F.countDistinct("iteration") > 1,
        "tree-comparison": F.countDistinct("trace_id") > 1,
        "steering-chain": F.bool_or(F.col("link_span_id").isNotNull()),
        "latency-analysis": F.bool_or(F.col("end_us") > F.col("start_us")),
    }
    one = spans.agg(*(F.coalesce(t, F.lit(False)).alias(c) for c, t in tests.items()))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, tests)), F.array(*(F.col(f"`{c}`") for c in tests)))).alias("capability", "there"))


def strict(spans: DataFrame) -> DataFrame:
    """Rows that fail the strict gate, with the first reason."""
    reason = F.when(F.coalesce(F.trim("trace_id"), F.lit("")) == "", "trace id").when(F.coalesce(F.trim("span_id"), F.lit("")) == "", "span id").when(F.col("start_us").isNull() | F.col("end_us").isNull(), "timestamps").when(F.col("end_us") < F.col("start_us"), "duration").when(~F.col("status_code").isin("OK", "ERROR", "UNSET"), "status")
    return spans.withColumn("reason", reason).filter("reason is not null")


def withheld_ends(spans: DataFrame) -> DataFrame:
    """End times before the start are withheld, not repaired, and counted."""
    bad = F.col("end_us") < F.col("start_us")
    return spans.withColumn("withheld", bad).withColumn("end_us", F.when(~bad, F.col("end_us")))


def label_leaks(texts: DataFrame, labels: DataFrame, words: int = 8) -> DataFrame:
    """Texts that hold a label verbatim, lower-cased with single spaces.

    The words of a label between its first and last stand whole in every text that holds it,
    whatever is attached to the ends. So many of them at most are looked up by their hash,
    then the whole label is checked. Labels of one or two words are checked against every text.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[ \\t\\r\\n\\f]+", " "))
    known = labels.select("item_id", plain("text").alias("label")).filter("label <> ''")
    known = known.withColumn("w", F.split("label", " ")).withColumn("inner", F.least(F.size("w") - 2, F.lit(words)))
    rows = texts.select("doc_id", plain("text").alias("plain"))
    short = rows.join(known.filter("inner < 1").select("item_id", "label"), F.col("plain").contains(F.col("label")))
    known = known.filter("inner > 0").withColumn("head", F.xxhash64(F.array_join(F.slice(F.col("w"), F.lit(2), F.col("inner")), " "))).select("item_id", "label", "head")
    lengths = sorted(r[0] for r in labels.select(F.least(F.size(F.split(plain("text"), " ")) - 2, F.lit(words)).alias("n")).filter("n > 0").distinct().collect())  # 1 ... words
    tokens = rows.withColumn("w", F.split("plain", " "))
    run = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(n - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " ")))
    heads = F.concat(F.array().cast("array<bigint>"), *map(run, lengths))
    hits = tokens.select("doc_id", "plain", F.explode(F.array_distinct(heads)).alias("head")).join(known, "head")
    found = hits.filter(F.col("plain").contains(F.col("label"))).select("doc_id", "item_id")
    return found.union(short.select("doc_id", "item_id")).distinct()


#: Marks of labels in a trajectory: keys, a labels array, paths of annotations.
LABEL_MARKS = {
    "key": r"""(?i)\\?["'](?:incorrect_stages|incorrect_step_ids|unuseful_step_ids|annotation_relpath|incorrect_error_stage_count)\\?["']\s*:""",
    "array": r"""(?i)\\?["']labels\\?["']\s*:\s*\[[^\]]*\\?["'](?:incorrect|unuseful)\\?["']""",
    "path": r"(?i)(?:agent_failure_analysis|step_annotations(?:_all)?|merged_cleaned_step\d*)[\\/]",
}


def label_marks(texts: DataFrame) -> DataFrame:
    """doc_id, mark: texts that show a label's key, array or annotation path."""
    marks = F.array(*(F.when(F.col("text").rlike(p), F.lit(k)) for k, p in LABEL_MARKS.items()))
    return texts.select("doc_id", F.explode(F.array_compact(marks)).alias("mark"))
