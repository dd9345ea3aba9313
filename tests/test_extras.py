"""Receipts, sampling, registries, reports and the command line."""

import json

import numpy as np
import pytest

from loomlight.__main__ import main
from loomlight.operators import extras as E
from loomlight.sources import lines as L
from loomlight.plans.analysts import Registry, load_config

SPAN = {"trace_id": "t" * 32, "span_id": "a" * 16, "name": "x", "kind": "TOOL", "start_time": "2024-01-01T00:00:00Z", "end_time": "2024-01-01T00:00:01Z", "status": {"code": "STATUS_CODE_OK"}, "attributes": {"tool.name": "bash"}}


def test_receipts_name_lines_but_not_contents(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_bytes(b'{}\nsecret-value\r\n{}\n\xff\xfe\n')
    rows = L.corruption_receipts(spark, str(f)).orderBy("line").collect()
    assert [(r.line, r.byte_offset, r.byte_length) for r in rows] == [(2, 3, 12), (4, 20, 2)]
    assert "secret" not in str(rows) and len({r.digest for r in E.integrity_spans(L.corruption_receipts(spark, str(f))).collect()}) == 1
    before = L.source_binding(spark, str(f)).collect()
    f.write_bytes(b"{}\n")
    assert E.changed_sources(spark.createDataFrame(before), L.source_binding(spark, str(f))).count() == 1


def test_truncation_between_characters(spark):
    df = spark.createDataFrame([("é" * 10,), ("abc",)], "x string")
    rows = [r.t for r in df.select(E.truncated(df.x, 5).alias("t")).collect()]
    assert [(r.value, r.bytes, r.truncated) for r in rows] == [("éé", 20, True), ("abc", 3, False)]


def test_lifecycle_opens_again(spark):
    rows = [("a", i, e) for i, e in enumerate(["completed", "started", "failed", "completed", "started"])] + [("b", 0, "completed")]
    found = {r.trace_id: (r.state, r.starts) for r in E.lifecycles(spark.createDataFrame(rows, "trace_id string, ord int, event string").repartition(3)).collect()}
    assert found == {"a": ("started", 2), "b": ("none", 0)}


def test_sample_depends_on_the_seed_alone(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    a, b, c = ({r.k for r in E.seeded_sample(x, "k", s, 20).collect()} for x, s in ((rows, 1), (rows.repartition(7), 1), (rows, 2)))
    assert a == b != c and len(a) == 20


def test_distinct_behaviours_are_far_apart(spark):
    r = np.random.default_rng(0)
    rows = [(i, i % 2, [float(x) for x in (r.normal(size=3) * 0.01 + 10 * (i // 2 % 4))]) for i in range(80)]
    found = E.distinct_behaviours(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), 4, block=30).collect()
    for label in (0, 1):
        assert {r.vec_id // 2 % 4 for r in found if r.label == label} == {0, 1, 2, 3}


def test_registry_and_config(spark, tmp_path):
    spans = spark.createDataFrame([("t",)], "trace_id string").selectExpr("trace_id", "'r' as rule", "'low' as severity")
    reg = Registry({"base": lambda s: s})
    assert [r.analyst for r in reg.run(spans).collect()] == ["base"]
    reg.register("mine", lambda s: s)
    assert [r.analyst for r in reg.run(spans).collect()] == ["mine"]
    assert {r.analyst for r in reg.run(spans, with_built_in=True).collect()} == {"base", "mine"}
    with pytest.raises(ValueError):
        reg.register("mine", lambda s: s)
    (tmp_path / "c.py").write_text("analysts = {'x': 1}\n")
    assert load_config(str(tmp_path / "c.py")) == {"analysts": {"x": 1}}


def test_command_line(spark, tmp_path, capsys):
    f = tmp_path / "a.jsonl"
    f.write_text("".join(json.dumps(SPAN | {"span_id": f"{i:016x}"}) + "\n" for i in range(3)))
    assert main(["validate", str(f)]) == 0 and "flat-hierarchy" in capsys.readouterr().out
    assert main(["analyze", str(f)]) == 0 and "| bash | 3 | 0 |" in capsys.readouterr().out
    assert main(["export", str(f), "--out", str(tmp_path / "out")]) == 0
    (tmp_path / "b.jsonl").write_text('{"hello": 1}\n')
    assert main(["validate", str(tmp_path / "b.jsonl")]) == 1
