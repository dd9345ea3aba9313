"""Lines of files that several tasks read, against a plain reader: numbers, offsets, digests, odd endings."""

import hashlib
import json
import random

import pytest

from loomlight.sources import lines as L
from loomlight.sources import readers

R = random.Random(4)


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few kB, as of files thousands of times as large."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def plain(path):
    """line, offset, raw, terminated as a reader of the whole file has them."""
    content, offset, out = path.read_bytes(), 0, []
    skip = 3 if content.startswith(b"\xef\xbb\xbf") else 0
    content, offset = content[skip:], skip
    parts = content.split(b"\n")
    ended = parts[-1] == b""
    for i, raw in enumerate(parts[:-1] if ended else parts):
        out.append((i + 1, offset, raw, ended or i + 1 < len(parts)))
        offset += len(raw) + 1
    return out


def found(spark, path):
    return sorted((r.line, r.byte_offset, bytes(r.raw), r.terminated) for r in L.physical_lines(spark, str(path)).collect())


def test_lines_of_many_blocks(small_blocks, tmp_path):
    spark = small_blocks
    bodies = {
        "a": b"".join(b"x" * R.choice([0, 1, 50, 5000]) + R.choice([b"\n", b"\r\n"]) for _ in range(400)),
        "b": "\n".join("é中" * R.randint(0, 300) for _ in range(200)).encode(),
        "c": b"\xef\xbb\xbf" + b"".join(b"line %d\n" % i for i in range(3000)),
        "d": b"\xef\xbb\xbfone\r\ntwo",
        "e": b"\n\n\n",
        "f": b"only",
        "g": b"\xff\xfe\n" * 2000 + b"\r",
        "h": b"y" * 60_000 + b"\nz",
        "i": b"",
    }
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
        assert found(spark, tmp_path / name) == plain(tmp_path / name), name
    (tmp_path / "all").mkdir()
    for name, body in bodies.items():
        (tmp_path / "all" / name).write_bytes(body)
    rows = L.physical_lines(spark, str(tmp_path / "all"))
    assert rows.rdd.getNumPartitions() > 8
    by_file = {}
    for r in rows.collect():
        by_file.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line, r.byte_offset, bytes(r.raw), r.terminated))
    assert {k: sorted(v) for k, v in by_file.items()} == {k: plain(tmp_path / k) for k in bodies if k != "i"}


def test_a_large_session_is_read_by_several_tasks(spark, tmp_path):
    """Two hundred spans between long lines; all tasks together see what one reader sees."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 << 20))
    try:
        path = tmp_path / "big.jsonl"
        with path.open("w") as out:
            for i in range(203):
                out.write(json.dumps({"trace_id": "t" * 32, "span_id": f"s{i}", "name": "x", "attributes": {"content": "y" * 200_000}}) + "\n")
                if i % 50 == 0:
                    out.write("{broken\n\n")
        good, bad = readers.read_spans(spark, str(path))
        assert good.rdd.getNumPartitions() > 8
        expected = {r[0]: r for r in plain(path)}
        spans = good.select("span_id", "line").collect()
        assert len(spans) == 203 and all(json.loads(expected[r.line][2])["span_id"] == r.span_id for r in spans)
        receipts = L.corruption_receipts(spark, str(path)).collect()
        assert sorted((r.line, r.byte_offset, r.sha256, r.reason) for r in receipts) == [(n, o, hashlib.sha256(raw).hexdigest(), "not JSON") for n, o, raw, _ in expected.values() if raw == b"{broken"]
        assert sorted(r.line for r in bad.collect()) == sorted(r.line for r in receipts)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_strict_and_first_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('\n{"a":1}\r\n{broken\n[2]\n3')
    assert [(r.line, r.v.toJson()) for r in L.json_lines(spark, str(path)).orderBy("line").collect()] == [(2, '{"a":1}'), (4, "[2]"), (5, "3")]
    with pytest.raises(Exception, match=r"malformed JSON: .*a\.jsonl:3"):
        L.json_lines(spark, str(path), strict=True).collect()
    assert [r.value for r in L.first_json(spark, str(path), 2).collect()] == ['{"a":1}', "[2]"]
    assert L.first_json(spark, str(path), 9).count() == 3


def test_bindings_tell_order_and_endings(spark, tmp_path):
    digests = set()
    for i, body in enumerate([b"a\nb\n", b"b\na\n", b"a\nb", b"a\nb\n\n", b"a\r\nb\n"]):
        path = tmp_path / "x"
        path.write_bytes(body)
        spark.catalog.refreshByPath(str(path))
        ((digest,),) = L.source_binding(spark, str(path)).select("sha256").collect()
        digests.add(digest)
        assert len(digests) == i + 1


def test_unterminated_line_of_a_journal_is_dropped(spark, tmp_path):
    path = tmp_path / "j"
    path.write_text('{"kind":"begin"}\n{"kind":"event","event":{"kind":"spawn","id":"a","parent":"r"}}\nnot json\n{"kind":"ev')
    rows = readers.journal_events(spark, str(path)).orderBy("line").collect()
    assert [(r.line, r.valid, r.id) for r in rows] == [(1, True, None), (2, True, "a"), (3, False, None)]
