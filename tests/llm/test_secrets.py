"""Secrets of every format inside texts, found by scan() and taken out by redact()."""

import random

from loomlight.llm import secret_scan

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"


def made(r, n):
    return "".join(r.choices(ALPHABET, k=n))


def test_every_format_within_a_text(spark):
    fresh = secret_scan.labelled(60, seed=99)
    frames = ["use {} now", "see {}.", "({})", "end.{} x", "{}", "a.b.{}.\nNext"]
    rows, at = [], {}
    for i, (kind, s) in enumerate(fresh):
        text = frames[i % len(frames)].format(s)
        rows.append((i, text))
        at[i] = (kind, text.index(s), text.index(s) + len(s))
    found = {r.doc_id: r.spans.split(",") for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = {k: [] for k, _ in fresh}
    for i, (kind, start, end) in at.items():
        spans = [x.split(":") for x in found[i] if x]
        whole[kind].append(any(int(a) <= start and end <= int(b) for _, a, b in spans))
    assert {k: sum(v) / len(v) >= 0.95 for k, v in whole.items()} == {k: True for k in secret_scan.FORMATS}, {k: sum(v) for k, v in whole.items()}


def test_json_web_tokens_of_ordinary_lengths(spark):
    r = random.Random(3)
    shapes = [(17, 40, 43), (33, 70, 43), (33, 250, 342), (90, 600, 342), (60, 1500, 342), (33, 120, 86), (90, 300, 683)]
    tokens = [f"eyJ{made(r, a)}.eyJ{made(r, b)}.{made(r, c)}" for a, b, c in shapes for _ in range(5)]
    rows = spark.createDataFrame([(i, f"bearer {t} end") for i, t in enumerate(tokens)], "doc_id long, text string")
    assert {x.text for x in secret_scan.redact(rows).collect()} == {"bearer [SECRET] end"}


def test_dotted_prose_is_kept(spark):
    texts = ["see www.example.org.some.long.host-name.net and org.apache.spark.sql.functions.regexp_replace", "a." * 50_000, "version 1.2.3-beta.4.5.6.7.8.9", "x" * 5000 + "." + "y" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not any(r.spans for r in secret_scan.scan(rows).collect())
