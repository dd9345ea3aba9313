"""Credentials that only the automata find: of each public format, and of a kind learned from a table."""

import random

import pytest

from loomlight.llm import secret_scan

R = random.Random(5)


def scanned(spark, texts, models=None):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return {r.doc_id: r.spans for r in secret_scan.scan(rows, models).collect()}


@pytest.mark.parametrize("kind", [k for k in secret_scan.FORMATS if k != "aws_access_key"])
def test_each_format_is_found_without_the_base(kind):
    models = secret_scan.automata()
    for _, s in [x for x in secret_scan.labelled(20, seed=99) if x[0] == kind]:
        text = f"see {s}, then go on"
        base, every = secret_scan.all_spans(text, models)
        assert base == [] and [(a, b) for a, b, _ in every] == [(4, 4 + len(s))], s


def test_kind_of_a_table(spark):
    make = lambda: "corp-" + "".join(R.choices("0123456789abcdef", k=8)) + "-" + "".join(R.choices("QRSTUVWXYZ", k=12))
    rows = [("corp", make()) for _ in range(60)] * 2 + [(None, "x"), ("corp", None)]
    models = secret_scan.models_of(spark.createDataFrame(rows, "kind string, credential string"))
    assert list(models) == ["corp"]
    new = [make() for _ in range(10)]
    found = scanned(spark, [f"key {s} here" for s in new] + ["corp-notes-and-more-words", "plain words of prose and more of them", "", None], models)
    assert [found[i] for i in range(10)] == [f"corp:4:{4 + len(s)}" for s in new]
    assert [found[i] for i in range(10, 14)] == ["", "", "", ""]


def test_redaction_merges_overlapping_spans():
    spans = [(0, 5, "assign"), (3, 9, "hex"), (9, 12, "access"), (20, 22, "hex")]
    text = "abcdefghijklmnopqrstuvwxyz"
    covered = {i for a, b, _ in spans for i in range(a, b)}
    plain = "".join("\0" if i in covered else c for i, c in enumerate(text))
    assert secret_scan.without(text, spans, "\0").replace("\0\0", "\0") == "\0mnopqrst\0wxyz"
    assert [x for x in plain.split("\0") if x] == [x for x in secret_scan.without(text, spans, "\0").split("\0") if x]
