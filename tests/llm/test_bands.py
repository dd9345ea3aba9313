"""Bands and verdicts of the quality rules by brute force, from the scores of all documents."""

import math

import pytest

from loomlight.llm import quality_rules


def at(values, share):
    return sorted(values)[max(math.ceil(share * len(values)) - 1, 0)]


def test_bands_and_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = [r.asDict() for r in quality_rules.score(docs, quality_rules.train(docs)).collect()]
    groups = {}
    for r in scored:
        if not r["base_failed"]:
            groups.setdefault(r["language_group"], []).append(r)
    limits = {}
    for g, rows in groups.items():
        w, s = ([at([r[c] for r in rows], q) for q in (0.25, 0.5, 0.75)] for c in ("log_perplexity", "symbol_perplexity"))
        reach = lambda a, b: quality_rules.SPREAD * max(abs(a - b), quality_rules.LEAST)
        limits[g] = (w[1] + reach(w[2], w[1]), s[1] - reach(s[0], s[1]), s[1] + reach(s[2], s[1]))
    expected = {}
    for r in scored:
        up, low, high = limits.get(r["language_group"], (0, 0, 0))
        expected[r["doc_id"]] = not r["base_failed"] and r["log_perplexity"] <= up and low <= r["symbol_perplexity"] <= high
    found = {r.doc_id: r.kept for r in quality_rules.rule_report(docs).collect()}
    assert found == expected and {True, False} <= set(found.values())
    stayed = {r.doc_id for r in quality_rules.keep_good(docs).collect()}
    assert stayed == {i for i, kept in expected.items() if kept}


def test_texts_of_two_languages_count_by_their_pieces(spark):
    import random

    r = random.Random(2)
    words = {lang: ["".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(80)] for lang, letters in (("en", "abcdefghij"), ("fr", "qrstuvwxyz"))}
    prose = lambda lang, n=150: " ".join(r.choices(words[lang], k=n))
    rows = [(i, prose("en"), "en") for i in range(50)] + [(100 + i, prose("fr"), "fr") for i in range(50)] + [(200, prose("en") + " " + prose("fr"), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = quality_rules.train(docs)
    group = quality_rules.GROUPS.index("en")
    import numpy as np

    alone = model.log_perplexities([rows[-1][1]], np.array([group]))[0]
    mixed = model.mixed_log_perplexities([rows[-1][1]], group)[0]
    usual = model.mixed_log_perplexities([rows[0][1]], group)[0]
    assert mixed < alone and mixed == pytest.approx(usual, abs=0.25)
