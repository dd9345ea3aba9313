"""The model of words behind the quality rules: order, unknown words, other scripts, counts over all rows, junk of marked words."""

import collections
import random

import numpy as np
import pytest

from loomlight.llm import quality_rules, word_model

R = random.Random(11)
WORDS = [a + b for a in ("ba", "co", "de", "fi", "lo", "mu", "pe", "su") for b in ("n", "r", "st", "m", "ga", "ti", "x", "lu")]
FOLLOWING = {w: R.sample(WORDS, 6) for w in WORDS}


def prose(n=90):
    out = [R.choice(WORDS)]
    while len(out) < n:
        out.append(R.choice(FOLLOWING[out[-1]]))
    return out


def rows(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)


def report(spark, texts, lang="en"):
    return {r.doc_id: r for r in quality_rules.rule_report(rows(spark, texts, lang)).collect()}


def test_junk_of_known_words_and_marks_is_rejected(spark):
    good = [prose(200) for _ in range(80)]
    salad, marked = R.sample(good[0], len(good[0])), [w + "%%%" for w in prose(200)]
    found = report(spark, [" ".join(x) for x in [*good, salad, marked]])
    assert sum(found[i].kept for i in range(80)) >= 79
    assert not found[80].kept and not found[81].kept and not found[80].base_failed and not found[81].base_failed


def test_other_scripts(spark):
    letters = [chr(c) for c in range(0x430, 0x450)]
    vocabulary = ["".join(R.choices(letters, k=R.randint(2, 8))) for _ in range(60)]
    texts = [" ".join(R.choices(vocabulary, k=90)) for _ in range(60)] + [" ".join("".join(R.choices(letters, k=5)) for _ in range(90))]
    found = report(spark, texts, "ru")
    assert sum(found[i].kept for i in range(60)) >= 59 and not found[60].kept


def test_word_perplexity_against_the_formula(spark, monkeypatch):
    """Equal to counts by hand without the document's own, over many runs and parts."""
    monkeypatch.setattr(word_model, "RUN_CHARS", 3000)
    monkeypatch.setattr(word_model, "PART_CHARS", 4000)
    texts = [" ".join(prose(60)) for _ in range(40)] + ["odd qxz words", "", "ban"]
    d = rows(spark, texts)
    model = quality_rules.train(d)
    found = {r.doc_id: r.log_perplexity for r in quality_rules.score(d, model).collect()}
    of = lambda t: list(zip(["", *t.split()], t.split()))
    counts = collections.Counter(p for t in texts for p in of(t))
    before = collections.Counter(w for _, w in counts)
    coc = lambda c: np.array([sum(v == i for v in c.values()) for i in (1, 2, 3, 4)])
    d2, d1 = word_model.discounts_from(coc(counts)), word_model.discounts_from(coc(before))
    share = sum(d1[min(n, 3)] for n in before.values()) / len(counts)
    for i in (0, 7, 40, 42):
        own = collections.Counter(of(texts[i]))
        rest = {p: n - own[p] for p, n in counts.items() if n > own[p]}
        left = collections.Counter(w for _, w in rest)
        logs = []
        for v, w in of(texts[i]):
            base = np.exp(quality_rules.spelling(model, [w], quality_rules.GROUPS.index("en"))[0])
            one = max(left[w] - d1[min(left[w], 3)], 0) / len(rest) + share * base
            total, n = sum(c for p, c in rest.items() if p[0] == v), rest.get((v, w), 0)
            kept = sum(d2[min(c, 3)] for p, c in rest.items() if p[0] == v)
            logs.append(-np.log((n - d2[min(n, 3)]) / total + kept / total * one if total else one))
        assert found[i] == pytest.approx(np.mean(logs), rel=1e-6)
    assert found[41] is None


def test_tables_grow_with_the_corpus(spark):
    sizes = []
    for n in (20, 80):
        texts = [" ".join(f"w{R.randrange(10**6)}" for _ in range(80)) for _ in range(n)]
        d, chars = word_model.dealt(rows(spark, texts), quality_rules.language_group(quality_rules.F.col("lang")))
        sizes.append(sum(s["kinds"] for s in word_model.answers(d, chars)[1].values()))
    assert sizes[1] > 3.5 * sizes[0]
