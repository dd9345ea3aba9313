"""Scores against plain counting and a plain walk; probabilities of each state add up to 1."""

import collections
import math
import random
import zlib

import pytest

from loomlight.llm import lm_scoring

R = random.Random(13)


def model(rows):
    """Token lists by row, and the training counts."""
    tokens = [((t or "").encode().lower().split(), i) for i, t in rows]
    tokens = [([*w, b"\n"], i) for w, i in tokens]
    words, pairs, history = collections.Counter(), collections.Counter(), collections.Counter()
    for w, i in tokens:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            words.update(w)
            pairs.update(zip([b"", *w[:-1]], w, strict=True))
            history.update([b"", *w[:-1]])
    return tokens, words, pairs, history


def brute(rows):
    tokens, words, pairs, history = model(rows)
    n, v = sum(words.values()), len(words)
    d2, d1 = (lm_scoring.discount(*(sum(c == k for c in counts.values()) for k in (1, 2))) for counts in (pairs, words))
    followers = collections.Counter(h for h, _ in pairs)
    single = lambda w: ((words[w] - d1) / n if w in words else d1 * v / n) if n else 1.0

    def p(h, w):
        if not history[h]:
            return single(w)
        return max(pairs[h, w] - d2, 0) / history[h] + d2 * followers[h] / history[h] * single(w)

    out = []
    for w, i in tokens:
        base = sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = sum(math.log10(p(h, x)) for h, x in zip([b"", *w[:-1]], w, strict=True))
        held = i is not None and zlib.crc32(str(i).encode()) % 10 == 0
        out.append((i, held, len(w), sum(x in words for x in w), n, base, score))
    states = {h: sum(p(h, w) for w in words) + p(h, b"never seen") for h in history}
    return sorted(out, key=repr), states


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "run", 7, 0.5) for i, t in rows], "doc_id long, text string, run string, words long, score double").repartition(3)
    return sorted(map(tuple, lm_scoring.score(df, **how).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=repr)


def same(spark, rows):
    got, (expected, states) = found(spark, rows), brute(rows)
    assert len(got) == len(expected)
    for a, b in zip(sorted(got, key=lambda r: (repr(r[0]), r[2], r[6])), sorted(expected, key=lambda r: (repr(r[0]), r[2], r[6])), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert all(abs(s - 1) < 1e-9 for s in states.values())
    return got


def texts(n):
    return [" ".join(R.choices(["The", "the", "cat", "sat", "É", "é", "mat.", f"w{R.randint(0, 99)}", "on\ton", "a\x0bb", "c\xa0d"], k=R.randint(0, 40))) for _ in range(n)]


def test_scores_equal_plain_counts(spark):
    rows = list(enumerate([*texts(200), "", " \n", None, "x " * 3000, "y" * 20000, "the same", "the same"]))
    got = same(spark, [*rows, (5, "again the cat"), (5, "again the cat"), (None, "the cat sat"), (None, None)])
    assert any(r[1] for r in got) and {r[2] for r in got} >= {1}


def test_long_texts_go_on_in_the_next_run(spark):
    rows = list(enumerate(texts(60)))
    whole = same(spark, rows)
    for a, b in zip(found(spark, rows, run_words=10, part_words=100), whole, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_no_training_and_empty_tables(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    assert found(spark, []) == []
    assert found(spark, [(held, "a b")]) == [(held, True, 3, 0, 0, 0.0, 0.0)]
    same(spark, [(1, "a a a a"), (held, "a b")])
    same(spark, [(1, None)])


def test_held_out_texts_are_likelier_than_by_words_alone(spark, sf):
    rows = lm_scoring.score(spark.read.parquet(f"{sf}/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
