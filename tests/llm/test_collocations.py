"""Collocations against plain counting, for several lengths and thresholds."""

import collections
import random
import re

import numpy as np

from loomlight.llm import collocations

R = random.Random(12)
NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, longest, least, covered, top):
    f, totals = collections.Counter(), collections.Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    by_lang = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in candidates.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        by_lang[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, totals[lang], -score) for lang, rows in by_lang.items() for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top]))


def found(spark, rows, *how, **more):
    df = spark.createDataFrame([(t, lang, "phrase", 7, 1.5) for t, lang in rows], "text string, lang string, phrase string, n long, score double").repartition(3)
    return sorted(tuple(r[c] for c in NAMES) for r in collocations.best_phrases(df, *how, **more).collect())


def texts(n, words, marks=" .,;\n\t"):
    return ["".join(R.choice(words) + R.choice([" ", " ", " ", "  ", R.choice(marks)]) for _ in range(R.randint(0, 60))) for _ in range(n)]


ODD = [None, "", " ", ".", "a", "A b\tA\x0bb", "é é é", "n\x00l n\x00l n\x00l", "x" * 3000, "a b " * 2000, "\xa0 \xa0 \xa0"]


def test_equals_plain_counts(spark):
    rows = [(t, R.choice([None, "und", "en", "de"])) for t in [*texts(300, ["Ab", "b", "c", "dd", "É", "中"]), *ODD, "the same words", "the same words"]]
    for how in ((3, 10, 50, 2000), (2, 5, 50, 3), (4, 6, 30, 50)):
        assert found(spark, rows, *how) == brute(rows, *how)


def test_few_bits_let_more_through_and_change_nothing(spark):
    rows = [(t, "en") for t in texts(150, [f"w{i}" for i in range(15)])]
    assert found(spark, rows, 3, 5, 50, 100, bits=6) == found(spark, rows, 3, 5, 50, 100, piece_words=20) == found(spark, rows, 3, 5, 50, 100) == brute(rows, 3, 5, 50, 100)


def test_phrases_of_a_piece():
    piece = collocations.Piece("en")
    for t in (b"A b c. a b c", b"a b", b""):
        piece.add(t)
    assert sorted(zip(*piece.phrases(2, [], True)[:2], strict=True)) == [(b"a b", 3), (b"b c", 2)]
    assert sorted(zip(*piece.phrases(3, [], True)[:2], strict=True)) == [(b"a b c", 2)]
    assert collocations.Piece("en").phrases(3, [], True)[1].size == 0


def test_bitmaps_prune_buckets_and_rare_parts():
    piece = collocations.Piece("en")
    piece.add(b"a b a b a c")
    one = lambda ws: np.unique(collocations.slots(collocations.word_hashes(ws, "en"), 8))
    maps = lambda at: collocations.Bitmap(8, [(p, sum(1 << (s & 63) for s in at if s >> 6 == p) - (1 << 64 if any(s & 63 == 63 and s >> 6 == p for s in at) else 0)) for p in range(4)])
    every = maps(range(256))
    rare = piece.phrases(2, [(every, maps(one([b"a", b"b"]).tolist()))], True)
    assert set(rare[0]) <= {b"a b", b"b a", b"a c"} and {b"a b", b"b a"} <= set(rare[0])
    assert piece.phrases(2, [(maps([]), every)], True)[0] == []


def test_empty_table_and_huge_products(spark):
    assert found(spark, []) == [] and found(spark, [(None, None)]) == []
    big = spark.createDataFrame([("en", 1, "a", 3 * 10**11), ("en", 1, "b", 3 * 10**11), ("en", 2, "a b", 2 * 10**11)], "lang string, words int, phrase string, n long")
    (row,) = collocations._scores(big, 2).collect()
    assert row.score == 1_000_000 * (2 * 10**11) ** 2 // (3 * 10**11) ** 2
