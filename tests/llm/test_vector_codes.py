"""Vector codes against a search of every entry, with huge and odd components, ties, repeats and nulls."""

import hashlib
import math
import random

import numpy as np

from loomlight.llm import vector_codes

R = random.Random(11)
SCHEMA = "vec_id long, label int, embedding array<double>, codes string, error string"


def brute(rows, parts, entries, rounds):
    """(id, code, error, label_error) of each kept row, and the digest."""
    kept = [(i, lab, [math.floor(256 * x) if abs(x) < 1e15 else int(x) * 256 for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, book: min((far(v, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, _, v in kept:
                own.setdefault(near(part(v, p), books[p])[1], []).append(part(v, p))
            for e, xs in own.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = []
    for i, lab, v in kept:
        at = [near(part(v, p), books[p]) for p in range(parts)]
        found.append((i, lab, "".join(f"{e:02x}" for _, e in at), min(sum(d for d, _ in at), 2**63 - 1)))
    sums = {}
    for _, lab, _, e in found:
        sums[lab] = sums.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, min(sums[lab], 2**63 - 1)) for i, lab, c, e in found), key=repr), digest


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, lab, v, "codes", "error") for i, lab, v in rows], SCHEMA).repartition(3)
    return vector_codes.compress(df, **how).collect()


def same(spark, rows, parts=4, entries=8, rounds=2):
    found = run(spark, rows, parts=parts, entries=entries, rounds=rounds)
    expected, digest = brute(rows, parts, entries, rounds)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in found), key=repr) == expected
    assert {r.codebooks_sha256 for r in found} == {digest}


def test_exponion_search_equals_all_entries():
    for _ in range(60):
        entries = np.array([[R.randint(-3, 3) for _ in range(2)] for _ in range(R.randint(1, 20))])
        x = np.array([[R.randint(-5, 5) for _ in range(2)] for _ in range(50)])
        start = np.array([R.randrange(len(entries)) for _ in x])
        got, least = vector_codes.Codebook(entries).nearest(x, start)
        every = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert got.tolist() == every.argmin(1).tolist() and least.tolist() == every.min(1).tolist()


def test_codes_of_clustered_vectors_with_ties_and_nulls(spark):
    centres = [[R.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, R.choice([None, 1, 2]), [c + R.gauss(0, 0.1) for c in R.choice(centres)]) for i in range(300)]
    rows += [(i, 1, [0.5] * 8) for i in range(300, 420)]  # a common vector
    rows += [(7, 2, [0.25] * 8), (7, 2, [0.25] * 8), (None, None, [0.125] * 8), (500, 1, None), (501, 1, [None] * 8), (502, 1, [math.nan] * 8), (503, 1, [math.inf] + [0.0] * 7)]
    same(spark, rows)


def test_fewer_vectors_than_entries_and_equal_entries(spark):
    same(spark, [(i, 0, [float(i % 2)] * 4) for i in range(5)])
    same(spark, [(3, None, [1.0, 2.0, 3.0, 4.0])])


def test_huge_components_are_exact(spark):
    same(spark, [(i, i % 2, [R.choice([-1, 1]) * 2.0 ** R.randint(0, 60) for _ in range(4)]) for i in range(40)], entries=4)
    found = run(spark, [(1, 0, [1e300] * 4), (2, 0, [-1e300] * 4), (3, 0, [5e299] * 4)], parts=4, entries=2)
    assert len(found) == 3 and {r.label_error for r in found} == {2**63 - 1}


def test_other_lengths_and_empty_tables(spark):
    found = {r.vec_id: r for r in run(spark, [(1, 0, [1.0] * 4), (2, 0, [1.0] * 5), (3, 9, []), (4, 0, [2.0] * 4)], parts=4)}
    assert found[2].code is None and found[2].error is None and found[2].label_error == 0 and found[3].label_error is None and found[4].code == "01" * 4
    assert run(spark, [(1, 0, None)]) == []
    assert len(run(spark, [(1, 0, []), (2, 0, [])], parts=4)) == 2
