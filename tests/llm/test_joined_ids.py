"""Links of documents whose copies have no id, and of ids with several texts."""

import random

import pytest

from loomlight.llm import jaccard_join

R = random.Random(17)


def text(n=150):
    return [f"w{R.randrange(10**6)}" for _ in range(n)]


def near(words):
    return [*words[:-1], "changed"]


def found(spark, rows, parts=1):
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").coalesce(parts)
    return {(r.doc_id, r.component_id) for r in jaccard_join.link_components(d, percent=90, width=3).collect() if r.doc_id is not None}


@pytest.mark.parametrize("n", [16, 150])
def test_a_copy_without_an_id_comes_first(spark, n):
    a = text(n)
    other = near(a) if n > 100 else a
    assert found(spark, [(None, a), (4, a), (9, other)]) == {(4, 4), (9, 4)}


def test_every_text_of_an_id_links(spark):
    a, b, c = text(), text(), text()
    # 50 has three texts; 1, 2 and 3 copy them, 60, 61 and 62 are near them
    rows = [(50, a), (50, b), (50, c), (1, a), (2, b), (3, c), (60, near(a)), (61, near(b)), (62, near(c))]
    want = {(i, 1) for i in (50, 1, 2, 3, 60, 61, 62)}
    assert found(spark, rows) == want and found(spark, rows[::-1]) == want
    assert found(spark, [(7, a), (8, b)]) == {(7, 7), (8, 8)}
