"""Farthest rows of a label are those of the whole label, whatever its size."""

import numpy as np

from loomlight.operators import extras as E


def test_farthest_first_over_whole_labels(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 4))
    rows = [(i, i % 2, [float(v) for v in x[i]]) for i in range(600)] + [(600 + i, 9, [1.0] * 4) for i in range(3)]
    found = {tuple(q) for q in E.distinct_behaviours(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), 5, block=20).collect()}
    want = {(600 + i, 9) for i in range(3)}
    for label in (0, 1):
        own = np.arange(label, 600, 2)
        taken, gap = [0], ((x[own] - x[own[0]]) ** 2).sum(1)
        while len(taken) < 5:
            taken.append(int(gap.argmax()))
            gap = np.minimum(gap, ((x[own] - x[own[taken[-1]]]) ** 2).sum(1))
        want |= {(int(own[k]), label) for k in taken}
    assert found == want
