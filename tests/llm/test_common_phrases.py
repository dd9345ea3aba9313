import collections

import numpy as np
import pytest

from loomlight.llm import jaccard_join


@pytest.mark.parametrize("percent", [80, 90])
def test_common_phrases_leave_few_pairs(percent):
    """Sets of 150 elements, of which 25 are one phrase that all hold: hardly any two meet in the lists that are left."""
    t, rng = jaccard_join.Threshold(percent), np.random.default_rng(7)
    number = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    phrase = number(25)
    keys = [jaccard_join.heavy_keys(np.unique(np.concatenate([phrase, number(125)])), t) for _ in range(600)]
    length = collections.Counter(int(k) for own in keys for k in own)
    left = collections.Counter()
    for own in keys:
        classes = collections.defaultdict(list)
        for k in own.tolist():
            if length[k] > 1:
                classes[k & jaccard_join.LAST_CLASS].append((-length[k], k))
        for c, found in classes.items():
            left.update(k for _, k in sorted(found)[t.shared(c) - 1 :])
    assert sum(n * (n - 1) // 2 for n in left.values()) < 600


@pytest.mark.parametrize("n", [20, 60, 200, 700])
def test_linking_sets_share_enough_lists(n):
    """Sets as far apart as links of 80 percent may be share at least the lists that keep them met."""
    t, rng = jaccard_join.Threshold(80), np.random.default_rng(n)
    for _ in range(20):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone = t.differences(n, n) // 2
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, gone).astype(np.uint64)]))
        shared = collections.Counter(int(k) & jaccard_join.LAST_CLASS for k in np.intersect1d(jaccard_join.heavy_keys(a, t), jaccard_join.heavy_keys(b, t)))
        assert n <= t.boundary or all(found >= t.shared(c) for c, found in shared.items()) and shared
