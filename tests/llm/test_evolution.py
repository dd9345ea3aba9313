"""Packing by evolution: fewer sequences than best fit alone, repeated rows, null ids, full and empty pieces."""

import random
from math import ceil

from loomlight.llm import bin_packing

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def triplets(seed, n, capacity=1000):
    """Lengths of n bins of three that fill each exactly."""
    r, out = random.Random(seed), []
    for _ in range(n):
        a = r.randint(380, 490)
        b = r.randint(250, 500 - a // 3)
        out += [a, b, capacity - a - b]
    return out


def check(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_evolution_needs_fewer_sequences_than_best_fit(spark):
    saved = 0
    for seed in range(3):
        lengths = triplets(seed, 40)
        alone = len(bin_packing.Islander(lengths, 0, 1000).start()[0])
        found = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], SCHEMA).repartition(2)
        rows = bin_packing.pack(found, 1000).collect()
        packed = check(rows, 1000)
        assert sorted(r.doc_id for r in rows) == list(range(len(lengths))) and 40 <= packed <= alone
        saved += alone - packed
    assert saved > 0


def test_repeated_rows_null_ids_and_full_pieces(spark):
    rows = [(1, 0, 0, 600, 7)] * 3 + [(None, 0, 0, 400, 8)] * 2 + [(2, 0, 0, 1000, 9), (2, 1, 1000, 1000, 9)]
    found = bin_packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), 1000).collect()
    assert len(found) == 7 and check(found, 1000) == 5
    assert check(found, 1000) >= ceil(sum(r[3] for r in rows) / 1000)
    assert bin_packing.pack(spark.createDataFrame([], SCHEMA), 1000).collect() == []
