import collections

import numpy as np

from loomlight.llm import collocations


def piece(text):
    out = collocations.Piece("en")
    out.add(text)
    return out


def bitmap(slots):
    found = np.zeros(4, np.uint64)
    for s in slots:
        found[s >> 6] |= np.uint64(1) << np.uint64(s & 63)
    return collocations.Bitmap(8, list(enumerate(found.view(np.int64).tolist())))


def test_only_places_that_may_count_are_sorted(monkeypatch):
    rare = piece(b"x y " * 3 + b" ".join(b"w%d" % i for i in range(5000)))
    allowed = [(bitmap(range(256)), bitmap(collocations.slots(collocations.word_hashes([b"x", b"y"], "en"), 8).tolist()))]
    kept, plain, sizes = len(rare._ends(2, allowed)[0]), np.unique, []
    assert kept < 1000
    monkeypatch.setattr(np, "unique", lambda x, **how: sizes.append(np.size(x)) or plain(x, **how))
    phrases, times, _ = rare.phrases(2, allowed, True)
    rare.buckets(2, allowed, 8)
    assert sizes == [kept, kept] and dict(zip(phrases, times.tolist(), strict=True))[b"x y"] == 3


def test_buckets_hold_the_phrases_of_all_places():
    one = piece(b"a b. a b c a b c; d\n" * 7)
    for n in (1, 2, 3, 4):
        _, times, hashes = one.phrases(n, [], False)
        expected = collections.Counter()
        for t, s in zip(times.tolist(), collocations.slots(hashes, 8).tolist(), strict=True):
            expected[s] += t
        assert dict(zip(*(x.tolist() for x in one.buckets(n, [], 8)), strict=True)) == expected


def test_phrases_of_many_words_that_no_number_holds():
    words = [b"w%d" % i for i in range(300)]
    phrases, times, _ = piece(b" ".join(words * 2)).phrases(9, [], True)
    assert dict(zip(phrases, times.tolist(), strict=True)) == collections.Counter(b" ".join((words * 2)[i : i + 9]) for i in range(592))
