"""LM scoring: a weighted backoff automaton of smoothed word pairs, walked once through each text.

The states are the words that training texts hold, the start of a text, and an empty one.
A state has an arc for each word that followed it in training; its weight is the word's log10
probability there. For any other word the failure arc leads to the empty state, at the
weight of what is left there for unseen words, and the empty state has an arc for every word. After a
word the state is that word's, or the empty one if training has not seen it. Probabilities are
interpolated with absolute discounts D = n1 / (n1 + 2 * n2), from how many pairs (words) come once and
twice: (c(hw) - D) / c(h) + D * followers(h) / c(h) * p(w), with p(w) = (c(w) - D') / N, and
the rest, D' * V / N, for all unknown words together. Over the V known words and the unknown
one each state's probabilities add up to 1. Where there is nothing that comes once, or twice, D is 1/2.

Nothing holds the model whole. Each task deals its texts to runs of RUN_WORDS words,
written once as numbers of words (a longer text goes on in the next run, from the state it
was in). A run asks for its distinct pairs, as sorted hashes with its own counts, cut to parts
by ranges of the hash; a part adds up what all runs ask and answers each in its order, and gives each pair
to one run, the first that trains it, so that the runs together count each word's followers once. Words
are asked likewise. Then each run has the arcs that its own texts can take, and walks them. A
run has a row for each part in which it has a key, so rows never exceed distinct pairs; a
word that stands everywhere is one entry a run. To the driver come sums: how many words,
distinct words and counts of 1 and 2. A word and a pair are hashes of 64 bits.

Null ids train nothing and are not held out. A null or empty text is its end alone; repeated
rows are scored each and train each; other columns are not read; without any training
text every word is unknown with probability 1. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mixed, release, small_batches, texts_as_bytes
from .word_model import from_numbers, from_small_numbers, numbers, packed, small_numbers, unpacked

#: Words and texts of a run, words for each part of the pairs.
RUN_WORDS, RUN_TEXTS, PART_WORDS = 1_500_000, 1 << 16, 3_000_000
#: Parts of pairs for each part of words.
WORD_SHARE = 4
#: Of ten remainders, the one that is held out.
FOLDS, HELD_OUT = 10, 0
#: Added to each count of the base score.
ADDED = 0.1
START, END = 0, 1  # numbers of the start of a text and of its end; as hashes too
PAIRS, WORDS = 0, 1
_32 = 32


def word_hash(word: bytes) -> int:
    return max(xxhash.xxh3_64_intdigest(word), END + 1)


class Run:
    """Stretches of texts as numbers of words: place by place, words of each stretch, the number before each; the words' hashes by number."""

    def __init__(self, hashes: np.ndarray, place: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> None:
        self.hashes, self.place, self.sizes, self.before = hashes, place, sizes, before
        self.starts = np.cumsum(sizes) - sizes

    def index(self) -> Run:
        """Adds the distinct pairs: numbers of their words, hashes, and which pair stands at each place."""
        history = np.empty(len(self.place), np.int64)
        history[1:] = self.place[:-1]
        history[self.starts] = self.before
        distinct, self.pair_at = np.unique(history << _32 | self.place, return_inverse=True)
        self.first, self.second = distinct >> _32, distinct & 0xFFFFFFFF
        self.pairs = mixed(self.hashes[self.first], self.hashes[self.second])
        return self

    def pair_counts(self, trains: np.ndarray) -> np.ndarray:
        return np.bincount(self.pair_at, np.repeat(trains, self.sizes), len(self.pairs)).astype(np.int64)

    def word_counts(self, trains: np.ndarray) -> np.ndarray:
        """Of tokens; the start's is the number of texts."""
        found = np.bincount(self.place, np.repeat(trains, self.sizes), len(self.hashes)).astype(np.int64)
        found[START] = (trains & (self.before == START)).sum()
        return found


def discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


class Automaton:
    """States are numbers of words; the empty state is the number after the last."""

    def __init__(self, run: Run, pair_counts: np.ndarray, counts: np.ndarray, followers: np.ndarray, total: int, distinct: int, pair_discount: float, word_discount: float) -> None:
        self.size = len(counts)
        known = counts > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            single = np.where(known, (counts - word_discount) / max(total, 1), word_discount * distinct / total if total else 1.0)
            left = np.where(known, pair_discount * followers / counts, 1.0)
        seen = pair_counts > 0
        h, w = run.first[seen], run.second[seen]
        weights = np.log10((pair_counts[seen] - pair_discount) / counts[h] + left[h] * single[w])
        self.arcs = dict(zip((h * self.size + w).tolist(), weights.tolist(), strict=True))
        self.word = np.log10(single).tolist()
        self.failure = [*np.log10(left).tolist(), 0.0]
        self.after = np.where(known, np.arange(self.size), self.size).tolist()

    def walk(self, words: list[int], before: int) -> float:
        """log10 probability of the words after the one before."""
        arc, word, failure, after, size = self.arcs.get, self.word, self.failure, self.after, self.size
        state, total = after[before], 0.0
        for w in words:
            weight = arc(state * size + w)
            total += failure[state] + word[w] if weight is None else weight
            state = after[w]
        return total


_RUN = "run long, words long, texts array<long>, doc_ids array<long>, held array<boolean>, trains array<boolean>, whole array<boolean>, hashes binary, places binary, sizes binary, before binary"
_ASK = "run long, part int, keys binary, counts binary, followers binary"
_ANSWER = "run long, kind int, part int, counts binary, followers binary, total long, distinct long, ones long, twos long"
_SCORE = "text long, whole boolean, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    return _batch(list(zip(*rows, strict=True)) if rows else [[] for _ in schema.split(", ")], schema)


class _Buffer:
    """Stretches on their way to a run."""

    def __init__(self) -> None:
        self.ids = {b"": START, b"\n": END}
        self.parts: list[np.ndarray] = []
        self.rows: list[tuple] = []
        self.before: list[int] = []
        self.words = 0

    def add(self, words: list[bytes], before: bytes, ends: bool, row: tuple) -> None:
        ids = self.ids
        own = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words))
        self.parts.append(np.append(own, np.int32(END)) if ends else own)
        self.before.append(ids.setdefault(before, len(ids)))
        self.rows.append(row)
        self.words += len(self.parts[-1])

    def row(self) -> pa.RecordBatch:
        place = np.concatenate(self.parts)
        times = np.bincount(place, minlength=len(self.ids))
        times[[START, END]] = len(place) + 1
        order = np.argsort(-times, kind="stable")  # commonest first: smaller numbers, which pack better
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        spelled = list(self.ids)
        hashes = np.fromiter((word_hash(spelled[i]) for i in order), np.uint64, len(order))
        hashes[START], hashes[END] = START, END
        sizes, before = np.array([len(p) for p in self.parts]), number[np.array(self.before)]
        columns = [list(x) for x in zip(*self.rows, strict=True)]
        return _rows([(uuid.uuid4().int >> 65, len(place), *columns, numbers(hashes.view(np.int64)), small_numbers(number[place]), numbers(sizes), numbers(before))], _RUN)


def _dealt(docs: DataFrame, run_words: int) -> DataFrame:
    """The runs, written."""
    small_batches(docs.sparkSession)
    left = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    held = F.coalesce(left == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held.alias("held"), F.coalesce(left != HELD_OUT, F.lit(False)).alias("trains"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = _Buffer()
        for batch in batches:
            for doc_id, text, held, trains in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words, key = text.lower().split(), uuid.uuid4().int >> 65
                for a in range(0, max(len(words), 1), run_words):
                    stretch = words[a : a + run_words]
                    if buffer.rows and (buffer.words + len(stretch) > run_words or len(buffer.rows) >= RUN_TEXTS):
                        yield buffer.row()
                        buffer = _Buffer()
                    buffer.add(stretch, words[a - 1] if a else b"", a + run_words >= len(words), (key, doc_id, held, trains, len(words) <= run_words))
        if buffer.rows:
            yield buffer.row()

    return materialize(rows.mapInArrow(run, _RUN))


def _run_of(hashes: bytes, places: bytes, sizes: bytes, before: bytes) -> Run:
    return Run(from_numbers(hashes).view(np.uint64), from_small_numbers(places).astype(np.int64), from_numbers(sizes), from_numbers(before))


_PACKED = ("hashes", "places", "sizes", "before")


def _ask_pairs(runs: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, trains, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = _run_of(*raw).index()
                counts = own.pair_counts(np.array(trains, bool))
                yield from _asked(number, own.pairs, counts, None, parts)

    small_batches(runs.sparkSession, 4)
    return runs.select("run", "trains", *_PACKED).mapInArrow(run, _ASK)


def _order(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that has keys, and the places of its keys by size; parts are equal ranges, so differences of keys stay small."""
    order = np.argsort(keys, kind="stable")
    part = ((keys[order] >> np.uint64(_32)) * np.uint64(parts)) >> np.uint64(_32)
    found, start = np.unique(part, return_index=True)
    yield from zip(found.tolist(), np.split(order, start[1:]), strict=True) if len(found) else ()


def _asked(number: int, keys: np.ndarray, counts: np.ndarray, followers: np.ndarray | None, parts: int) -> Iterator[pa.RecordBatch]:
    yield _rows([(number, part, packed(keys[at]), small_numbers(counts[at]), None if followers is None else small_numbers(followers[at])) for part, at in _order(keys, parts)], _ASK)


def _answered(asked: DataFrame, kind: int) -> DataFrame:
    """Each run's keys with what all runs have of them: counts and, of words, followers; of pairs, whether the run is the one that counts them as followers. Rows without a run have sums."""

    def count(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        runs, keys = table.column("run").to_pylist(), [unpacked(x) for x in table.column("keys").to_pylist()]
        own = [from_small_numbers(x) for x in table.column("counts").to_pylist()]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(at, np.concatenate(own), len(found)).astype(np.int64)
        if kind == WORDS:
            followers = np.bincount(at, np.concatenate([from_small_numbers(x) for x in table.column("followers").to_pylist()]), len(found)).astype(np.int64)
        free, start, out = np.ones(len(found), bool), 0, []
        for run, mine in zip(runs, own, strict=True):
            where = at[start : start + len(mine)]
            start += len(mine)
            if kind == PAIRS:
                first = (mine > 0) & free[where]
                free[where[first]] = False
            out.append((run, kind, part, numbers(counts[where]), small_numbers(first) if kind == PAIRS else numbers(followers[where]), None, None, None, None))
        counts = counts[found != START]
        out.append((None, kind, part, None, None, *(int(x) for x in (counts.sum(), (counts > 0).sum(), (counts == 1).sum(), (counts == 2).sum()))))
        return pa.Table.from_batches([_rows(out, _ANSWER)])

    return materialize(asked.groupBy("part").applyInArrow(count, _ANSWER))


def _sums(answers: DataFrame) -> tuple[int, int, int, int]:
    """Tokens, distinct keys, and keys that come once and twice, in training."""
    row = answers.filter("run is null").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "distinct", "ones", "twos"))).first()
    return tuple(row)


def _answer(keys: np.ndarray, parts: int, kind: int, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Counts and the other numbers, in the order of the keys."""
    counts, others = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    said = {p: (c, f) for k, p, c, f in zip(*(table.column(c).to_pylist() for c in ("kind", "part", "counts", "followers")), strict=True) if k == kind}
    for part, at in _order(keys, parts):
        counts[at], others[at] = from_numbers(said[part][0]), from_small_numbers(said[part][1]) if kind == PAIRS else from_numbers(said[part][1])
    return counts, others


def _ask_words(runs: DataFrame, pairs: DataFrame, parts: int, word_parts: int) -> DataFrame:
    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        ((number, trains, *raw),) = zip(*(left.column(c).to_pylist() for c in ("run", "trains", *_PACKED)), strict=True)
        run = _run_of(*raw).index()
        _, first = _answer(run.pairs, parts, PAIRS, right)
        followers = np.bincount(run.first, first, len(run.hashes)).astype(np.int64)
        return pa.Table.from_batches(list(_asked(number, run.hashes, run.word_counts(np.array(trains, bool)), followers, word_parts)))

    return runs.select("run", "trains", *_PACKED).groupBy("run").cogroup(pairs.groupBy("run")).applyInArrow(ask, _ASK)


def score(docs: DataFrame, run_words: int = RUN_WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    session = docs.sparkSession
    runs = _dealt(docs, run_words)
    parts = 1 + (runs.agg(F.sum("words")).first()[0] or 0) // part_words
    word_parts = 1 + parts // WORD_SHARE
    pairs = _answered(_ask_pairs(runs, parts), PAIRS)
    release(session)
    _, _, *often = _sums(pairs)
    pair_discount = discount(*often)
    pairs = pairs.filter("run is not null")
    words = _answered(_ask_words(runs, pairs, parts, word_parts), WORDS)
    release(session)
    total, distinct, *often = _sums(words)
    word_discount = discount(*often)

    def walked(left: pa.Table, right: pa.Table) -> pa.Table:
        ((texts, doc_ids, held, whole, *raw),) = zip(*(left.column(c).to_pylist() for c in ("texts", "doc_ids", "held", "whole", *_PACKED)), strict=True)
        run = _run_of(*raw).index()
        pair_counts, _ = _answer(run.pairs, parts, PAIRS, right)
        counts, followers = _answer(run.hashes, word_parts, WORDS, right)
        automaton = Automaton(run, pair_counts, counts, followers, total, distinct, pair_discount, word_discount)
        base = np.log10((counts + ADDED) / (total + ADDED * (distinct + 1)))
        scores = [automaton.walk(run.place[a : a + n].tolist(), before) for a, n, before in zip(run.starts.tolist(), run.sizes.tolist(), run.before.tolist(), strict=True)]
        known = np.add.reduceat((counts > 0)[run.place].astype(np.int64), run.starts)
        return pa.Table.from_batches([_batch([texts, whole, doc_ids, held, run.sizes, known, np.add.reduceat(base[run.place], run.starts), scores], _SCORE)])

    answers = pairs.union(words.filter("run is not null"))
    rows = materialize(runs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(walked, _SCORE))
    release(session)
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    joined = rows.filter("not whole").groupBy("text").agg(*(F.any_value(c).alias(c) for c in columns[:2]), *(F.sum(c).alias(c) for c in columns[2:]))
    return rows.filter("whole").select(*columns).union(joined.select(*columns)).select(*columns[:4], F.lit(total).cast("long").alias("train_tokens"), *columns[4:])
