"""A modified Kneser-Ney model of pairs of words, counted over all rows, that no task and no driver holds whole.

Words are runs between white space in lower case, with closing marks apart; characters of
scripts written without blanks are words of their own. A word is a hash of 32 bits, a pair
one of 64. Each task deals its documents to runs of one language; runs are written once, as
numbers of words behind a compressed list of hashes, so texts are never shuffled. Each run
asks for its distinct pairs and words, as sorted arrays cut to parts by hash; a part merges
what all runs ask, so it has the counts of the corpus, and answers each run in the run's
order. What a word begins and ends (counts of its pairs, kinds of words before it) is summed
from all parts of the pairs. Runs, parts and all tables grow with the corpus; only the counts
of counts, eight numbers a language, come to the driver. Pairs are asked, and runs scored, in
WAVES, each of which frees its shuffle before the next.

A document is scored by what all other rows say: its own pairs are taken out of every count
(leaving one out), else each text would have taught the model itself. Unknown words are
spelled by the model of symbols, with the number of characters of a symbol's class.

A run has a row for each part it asks: with P parts the rows are runs times P, short beyond
some TB of one language (about 20 pairs a row at 1 TB), where PART_CHARS should be raised
with the executors' memory.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, small_batches, worker_cache

#: Characters of a run and of a part of the tables; texts of a run.
RUN_CHARS, PART_CHARS = 16_000_000, 16_000_000
RUN_TEXTS = 1 << 16
#: Words of a run that are scored at a time.
SLICE_WORDS = 500_000
#: Shares in which pairs are asked and runs scored.
WAVES = 4
#: Parts of pairs for each part of words.
WORD_SHARE = 2
PAIRS, WORDS = 0, 1
_SINGLE = re.compile("([฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff])")
_CLOSING = re.compile(r"([.,;:!?]+)(?=\s|$)")
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def words_of(text: str) -> list[str]:
    text = _CLOSING.sub(r" \1", text.lower())
    return (text if text.isascii() else _SINGLE.sub(r" \1 ", text)).split()


def word_hash(word: str) -> int:
    """From 1; 0 stands before the first word."""
    return xxhash.xxh32_intdigest(word.encode("utf-8", "replace")) or 1


class Run:
    """The words of some texts by number, commonest first: the hash of each, the numbers in order, the words of each text."""

    def __init__(self, hashes: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> None:
        self.hashes, self.place, self.sizes, self.texts = hashes, place, sizes, len(sizes)

    @classmethod
    def of(cls, texts: list[str]) -> tuple[Run, list[str]]:
        """The run and its words by number."""
        ids: dict[str, int] = {}
        parts = [np.fromiter((ids.setdefault(w, len(ids)) for w in words_of(t)), np.int32) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        place = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        del parts
        hashes = np.fromiter(map(word_hash, ids), np.uint64, len(ids))
        order = np.lexsort((hashes, -np.bincount(place, minlength=len(ids))))
        number = np.empty(len(ids), np.int32)
        number[order] = np.arange(len(ids))
        spelled = list(ids)
        return cls(hashes[order], number[place], sizes), [spelled[i] for i in order]

    @property
    def words(self) -> np.ndarray:
        """Sorted hashes, with 0 before them."""
        return np.unique(np.concatenate([np.zeros(1, np.uint64), self.hashes]))

    def index(self) -> Run:
        """Adds first, second (places in words) and times of the distinct pairs, and pair, document and times of each pair of each document."""
        words = self.words
        last = np.searchsorted(words, self.hashes).astype(np.uint64)[self.place]
        before = np.empty_like(last)
        before[1:], before[:1] = last[:-1], 0
        before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = 0
        if not len(last):
            self.times = self.doc = self.pair_at = self.first = self.second = np.zeros(0, np.int32)
            self.pairs, self.pair_times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return self
        w, d = np.uint64(len(words).bit_length()), np.uint64(self.texts.bit_length())
        if 2 * int(w) + int(d) > 64:
            raise ValueError("too many words and texts for one run")
        before <<= w
        before |= last
        del last
        before <<= d
        before |= np.repeat(np.arange(self.texts, dtype=np.uint32), self.sizes)
        before.sort()
        start = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.times = np.diff(np.append(start, len(before))).astype(np.int32)
        before = before[start]
        self.doc = (before & ((np.uint64(1) << d) - np.uint64(1))).astype(np.int32)
        before >>= d
        new = np.concatenate([[True], before[1:] != before[:-1]])
        self.pair_at = (np.cumsum(new) - 1).astype(np.int32)
        pairs = before[new]
        self.first, self.second = (pairs >> w).astype(np.int32), (pairs & ((np.uint64(1) << w) - np.uint64(1))).astype(np.int32)
        self.pairs = (words[self.first] << _32) | words[self.second]
        self.pair_times = np.bincount(self.pair_at, self.times, len(self.pairs)).astype(np.int64)
        return self


def mixed_part(keys: np.ndarray, parts: int) -> np.ndarray:
    x = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that has keys, and their places in order."""
    part = mixed_part(keys, parts)
    order = np.argsort(part, kind="stable")
    found, start = np.unique(part[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, start[1:]), strict=True) if len(found) else ()


def _shrunk(x: np.ndarray) -> bytes:
    """Numbers, bytes of equal weight together, compressed behind their length."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return raw.nbytes.to_bytes(8, "little") + pa.compress(pa.py_buffer(raw), codec="zstd", asbytes=True)


def _grown(raw: bytes, width: int = 8) -> np.ndarray:
    """Rows of so many bytes."""
    plain = np.frombuffer(pa.decompress(pa.py_buffer(raw).slice(8), int.from_bytes(raw[:8], "little"), codec="zstd"), np.uint8)
    return np.ascontiguousarray(plain.reshape(width, -1).T)


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys, as differences."""
    return _shrunk(np.diff(keys, prepend=np.uint64(0)))


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(_grown(raw).view(np.uint64).reshape(-1), dtype=np.uint64)


def numbers(x: np.ndarray) -> bytes:
    return _shrunk(np.ascontiguousarray(x, np.int64).reshape(-1))


def from_numbers(raw: bytes) -> np.ndarray:
    return _grown(raw).view(np.int64).reshape(-1)


def small_numbers(x: np.ndarray) -> bytes:
    return _shrunk(np.ascontiguousarray(x, np.int32))


def from_small_numbers(raw: bytes) -> np.ndarray:
    return _grown(raw, 4).view(np.int32).reshape(-1)


def kinds(counts: np.ndarray) -> np.ndarray:
    """A row for each count: whether it is 1, 2, and 3 or more."""
    return np.stack([counts == 1, counts == 2, counts >= 3]).astype(np.int64)


def merged(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and, by column, the sums of their values."""
    every = np.concatenate(keys)
    order = np.argsort(every)
    every = every[order]
    start = np.flatnonzero(np.concatenate([np.ones(min(len(every), 1), bool), every[1:] != every[:-1]]))
    rows = np.concatenate(values, axis=1)
    return every[start], np.stack([np.add.reduceat(r[order], start) if len(start) else np.zeros(0, np.int64) for r in rows])


def word_sides(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word in the pairs: pairs that it begins (their sum, and how many come 1, 2, 3 or more times), and kinds of words before it."""
    first, of = np.unique(pairs >> _32, return_inverse=True)
    begun = np.stack([np.bincount(of, r, len(first)) for r in (counts, *kinds(counts))]).astype(np.int64)
    second, n = np.unique(pairs & _LOW, return_counts=True)
    left = np.concatenate([begun, np.zeros((1, len(first)), np.int64)])
    right = np.zeros((5, len(second)), np.int64)
    right[4] = n
    return merged([first, second], [left, right])


def counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.array([(counts == i).sum() for i in (1, 2, 3, 4)], np.int64)


def discounts_from(n: np.ndarray) -> np.ndarray:
    if not (n[0] and n[1] and n[2]):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), float(i)) for i in (1, 2, 3)])


def log_perplexities(run: Run, pair_counts: np.ndarray, sides: np.ndarray, stats: dict, spelling: np.ndarray) -> np.ndarray:
    """Mean negative log probability of each text's words after the others' counts; nan where there are none.

    run: after index(); pair_counts: of run.pairs; sides: columns of word_sides() for run.words,
    over the corpus; stats: counts of counts of pairs ("pairs") and of kinds before a word
    ("words"), distinct pairs ("kinds"), words with 1, 2, and 3 or more kinds before them
    ("by_kind"); spelling: log probability of each word by its number.
    """
    if not len(run.place):
        return np.full(run.texts, np.nan)
    words = run.words
    spelled = np.zeros(len(words))
    spelled[np.searchsorted(words, run.hashes)] = np.exp(spelling.astype(np.float64))
    base = np.maximum(spelled, 1e-300)
    out = np.full(run.texts, np.nan)
    # so many texts at a time that a share of the run's words is worked on
    ends = np.cumsum(run.sizes)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(SLICE_WORDS, ends[-1], SLICE_WORDS)), [run.texts]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = np.flatnonzero((run.doc >= a) & (run.doc < b))
        out[a:b] = _slice_perplexities(run, own, a, b, pair_counts, sides, stats, base)
    return out


def _slice_perplexities(run: Run, own: np.ndarray, a: int, b: int, pair_counts: np.ndarray, sides: np.ndarray, stats: dict, base: np.ndarray) -> np.ndarray:
    """log_perplexities() of the texts a ... b, whose pairs are at the places own."""
    d2, d1 = discounts_from(stats["pairs"]), discounts_from(stats["words"])
    doc, pair, times, texts = run.doc[own].astype(np.int64) - a, run.pair_at[own], run.times[own], b - a
    every = pair_counts[pair]
    rest = every - times  # counts in all other rows
    first, second = run.first[pair].astype(np.int64), run.second[pair].astype(np.int64)
    gone = rest == 0

    def of_document(word: np.ndarray, *weights: np.ndarray) -> list[np.ndarray]:
        """Sums of the weights over the document's pairs with the same word."""
        group, found = pd.factorize(word * texts + doc)
        return [np.bincount(group, w, len(found))[group] for w in weights]

    shift = d2[np.minimum(every, 3)] - d2[np.minimum(rest, 3)]
    taken, shifted = of_document(first, times, shift)
    total = sides[0][first] - taken
    kept = (d2[1] * sides[1] + d2[2] * sides[2] + d2[3] * sides[3])[first] - shifted
    before = sides[4][second] - of_document(second, gone)[0].astype(np.int64)
    all_kinds = stats["kinds"] - np.bincount(doc, gone, texts)[doc]
    share = np.clip(d1[1:] @ stats["by_kind"] / np.maximum(stats["kinds"], 1), 1e-9, 1)
    one = np.where(all_kinds > 0, np.maximum(before - d1[np.minimum(before, 3)], 0) / np.maximum(all_kinds, 1) + share * base[second], base[second])
    p = np.where(total > 0, np.maximum(rest - d2[np.minimum(rest, 3)], 0) / np.maximum(total, 1) + np.clip(kept / np.maximum(total, 1), 0, 1) * one, one)
    sums, sizes = np.bincount(doc, -np.log(np.maximum(p, 1e-300)) * times, texts), run.sizes[a:b]
    return np.divide(sums, sizes, out=np.full(texts, np.nan), where=sizes > 0)


_RUN = "language_group int, run long, chars long, docs binary, hashes binary, places binary, sizes binary, spelling binary"
_RUN_TYPES = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
_ROW = "language_group int, run long, kind int, part int, keys binary, numbers binary"
_ROW_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
#: Runs that are none: what pairs say of words, and counts of counts.
_SIDES, _STATS = -1, -2

#: Of texts of one language group and their words by number: columns for the texts, and the log probability of each word's spelling.
Describe = Callable[[list[str], list[str], int], tuple[list[pa.Array], np.ndarray]]


def _batch(rows: list[tuple], schema: str, types: list[pa.DataType]) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _frame(columns: list[pa.Array]) -> bytes:
    out = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def framed(raw: bytes) -> list[pa.Array]:
    return pa.ipc.open_stream(raw).read_next_batch().columns


def _nothing(texts: list[str], words: list[str], group: int) -> tuple[list[pa.Array], np.ndarray]:
    return [], np.zeros(len(words), np.float32)


def dealt(docs: DataFrame, group: Column, describe: Describe = _nothing, kept: tuple[str, ...] = ()) -> tuple[DataFrame, dict[int, int]]:
    """The runs, written, and the characters of each group.

    docs: text and the columns to keep with it. A run's docs are those columns, then what
    describe() gives.
    """
    small_batches(docs.sparkSession)
    work = docs.select(*kept, F.coalesce(F.col("text").cast("string"), F.lit("")), group)

    def made(buffer: list, number: int) -> pa.RecordBatch:
        texts = [t for _, t in buffer]
        run, words = Run.of(texts)
        added, spelled = describe(texts, words, number)
        own = [pa.concat_arrays([x[i] for x, _ in buffer]) for i in range(len(kept))]
        count = sum(map(len, texts))
        row = (number, uuid.uuid4().int >> 65, count, _frame([*own, *added]) if own or added else None, packed(run.hashes), small_numbers(run.place), numbers(run.sizes), _shrunk_floats(spelled))
        return _batch([row], _RUN, _RUN_TYPES)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("word_model")
        held: dict[int, list] = {}
        chars: dict[int, int] = {}
        for batch in batches:
            texts, groups = batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist()
            for i, (text, g) in enumerate(zip(texts, groups, strict=True)):
                if g in held and (len(held[g]) >= RUN_TEXTS or chars[g] + len(text) > RUN_CHARS):
                    yield made(held.pop(g), g)
                    chars.pop(g)
                held.setdefault(g, []).append(([batch.column(c).slice(i, 1) for c in range(len(kept))], text))
                chars[g] = chars.get(g, 0) + len(text)
                if sum(chars.values()) > 2 * RUN_CHARS:
                    longest = max(chars, key=chars.get)
                    yield made(held.pop(longest), longest)
                    chars.pop(longest)
        for g in sorted(held):
            yield made(held[g], g)

    written = materialize(work.mapInArrow(runs, _RUN))
    sums = written.groupBy("language_group").agg(F.sum("chars").alias("chars")).collect()  # a row for each group at most
    return written, {r.language_group: r.chars for r in sums}


def _shrunk_floats(x: np.ndarray) -> bytes:
    return _shrunk(np.ascontiguousarray(x, np.float32))


def _grown_floats(raw: bytes) -> np.ndarray:
    return _grown(raw, 4).view(np.float32).reshape(-1)


def _run_of(hashes: bytes, places: bytes, sizes: bytes) -> Run:
    return Run(unpacked(hashes), from_small_numbers(places), from_numbers(sizes))


def parts_of(chars: dict[int, int]) -> dict[int, int]:
    """Parts of the pairs of each group."""
    return {g: 1 + n // PART_CHARS for g, n in chars.items()}


def word_parts(parts: int) -> int:
    return 1 + parts // WORD_SHARE


def answers(runs: DataFrame, chars: dict[int, int]) -> tuple[DataFrame, dict[int, dict]]:
    """language_group, run, kind, part, numbers: what the corpus counts for all that each run asks; and the counts of counts by group."""
    parts = parts_of(chars)
    told = runs.select("language_group", "run", "hashes", "places", "sizes")

    def ask(kind: int, wave: int = 0) -> DataFrame:
        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for group, number, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    run = _run_of(*raw)
                    if kind == WORDS:
                        yield _batch([(group, number, WORDS, p, packed(run.words[at]), None) for p, at in by_part(run.words, word_parts(parts[group]))], _ROW, _ROW_TYPES)
                        continue
                    run.index()
                    yield _batch([(group, number, PAIRS, p, packed(run.pairs[at]), numbers(run.pair_times[at])) for p, at in by_part(run.pairs, parts[group]) if p % WAVES == wave], _ROW, _ROW_TYPES)

        small_batches(runs.sparkSession, 8)
        return told.mapInArrow(asked, _ROW)

    def count(table: pa.Table) -> pa.Table:
        group, part = table.column("language_group")[0].as_py(), table.column("part")[0].as_py()
        asked = [unpacked(x) for x in table.column("keys").to_pylist()]
        found, (counts,) = merged(asked, [from_numbers(x)[None] for x in table.column("numbers").to_pylist()])
        out = [(group, run, PAIRS, part, None, numbers(counts[np.searchsorted(found, keys)])) for run, keys in zip(table.column("run").to_pylist(), asked, strict=True)]
        words, sides = word_sides(found, counts)
        out += [(group, _SIDES, WORDS, q, packed(words[at]), numbers(sides[:, at])) for q, at in by_part(words, word_parts(parts[group]))]
        return pa.Table.from_batches([_batch([*out, (group, _STATS, PAIRS, part, None, numbers(np.append(counts_of_counts(counts), len(found))))], _ROW, _ROW_TYPES)])

    def gather(table: pa.Table) -> pa.Table:
        group, part = table.column("language_group")[0].as_py(), table.column("part")[0].as_py()
        from_runs, keys = table.column("run").to_pylist(), [unpacked(x) for x in table.column("keys").to_pylist()]
        said = [(k, from_numbers(n).reshape(5, -1)) for r, k, n in zip(from_runs, keys, table.column("numbers").to_pylist(), strict=True) if r == _SIDES]
        asked = [(r, k) for r, k in zip(from_runs, keys, strict=True) if r != _SIDES]
        # words of texts without a pair are in no side
        words, sides = merged([k for k, _ in said] + [k for _, k in asked], [s for _, s in said] + [np.zeros((5, len(k)), np.int64) for _, k in asked])
        out = [(group, r, WORDS, part, None, numbers(sides[:, np.searchsorted(words, k)])) for r, k in asked]
        return pa.Table.from_batches([_batch([*out, (group, _STATS, WORDS, part, None, numbers(np.append(counts_of_counts(sides[4]), kinds(sides[4]).sum(1))))], _ROW, _ROW_TYPES)])

    every = None
    for wave in range(WAVES):
        pairs = materialize(ask(PAIRS, wave).groupBy("language_group", "part").applyInArrow(count, _ROW))
        every = pairs if every is None else every.union(pairs)
        release(runs.sparkSession)
    of_words = ask(WORDS).union(every.filter(F.col("run") == _SIDES))
    words = materialize(of_words.groupBy("language_group", "part").applyInArrow(gather, _ROW))
    every = every.filter(F.col("run") != _SIDES).union(words)
    sums: dict[tuple, np.ndarray] = {}
    for g, kind, n in every.filter(F.col("run") == _STATS).select("language_group", "kind", "numbers").collect():
        sums[g, kind] = sums.get((g, kind), 0) + from_numbers(bytes(n))
    stats = {g: {"pairs": sums[g, PAIRS][:4], "kinds": int(sums[g, PAIRS][4]), "words": sums[g, WORDS][:4], "by_kind": sums[g, WORDS][4:]} for g, kind in sums if kind == PAIRS}
    release(runs.sparkSession)
    return every.filter(F.col("run") >= 0).select("language_group", "run", "kind", "part", "numbers"), stats


def scored(runs: DataFrame, found: DataFrame, chars: dict[int, int], stats: dict[int, dict], schema: str, types: list[pa.DataType], result: Callable[[list[pa.Array], np.ndarray, int], list[pa.Array]]) -> DataFrame:
    """Rows that result() makes of a run's docs, log_perplexities() and group, written; the runs are met with their answers in WAVES."""
    parts = parts_of(chars)
    names = [x.split()[0] for x in schema.split(", ")]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        worker_cache("word_model")
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
        ((group, docs, *raw, spelled),) = zip(*(left.column(c).to_pylist() for c in ("language_group", "docs", "hashes", "places", "sizes", "spelling")), strict=True)
        run = _run_of(*raw)
        logs = np.full(run.texts, np.nan)
        if len(run.place) and group in stats:
            run.index()
            pair_counts, sides = np.zeros(len(run.pairs), np.int64), np.zeros((5, len(run.words)), np.int64)
            places = {PAIRS: dict(by_part(run.pairs, parts[group])), WORDS: dict(by_part(run.words, word_parts(parts[group])))}
            for kind, part, n in zip(*(right.column(c).to_pylist() for c in ("kind", "part", "numbers")), strict=True):
                at = places[kind][part]
                if kind == PAIRS:
                    pair_counts[at] = from_numbers(n)
                else:
                    sides[:, at] = from_numbers(n).reshape(5, -1)
            logs = log_perplexities(run, pair_counts, sides, stats[group], _grown_floats(spelled))
        return pa.Table.from_arrays(result(framed(docs), logs, group), names=names)

    keys = ("language_group", "run")
    rows = None
    for wave in range(WAVES):
        own = F.pmod("run", F.lit(WAVES)) == wave
        part = materialize(runs.filter(own).groupBy(*keys).cogroup(found.filter(own).groupBy(*keys)).applyInArrow(score, schema))
        rows = part if rows is None else rows.union(part)
        release(runs.sparkSession)
    return rows
