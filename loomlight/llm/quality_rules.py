"""Quality rules: counts of a text, and bands of its perplexity under n-gram models of its language.

Base rules: a text fails with fewer than MIN_WORDS words, or if over MAX_REPEATED percent of
its words stand in three-word windows that come twice or more.

Two modified Kneser-Ney models, counted over all rows. That of words (word_model) grows with
the corpus: it is cut to parts, and perplexity is its perplexity per word. It spells words
that no other row has by the model of ORDER symbols. Symbols are 64 classes of characters
(letters without accents, by case; digits; kinds of marks), so a language has at most 64**3
n-grams, which are smoothed on the driver and broadcast as sorted hash arrays. Languages of
LANGUAGES have models each, any other or null lang shares one. Letters outside Latin have
four symbols only: there the words tell text from noise, and spelling counts the characters
of a class.

Bands: of each language's documents that pass the base rules, the median of a log perplexity
less and plus SPREAD times the distance to the quartiles on that side (at least LEAST).
Documents outside are rejected: above the band of words, or on either side of that of
symbols, where a text in several languages counts by the best for each piece of it. Words have no lower bound, as copies of a document in other rows make it likely,
and copies are no junk. A text without a word has perplexity null and fails by its words.

Null text: empty. Repeated rows are counted and scored each. An empty table gives an empty
result. Other columns are not read, and keep_good() gives them back under any name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import word_model
from .common import small_batches, worker_cache

MIN_WORDS, MAX_REPEATED = 50, 50
ORDER, BITS = 3, 6
CLASSES = 1 << BITS
#: Languages with a model of their own; the last group is of all others.
LANGUAGES = ("ar", "cs", "de", "en", "es", "fr", "hi", "it", "ja", "ko", "nl", "pl", "pt", "ru", "zh")
GROUPS = (*LANGUAGES, "other")
SPREAD, LEAST = 5.0, 0.02
#: Symbols that take the language that suits them best, in texts so far (in logs) over the mean of their own.
SEGMENT, MIXED = 128, 0.05

_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\f"


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point of the basic plane; the last entry is that of all others."""
    out = np.full(0x10001, 63, np.uint32)
    for code in range(0x10000):
        c = chr(code)
        kind = unicodedata.category(c)
        base = unicodedata.normalize("NFD", c)[0] if 0xC0 <= code < 0x250 else c
        if c.isspace():
            out[code] = 0
        elif "a" <= base <= "z":
            out[code] = 1 + ord(base) - 97
        elif "A" <= base <= "Z":
            out[code] = 27 + ord(base) - 65
        elif kind == "Nd":
            out[code] = 53
        elif c in ".,":
            out[code] = 54 + ".,".index(c)
        elif c in ";:!?":
            out[code] = 56
        elif kind in ("Ps", "Pe", "Pi", "Pf", "Pd") or c in "\"'":
            out[code] = 57
        elif kind[0] in "SP":
            out[code] = 58
        elif kind[0] in "LM":
            out[code] = 59 + code % 4
    return out


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return _classes()[np.minimum(codes, 0x10000)]


def _grams(texts: list[str], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (group, then ORDER symbols) of all positions of all texts, and which text each is of; texts begin after blanks."""
    parts = [symbols(t) for t in texts]
    sizes = np.array([len(p) for p in parts])
    pad = np.zeros(ORDER - 1, np.uint32)
    line = np.concatenate([x for p in parts for x in (pad, p)]) if parts else pad
    key = line[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        key |= line[ORDER - 1 - back : len(line) - back] << np.uint32(BITS * back)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint32), sizes)
    starts = np.arange(len(texts)) * (ORDER - 1)
    key = key[np.arange(len(owner)) + starts[owner]]
    return key | (groups.astype(np.uint32)[owner] << np.uint32(BITS * ORDER)), owner


@dataclass
class SortedTable:
    """Sorted hashes and a number for each."""

    hashes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> SortedTable:
        hashes = mixed(keys)
        order = np.argsort(hashes)
        return cls(hashes[order], values[order].astype(np.float32))

    def get(self, keys: np.ndarray, otherwise: float) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(keys), otherwise, np.float32)
        hashes = mixed(keys)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.values[at], np.float32(otherwise))


def mixed(keys: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def discounts(counts: np.ndarray) -> np.ndarray:
    """Of counts 1, 2 and 3 or more, from the counts of counts; a half of each count's bound where these are too few."""
    n = [int((counts == i).sum()) for i in (1, 2, 3, 4)]
    if not (n[0] and n[1] and n[2]):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), float(i)) for i in (1, 2, 3)])


class KneserNey:
    """Interpolated probabilities of all n-grams met and the weights of all contexts met, in sorted hash arrays."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys: group and ORDER symbols, distinct; counts: how often each comes."""
        self.found: list[SortedTable] = []
        self.weights: list[SortedTable] = []
        levels = [(keys.astype(np.uint64), counts.astype(np.float64))]
        for n in range(ORDER, 1, -1):  # continuation counts: how many symbols come before
            group, gram = self._split(levels[-1][0], n)
            levels.append(np.unique((group << np.uint64(BITS * (n - 1))) | (gram & np.uint64((1 << BITS * (n - 1)) - 1)), return_counts=True))
        for n, (level, count) in zip(range(1, ORDER + 1), reversed(levels), strict=True):
            group, gram = self._split(level, n)
            cut = np.zeros(len(level))
            for g in np.unique(group):
                own = group == g
                cut[own] = discounts(count[own])[np.minimum(count[own], 3).astype(int)]
            contexts, of = np.unique(level >> np.uint64(BITS), return_inverse=True)
            total = np.bincount(of, count, len(contexts))
            weight = np.bincount(of, cut, len(contexts)) / np.maximum(total, 1e-300)
            below = self._lower((group << np.uint64(BITS * (n - 1))) | (gram & np.uint64((1 << BITS * (n - 1)) - 1)), n - 1)
            p = (count - cut) / total[of] + weight[of] * below
            if n == ORDER:
                self.means = {int(g): float(-(count @ (np.log(p) * (group == g))) / count[group == g].sum()) for g in np.unique(group)}
            self.found.append(SortedTable.of(self._tagged(level, n), p))
            self.weights.append(SortedTable.of(self._tagged(contexts, n), weight))

    @staticmethod
    def _split(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return keys >> np.uint64(BITS * n), keys & np.uint64((1 << BITS * n) - 1)

    @staticmethod
    def _tagged(keys: np.ndarray, n: int) -> np.ndarray:
        return (keys.astype(np.uint64) << np.uint64(4)) | np.uint64(n)

    def _lower(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Probability of the last of n symbols after the others."""
        if not n:
            return np.full(len(keys), 1 / CLASSES)
        group, gram = self._split(keys, n)
        shorter = (group << np.uint64(BITS * (n - 1))) | (gram & np.uint64((1 << BITS * (n - 1)) - 1))
        p = self.found[n - 1].get(self._tagged(keys, n), np.nan).astype(np.float64)
        new = np.isnan(p)
        if new.any():
            p[new] = self.weights[n - 1].get(self._tagged(keys[new] >> np.uint64(BITS), n), 1.0) * self._lower(shorter[new], n - 1)
        return p

    def log_perplexities(self, texts: list[str], groups: np.ndarray) -> np.ndarray:
        """Mean negative log probability of each text's symbols; nan where there are none."""
        keys, owner = _grams(texts, groups)
        both = np.sort((keys.astype(np.uint64) << np.uint64(20)) | owner)
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, int)
        times = np.diff(np.append(first, len(both)))
        both = both[first]
        keys, of = both >> np.uint64(20), (both & np.uint64((1 << 20) - 1)).astype(int)
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        logs = np.repeat(-np.log(self._lower(keys[start], ORDER)), np.diff(np.append(start, len(keys))))
        total = np.bincount(of, times * logs, len(texts))
        n = np.bincount(of, times, len(texts))
        return np.divide(total, n, out=np.full(len(texts), np.nan), where=n > 0)

    def mixed_log_perplexities(self, texts: list[str], group: int) -> np.ndarray:
        """log_perplexities(), but where a text's is over MIXED beyond its group's mean, each SEGMENT symbols take the group that suits them best: texts of several languages are no junk."""
        out = np.concatenate([self.log_perplexities(texts[s], np.full(len(texts[s]), group)) for s in _runs(texts)])
        at = np.flatnonzero(out > self.means.get(group, np.inf) + MIXED)
        far = [texts[i] for i in at]
        for s in _runs(far):
            least, sizes = None, np.array([len(t) for t in far[s]])
            segments = -(-sizes // SEGMENT)
            start = np.cumsum(segments) - segments
            for g in self.means:
                keys, owner = _grams(far[s], np.full(len(sizes), g))
                found, of = np.unique(keys, return_inverse=True)
                place = np.arange(len(keys)) - (np.cumsum(sizes) - sizes)[owner]
                sums = np.bincount(start[owner] + place // SEGMENT, -np.log(self._lower(found.astype(np.uint64), ORDER))[of], segments.sum())
                least = sums if least is None else np.minimum(least, sums)
            out[at[s]] = np.add.reduceat(least, start) / sizes
        return out


def language_group(lang: Column) -> Column:
    """Place of the row's language in GROUPS."""
    found = F.array_position(F.array(*map(F.lit, LANGUAGES)), F.lower(F.coalesce(lang, F.lit(""))))
    return F.when(found > 0, found - 1).otherwise(F.lit(len(LANGUAGES))).cast("int")


#: Texts are taken together up to so many characters; keys of a run are counted at once.
RUN_CHARS = 2_000_000


def _runs(texts: list[str]) -> Iterator[slice]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= RUN_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def count_grams(docs: DataFrame) -> DataFrame:
    """gram, n: how often each key (group and symbols) comes in all rows."""
    small_batches(docs.sparkSession)
    size = len(GROUPS) << (BITS * ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality_rules")
        counts = np.zeros(size, np.int64)
        for batch in batches:
            texts, groups = [x or "" for x in batch.column(0).to_pylist()], batch.column(1).to_numpy()
            for s in _runs(texts):
                keys, n = np.unique(_grams(texts[s], groups[s])[0], return_counts=True)
                counts[keys] += n
        keys = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts[keys], pa.int64())], ["gram", "n"])

    partial = docs.select(F.col("text").cast("string"), language_group(F.col("lang"))).mapInArrow(run, "gram long, n long")
    return partial.groupBy("gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> KneserNey:
    found = count_grams(docs).toArrow()
    order = np.argsort(keys := found["gram"].to_numpy())
    return KneserNey(keys[order], found["n"].to_numpy()[order])


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    bytes_ = np.frombuffer(raw, np.uint8)
    chars = int(((bytes_ & 0xC0) != 0x80).sum())
    bare = len(raw.translate(None, _SPACES))
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    return len(words), chars - (len(raw) - bare), len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    h = np.array(list(map(hash, words)), np.int64).view(np.uint64)
    keys = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, keys)
    again = twice[np.minimum(at, len(twice) - 1)] == keys
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCORED = ", ".join(["doc_id long", "digest_a long", "digest_b long", *(f"{c} long" for c in _COUNTS), "base_failed boolean", "language_group int", "log_perplexity double", "symbol_perplexity double"])
_SCORED_TYPES = [*[pa.int64()] * 8, pa.bool_(), pa.int32(), pa.float64(), pa.float64()]


@lru_cache(1)
def _class_logs() -> np.ndarray:
    """Log of the number of characters of each class of marks or of letters outside Latin; 0 of others."""
    out = np.zeros(CLASSES)
    found, n = np.unique(_classes()[:0x10000], return_counts=True)
    out[found] = np.log(n)
    out[:58] = 0
    return out


def spelling(model: KneserNey, words: list[str], group: int) -> np.ndarray:
    """Log probability of each word's characters and the blank behind it."""
    out = []
    for start in range(0, len(words), 200_000):
        part = words[start : start + 200_000]
        codes = symbols("".join(["  " + w + " " for w in part]))  # each begins after blanks, as a text does
        sizes = np.fromiter(map(len, part), np.int64, len(part)) + 1
        ends = np.cumsum(sizes + ORDER - 1)
        owner = np.repeat(np.arange(len(part)), sizes)
        at = np.arange(len(owner)) + (ORDER - 1) * (owner + 1)
        key = codes[at].astype(np.uint32)
        for back in range(1, ORDER):
            key |= codes[at - back] << np.uint32(BITS * back)
        key |= np.uint32(group << (BITS * ORDER))
        found, of = np.unique(key, return_inverse=True)
        logs = np.log(model._lower(found.astype(np.uint64), ORDER))[of] - _class_logs()[codes[at]]
        assert not len(ends) or ends[-1] == len(codes)
        out.append(np.bincount(owner, logs, len(part)))
    return np.concatenate(out) if out else np.zeros(0)


def digest(text: Column, group: Column) -> list[Column]:
    """Two hashes of all that a verdict depends on besides the other rows."""
    return [F.xxhash64(F.lit(seed), F.coalesce(text.cast("string"), F.lit("")), group) for seed in (1, 2)]


def score(docs: DataFrame, model: KneserNey) -> DataFrame:
    """doc_id, digest_a and digest_b of its text and language, the counts, base_failed, language_group, log_perplexity (of words) and symbol_perplexity (its log too) of every document, written."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    group = language_group(F.col("lang"))
    a, b = digest(F.col("text"), group)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), a.alias("digest_a"), b.alias("digest_b"), "text", "lang")

    def describe(texts: list[str], words: list[str], number: int) -> tuple[list[pa.Array], np.ndarray]:
        counts = [base_counts(t.encode("utf-8", "replace")) for t in texts]
        columns = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)]
        failed = [n < MIN_WORDS or 100 * again > MAX_REPEATED * n for n, _, _, _, again in counts]
        logs = shared.value.mixed_log_perplexities(texts, number)
        return [*columns, pa.array(failed, pa.bool_()), pa.array(logs, pa.float64(), mask=np.isnan(logs))], spelling(shared.value, words, number)

    def result(columns: list[pa.Array], logs: np.ndarray, number: int) -> list[pa.Array]:
        return [*columns[:-1], pa.array(np.full(len(logs), number), pa.int32()), pa.array(logs, pa.float64(), mask=np.isnan(logs)), columns[-1]]

    runs, chars = word_model.dealt(rows, group, describe, ("doc_id", "digest_a", "digest_b"))
    answers, stats = word_model.answers(runs, chars)
    return word_model.scored(runs, answers, chars, stats, _SCORED, _SCORED_TYPES, result)


def bands(scored: DataFrame) -> DataFrame:
    """language_group, upper (of words), symbols_lower, symbols_upper: a row for each of the groups at most."""
    q = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000)
    rows = scored.filter(~F.col("base_failed")).groupBy("language_group").agg(q("log_perplexity").alias("w"), q("symbol_perplexity").alias("s"))
    end = lambda c, at, sign: F.col(c)[1] + F.greatest(F.abs(F.col(c)[at] - F.col(c)[1]), F.lit(LEAST)) * sign * SPREAD
    return rows.select("language_group", end("w", 2, 1).alias("upper"), end("s", 0, -1).alias("symbols_lower"), end("s", 2, 1).alias("symbols_upper"))


def judge(rows: DataFrame) -> DataFrame:
    """Adds perplexity and kept to what score() gives; bands come from all of the rows."""
    inside = (F.col("log_perplexity") <= F.col("upper")) & F.col("symbol_perplexity").between(F.col("symbols_lower"), F.col("symbols_upper"))
    joined = rows.join(F.broadcast(bands(rows)), "language_group", "left")  # len(GROUPS) rows at most
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).withColumn("perplexity", F.exp("log_perplexity"))


def rule_report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and perplexity of every document."""
    return judge(score(docs, train(docs))).select("doc_id", *_COUNTS, "base_failed", "kept", "perplexity")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of docs, whatever their names.

    A verdict depends on text and language alone, so rows meet it by those (and their id, which
    deals copies of one text to many tasks).
    """
    kept = judge(score(docs, train(docs))).filter("kept")
    keys = ["digest_a", "digest_b", "id"]
    kept = kept.select("digest_a", "digest_b", F.coalesce("doc_id", F.lit(-1)).alias("id")).distinct()
    a, b = digest(F.col("text"), language_group(F.col("lang")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), a.alias("digest_a"), b.alias("digest_b"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"))
    return rows.join(kept, keys, "left_semi").select("row.*")
