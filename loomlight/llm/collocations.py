"""Phrase collocation mining: hashed bucket counts (PCY, DHP) and Apriori pruning before exact counts.

A pass over the texts for each length. The pass that counts words exactly also counts hashed
buckets of pairs; the pass that counts phrases of n words counts buckets of n + 1 words.
Buckets that reach the threshold become a bitmap, and so do the phrases that reach it (by
their hash); both are broadcast. A phrase of n words is counted exactly only if its bucket is
in the bitmap and its first and last n - 1 words are in the bitmap of frequent phrases
(Apriori). Bitmaps only ever let too much through, so results are exact; with BITS bits
each (2 MB) they are bounded whatever the corpus, and prune less beyond some billion words.

Each task works in pieces of WORDS words: words get numbers, places whose phrases are not allowed
go before anything is sorted, the others' phrases are sorted arrays of numbers (buckets are counted
from the hashes at the places), and only distinct phrases with their counts leave the task; Spark adds them up. So
a phrase that stands in every text is one row a piece, and texts are never shuffled. Counts that reach the
threshold are written after each pass.

Lower case is of A to Z only. Texts are cut at DELIMITERS to pieces, pieces at blanks and tabs to
words; phrases stay within a piece. Everything is by language, null languages are "und";
null and empty texts have no words. Repeated rows count each, ids are not read, other columns
neither. Empty tables give no rows. A long text may be of any size that an Arrow batch can hold.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mixed, release, small_batches, texts_as_bytes

#: Words of the longest phrases, times a phrase must come, share of a phrase's times (in percent) that a longer one may not reach, phrases of a language.
LONGEST, LEAST, COVERED, TOP = 3, 10, 50, 2000
#: Bits of a bitmap, as a power of two.
BITS = 24
#: Words that a task counts at a time.
WORDS = 1_500_000
#: The score is this times a * a / (l * r).
SCALE = 1_000_000
DELIMITERS = b".,;:!?\n\x0b\x0c\r"
_ONE_MARK = bytes.maketrans(DELIMITERS + b"\t", b"\n" * len(DELIMITERS) + b" ")
_MARK, _EMPTY = 0, 1


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    found = np.fromiter((zlib.crc32(w, seed) | zlib.adler32(w, seed) << 32 for w in words), np.uint64, len(words))
    return mixed(np.full(len(words), seed, np.uint64), found)


class Bitmap:
    """Bits as bytes that travel."""

    def __init__(self, bits: int, longs: list[tuple[int, int]]) -> None:
        self.bits, words = bits, np.zeros(1 << (bits - 6), np.int64)
        for place, value in longs:
            words[place] = value
        self.raw = words.view(np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = slots(hashes, self.bits)
        return (self.raw[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) != 0


class Piece:
    """Words of one language that are counted together."""

    def __init__(self, lang: str) -> None:
        self.lang, self.ids = lang, defaultdict(count(2).__next__, {b"\n": _MARK, b"": _EMPTY})
        self.parts: list[np.ndarray] = []
        self.size = 0
        self._found: tuple[np.ndarray, np.ndarray] | None = None

    def add(self, text: bytes) -> None:
        words = text.lower().translate(_ONE_MARK).replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
        self.parts += [found[found != _EMPTY], np.full(1, _MARK, np.int32)]
        self.size += len(words)
        self._found = None

    def _words(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of the word at each place (0: none), and the hashes of words by number."""
        if self._found is None:
            place = np.concatenate([np.zeros(1, np.int32), *self.parts])
            self._found = np.where(place > _EMPTY, place, 0).astype(np.int64), word_hashes(list(self.ids), self.lang)
        return self._found

    def _ends(self, length: int, allowed: list[tuple[Bitmap, Bitmap]]) -> tuple[np.ndarray, np.ndarray]:
        """The places where phrases of a length end that allowed lets through, and the hashes of these phrases."""
        last, hashes = self._words()
        at, known = np.flatnonzero(last), hashes[last[last > 0]]
        for n in range(2, length + 1):
            # both shorter phrases in it may count: they end here and one place before
            pair = np.flatnonzero(at[1:] == at[:-1] + 1)
            found = mixed(known[pair], hashes[last[at[pair + 1]]])
            if n - 2 < len(allowed):
                buckets, shorter = allowed[n - 2]
                # whether the bucket, the words but the last and the words but the first of each phrase are allowed
                frequent = shorter.has(known)
                good = frequent[pair] & frequent[pair + 1] & buckets.has(found)
                pair, found = pair[good], found[good]
            at, known = at[pair + 1], found
        return at, known

    def buckets(self, length: int, allowed: list[tuple[Bitmap, Bitmap]], bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the phrases of a length that allowed lets through, and how many phrases come in each."""
        return np.unique(slots(self._ends(length, allowed)[1], bits).astype(np.int32), return_counts=True)

    def phrases(self, length: int, allowed: list[tuple[Bitmap, Bitmap]], spell: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct phrases of a length that allowed lets through (their words, if spell), their times and hashes."""
        last, hashes = self._words()
        at, _ = self._ends(length, allowed)
        rows = [last[at - length + 1 + i] for i in range(length)]
        each = len(hashes).bit_length()
        if length * each < 64:
            packed = np.zeros(len(at), np.int64)
            for row in rows:
                packed = packed << each | row
            distinct, times = np.unique(packed, return_counts=True)
            rows = [distinct >> each * (length - 1 - i) & (1 << each) - 1 for i in range(length)]
        else:
            rows, times = np.unique(np.stack(rows), axis=1, return_counts=True)
        known = hashes[rows[0]]
        for row in rows[1:]:
            known = mixed(known, hashes[row])
        words = list(self.ids) if spell else []
        return ([b" ".join(x) for x in zip(*([words[i] for i in row.tolist()] for row in rows), strict=True)] if spell else []), times, known


_ROWS = "lang string, phrase binary, bucket int, n long"


def _rows(lang: str, phrases: list[bytes] | None, buckets: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    size = len(n)
    of = [pa.nulls(size, pa.string()), pa.nulls(size, pa.binary())] if phrases is None else [pa.array([lang] * size, pa.string()), pa.array(phrases, pa.binary())]
    columns = [*of, pa.nulls(size, pa.int32()) if buckets is None else pa.array(buckets.astype(np.int32)), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "bucket", "n"])


def _pass(texts: DataFrame, length: int, longest: int, allowed: list[tuple[Bitmap, Bitmap]], bits: int, piece_words: int) -> DataFrame:
    """Counts of the phrases of a length by lang and phrase, and of the buckets of phrases longer by one; all words of a language under the empty phrase in the first pass."""
    sent = texts.sparkSession.sparkContext.broadcast(allowed)

    def counted(piece: Piece) -> Iterator[pa.RecordBatch]:
        phrases, times, _ = piece.phrases(length, sent.value, True)
        yield _rows(piece.lang, phrases, None, times)
        if length == 1:
            yield _rows(piece.lang, [b""], None, times.sum(keepdims=True))
        if length < longest:
            slot, times = piece.buckets(length + 1, sent.value, bits)
            yield _rows(piece.lang, None, slot, times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, Piece] = {}
        for batch in batches:
            for text, lang in zip(texts_as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                piece = pieces.setdefault(lang, Piece(lang))
                piece.add(text)
                if piece.size > piece_words:
                    yield from counted(pieces.pop(lang))
                elif sum(p.size for p in pieces.values()) > 2 * piece_words:
                    yield from counted(pieces.pop(max(pieces, key=lambda x: pieces[x].size)))
        for lang in sorted(pieces):
            yield from counted(pieces[lang])

    return texts.mapInArrow(run, _ROWS)


def _bitmap(slot_rows: DataFrame, bits: int) -> Bitmap:
    """The bits at the slots; a row for each 64 bits at most comes to the driver."""
    longs = slot_rows.groupBy(F.shiftright("slot", 6).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("value"))
    found = longs.toArrow()
    return Bitmap(bits, list(zip(found.column("place").to_pylist(), found.column("value").to_pylist(), strict=True)))


def _phrase_slots(phrases: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                words = word_hashes(phrase.split(b" "), lang)
                h = words[:1]
                for w in words[1:]:
                    h = mixed(h, w.reshape(1))
                out[i] = slots(h, bits)[0]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["slot"])

    return phrases.select("lang", "phrase").mapInArrow(run, "slot long").distinct()


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = BITS, piece_words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """lang, words, phrase, n of all phrases of 1 to longest words that come at least so often, and lang, n of all words."""
    session = docs.sparkSession
    small_batches(session)
    texts = docs.select(F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    allowed: list[tuple[Bitmap, Bitmap]] = []
    every, totals = None, None
    for length in range(1, longest + 1):
        sums = _pass(texts, length, longest, allowed, bits, piece_words).groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n"))
        counts = materialize(sums.filter((F.col("n") >= least) | (F.col("phrase") == F.lit(b""))))
        if length == 1:
            totals = counts.filter(F.col("phrase") == F.lit(b"")).select("lang", "n")
        phrases = counts.filter(F.col("phrase") != F.lit(b"")).select("lang", F.lit(length).alias("words"), "phrase", "n")
        every = phrases if every is None else every.union(phrases)
        if length < longest:
            buckets = counts.filter("bucket is not null").select(F.col("bucket").cast("long").alias("slot"))
            allowed = [*allowed, (_bitmap(buckets, bits), _bitmap(_phrase_slots(phrases, bits), bits))]
        release(session)
    return every.select("lang", "words", F.col("phrase").cast("string").alias("phrase"), "n"), totals


def _scores(phrases: DataFrame, longest: int) -> DataFrame:
    """lang, phrase, words, a, l, r, score: of the lowest-scoring cut of each phrase of two words and more."""
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("times"))
    words = F.split("phrase", " ")
    cuts = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cut = phrases.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), cuts)
    cut = cut.withColumn("left", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ")).withColumn("right", F.array_join(F.slice(words, F.col("k") + 1, F.lit(longest)), " "))
    ends = cut.join(parts.select("lang", F.col("part").alias("left"), F.col("times").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("part").alias("right"), F.col("times").alias("r")), ["lang", "right"])
    whole = lambda c: f"cast({c} as decimal(18,0))"
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * {whole('a')} * cast(a as decimal(12,0)) div ({whole('l')} * {whole('r')})")
    best = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("best")
    return ends.groupBy("lang", "phrase", "words", "a").agg(best).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def _covered(scored: DataFrame, longest: int) -> DataFrame:
    """lang, phrase, longer: the most times that a longer candidate around a phrase comes."""
    words = F.split("phrase", " ")
    spans = [(s, n) for n in range(2, longest) for s in range(1, longest - n + 2)]
    inner = F.array_compact(F.array(*(F.when((F.col("words") > n) & (F.col("words") >= s + n - 1), F.array_join(F.slice(words, s, n), " ")) for s, n in spans))) if spans else F.array().cast("array<string>")
    return scored.select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def best_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP, bits: int = BITS, piece_words: int = WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases.

    Ranks come from the best of shares of a language's phrases, so no task ranks all of them.
    """
    phrases, totals = frequent_phrases(docs, longest, least, bits, piece_words)
    scored = materialize(_scores(phrases, longest))
    left = scored.join(_covered(scored, longest), ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    order: list[Column] = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    share = F.pmod(F.xxhash64("phrase"), F.lit(256))
    near = left.withColumn("share", share).withColumn("turn", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("turn") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def best_phrases_sql(least: int = LEAST, covered: int = COVERED, top: int = TOP) -> str:
    """The same in DuckDB's SQL for phrases of two and three words."""
    return f"""
WITH pieces AS (SELECT row_number() OVER () AS d, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL)),
lists AS (SELECT d, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM lists, unnest([1, 2, 3]) ks(k), unnest(range(1, len(w) - k + 2)) s(i)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING a >= {least}),
cuts AS (SELECT f.*, j, array_to_string(string_split(phrase, ' ')[1 : j], ' ') AS x, array_to_string(string_split(phrase, ' ')[j + 1 : k], ' ') AS y FROM f, unnest([1, 2]) c(j) WHERE j < k),
scores AS (SELECT c.lang, c.k, c.phrase, c.a, j, fx.a AS l, fy.a AS r, {SCALE}::HUGEINT * c.a * c.a // (fx.a * fy.a) AS score FROM cuts c JOIN f fx ON fx.lang = c.lang AND fx.phrase = x JOIN f fy ON fy.lang = c.lang AND fy.phrase = y),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ones AS (SELECT lang, array_to_string(string_split(phrase, ' ')[i : i + 1], ' ') AS phrase, max(a) AS longer FROM best, unnest([1, 2]) s(i) WHERE k = 3 GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ones i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {covered} * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}
"""
