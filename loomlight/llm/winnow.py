"""Document fingerprints by winnowing, in DataFrame functions only.

Tokens are the lower-cased words of a text (ideographs alone, other runs without white
space in parts of at most 40 characters). Each token is hashed once; the hash of a K-gram
is the cyclic polynomial of its token hashes, cut to 40 bits. Of each window of WINDOW
consecutive grams the smallest hash is kept, of equal ones the rightmost, with its position.
Positions have 24 bits; a text of more tokens (32 MB at least) is an error, as they would wrap silently.
So two texts that share K + WINDOW - 1 = 8 consecutive tokens share a fingerprint entry.

A text of fewer than K tokens has one gram of them all, one of fewer than WINDOW grams one
window, an empty or null text no entry. Equal texts have equal fingerprints; the likeness of
two empty ones is 1. Every row has its own result, repeated rows too; a null id sorts last.

``edited_fingerprints`` needs the next document's text. Ids are cut into ranges at
quantiles of the column; rows are dealt by range (the one shuffle that carries texts), and
the first row of each range is also sent to the end of the range before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WINDOW = 5, 4
_TOKEN = r"\p{IsIdeographic}|[^\s\p{IsIdeographic}]{1,40}"
#: Low bits of an entry that hold the position, counted down so that the smallest entry is the rightmost.
_POSITION_BITS = 24
_LAST = (1 << _POSITION_BITS) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for all its uses, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _rotated(x: Column, bits: int) -> Column:
    return x if not bits else F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def _entry(gram: Column, position: Column) -> Column:
    """A sortable long: 40 bits of the hash, then the position counted down."""
    return gram.bitwiseAND(F.lit(~_LAST)).bitwiseOR(F.lit(_LAST) - position.bitwiseAND(F.lit(_LAST)))


def _grams(hashes: Column) -> Column:
    """Entries of all K-grams by position."""

    def gram(i: Column) -> Column:
        found = _rotated(F.get(hashes, i), K - 1)
        for j in range(1, K):
            found = found.bitwiseXOR(_rotated(F.get(hashes, i + F.lit(j)), K - 1 - j))
        return _entry(F.xxhash64(found), i.cast("long"))

    n = F.size(hashes)
    return (
        F.when(n >= K, F.transform(F.sequence(F.lit(0), n - K), gram))
        .when(n > 0, F.array(_entry(F.xxhash64(hashes), F.lit(0).cast("long"))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def _selected(entries: Column) -> Column:
    n = F.size(entries)
    least = lambda i: F.least(*(F.get(entries, i + F.lit(j)) for j in range(WINDOW)))
    return (
        F.when(n >= WINDOW, F.array_distinct(F.transform(F.sequence(F.lit(0), n - WINDOW), least)))
        .when(n > 0, F.array(F.array_min(entries)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def fingerprint(text: Column) -> Column:
    """The selected entries of a text, as longs, in order of position."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))
    hashes = F.transform(tokens, lambda x: F.xxhash64(x))
    long = F.raise_error(F.lit(f"a text has more than {_LAST} tokens")).cast("array<bigint>")
    return let(hashes, lambda h: F.when(F.size(h) > _LAST, long).otherwise(let(_grams(h), _selected)))


def entry_hashes(entries: Column) -> Column:
    return F.array_distinct(F.transform(entries, lambda x: F.shiftrightunsigned(x, _POSITION_BITS)))


def as_text(entries: Column) -> Column:
    """hash:position of each entry, comma-joined."""
    return F.array_join(F.transform(entries, lambda x: F.concat_ws(":", F.hex(F.shiftrightunsigned(x, _POSITION_BITS)), (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of entry hashes; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common.cast("double") / every)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of its text."""
    return docs.select("doc_id", as_text(fingerprint(F.col("text"))).alias("fingerprint"))


def _ranges(docs: DataFrame) -> list[int]:
    """Ids, the largest first, that each begin a range of about equally many rows."""
    count = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = [i / count for i in range(1, count)]
    top, cuts = docs.agg(F.max("doc_id"), F.percentile_approx("doc_id", parts, 10_000)).first()
    return sorted({top, *(cuts or [])} - {None}, reverse=True)


def with_next_text(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and next_text, that of the next row by descending id; the last row's is the first's."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    starts = _ranges(rows)
    order = [F.col("sent"), F.col("doc_id").desc_nulls_last(), F.col("text")]
    window = Window.partitionBy("part").orderBy(*order)
    if len(starts) < 2:
        one = rows.select("*", F.lit(0).alias("part"), F.lit(False).alias("sent"))
        return one.select("doc_id", "text", "part", "sent", F.coalesce(F.lead("text").over(window), F.first("text").over(window)).alias("next_text"))
    last = len(starts) - 1
    cuts = F.array(*map(F.lit, starts)).cast("array<bigint>")
    part = F.coalesce(F.size(F.filter(cuts, lambda x: x >= F.col("doc_id"))) - 1, F.lit(last))
    part = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(part)
    own = lambda p, sent: F.struct(p.cast("int").alias("part"), F.lit(sent).alias("sent"))
    placed = rows.withColumn("own", part).withColumn("starts", F.col("doc_id").isin(starts) & F.col("doc_id").isNotNull())
    before = F.when(F.col("own") == 0, F.lit(last)).otherwise(F.col("own") - 1)
    places = F.when(F.col("starts"), F.array(own(F.col("own"), False), own(before, True))).otherwise(F.array(own(F.col("own"), False)))
    dealt = placed.select("doc_id", "text", F.explode(places).alias("place")).select("doc_id", "text", "place.part", "place.sent")
    return dealt.select("doc_id", "text", "part", "sent", F.lead("text").over(window).alias("next_text"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has the last third of its code points replaced by the first as many of
    the next document.
    """
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("left(next_text, cast(floor(length(text) / 3) as int))"))
    edited = F.when(cut == 0, F.col("text")).otherwise(edited)
    made = with_next_text(docs).select("doc_id", "part", "sent", "text", n.cast("long").alias("n_chars"), F.when(~F.col("sent"), edited).alias("edited"))
    made = made.select("doc_id", "part", "sent", "n_chars", "text", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("entries"), fingerprint(F.col("edited")).alias("edited_entries"))
    made = made.withColumn("hashes", entry_hashes(F.col("entries"))).withColumn("edited_hashes", entry_hashes(F.col("edited_entries")))
    window = Window.partitionBy("part").orderBy(F.col("sent"), F.col("doc_id").desc_nulls_last(), F.col("text"))
    following = F.coalesce(F.lead("hashes").over(window), F.first("hashes").over(window))
    return (
        made.withColumn("next_hashes", following)
        .filter(~F.col("sent"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            as_text(F.col("entries")).alias("fingerprint"),
            as_text(F.col("edited_entries")).alias("edited_fingerprint"),
            likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
            likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
        )
    )
