"""Vector code compression: parts of vectors become numbers of codebook entries, found by exponion search.

Components become integers, floor(SCALE * x), and every distance is an exact integer. Each
part position has a codebook that starts as that part of the vectors with the smallest ids;
rounds of assigning all parts and averaging the parts of each entry refine it.

Exponion search: a part starts at the entry that it had before (entry 0 in the first round)
with squared distance d. An entry nearer than that, or as near, is within 2 * sqrt(d) of the
start by the triangle inequality, so of the start's neighbours, sorted by distance, only
those with a squared distance of at most 4 * d are looked at. Ties go to the lower index.

What travels: codebooks (parts * entries * components integers, whatever the corpus) go to
the executors; back come, for each round, sums and counts by entry, added up in each task and
then by Spark, so a vector that comes a million times is a count. Vectors never meet in a group; each round's
codes are written with the vectors, so a lost executor costs a round at most.

Rows whose vector is null or holds a null, NaN or infinite component are dropped. The length
is that of the vector with the smallest id (a multiple of the parts, else ValueError); rows
with vectors of another length are kept with null code and error and take no part in the
codebooks. Null ids come after all others, equal ids go by their vectors; repeated rows are
coded each. Components of any finite size are exact: where squares might pass 63 bits, Python's
integers do the work, and sums travel in limbs. An error, or a sum of them, past 63 bits is
given as the largest long. Fewer vectors than entries make fewer entries; empty tables give no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are searched at a time.
BLOCK = 2048
#: Components below this have exact squares and sums in 64 bits, for up to a thousand of them.
SMALL = 1 << 25
LARGEST = (1 << 63) - 1
#: Bits of a limb of a sum; a task's sums of small components fit in one.
LIMB = 48


def integers(vectors: list) -> np.ndarray:
    """floor(SCALE * x) of all components, in 64 bits if they are small, else as Python's integers."""
    x = np.asarray(vectors, np.float64)
    if not x.size or np.abs(x).max() * SCALE < SMALL:
        return np.floor(x * SCALE).astype(np.int64)
    exact = [[(n * SCALE) // d for n, d in (float(c).as_integer_ratio() for c in row)] for row in x.tolist()]
    return np.array(exact, object).reshape(x.shape)


@dataclass
class Codebook:
    """entries (entry, component) of one part position, and for each the others by distance."""

    entries: np.ndarray

    def __post_init__(self) -> None:
        between = ((self.entries[:, None, :] - self.entries[None, :, :]) ** 2).sum(2)
        self.near = np.argsort(between, axis=1, kind="stable")
        self.reach = np.take_along_axis(between, self.near, 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row of x, from the entries at start."""
        entries = self.entries
        if x.dtype == object or np.abs(entries).max(initial=0) >= SMALL:
            x, entries = x.astype(object), entries.astype(object)
        least = ((x - entries[start]) ** 2).sum(1)
        best = start.copy()
        within = np.empty(len(x), np.int64)
        for entry in np.unique(start):
            own = start == entry
            within[own] = np.searchsorted(self.reach[entry], 4 * least[own], "right")
        order = np.argsort(-within, kind="stable")
        for place in range(1, int(within.max(initial=0))):  # a start's first neighbour is itself or its equal
            at = order[: np.count_nonzero(within > place)]
            other = self.near[start[at], place]
            distance = ((x[at] - entries[other]) ** 2).sum(1)
            nearer = (distance < least[at]) | ((distance == least[at]) & (other < best[at]))
            best[at[nearer]], least[at[nearer]] = other[nearer], distance[nearer]
        # entries that equal the start and have a lower index stand before or after it among its neighbours
        other = self.near[start, 0]
        distance = ((x - entries[other]) ** 2).sum(1)
        nearer = (distance < least) | ((distance == least) & (other < best))
        best[nearer], least[nearer] = other[nearer], distance[nearer]
        return best, least


def assigned(books: list[Codebook], x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries (row, part) of the vectors and their squared distances, summed over parts."""
    codes, errors = np.empty((len(x), len(books)), np.int64), np.zeros(len(x), object)
    for p, (book, part) in enumerate(zip(books, np.split(x, len(books), axis=1), strict=True)):
        codes[:, p], distance = book.nearest(part, start[:, p])
        errors = errors + distance
    return codes, errors


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """Place and value of a number's limbs; the last has its sign."""
    place = 0
    while not -(1 << LIMB) < total < 1 << LIMB:
        yield place, total & ((1 << LIMB) - 1)
        total >>= LIMB
        place += 1
    yield place, total


def _books(codebooks: np.ndarray) -> list[Codebook]:
    return [Codebook(x) for x in codebooks]


_SUMS = "part int, entry int, position int, limb int, total long"
_CODED = "id long, label string, vector array<double>, codes binary, error long"


def _coded(vectors: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """The rows with the entry of each part and the error."""
    sent = vectors.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = integers(batch.column("vector").to_pylist())
                before = [c or bytes(len(books)) for c in batch.column("codes").to_pylist()]
                codes, errors = assigned(books, x, np.frombuffer(b"".join(before), np.uint8).reshape(len(x), -1).astype(np.int64))
                columns = [batch.column("id"), batch.column("label"), batch.column("vector"), pa.array([bytes(c) for c in codes.astype(np.uint8)], pa.binary()), pa.array([min(int(e), LARGEST) for e in errors], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "vector", "codes", "error"])

    return vectors.select("id", "label", "vector", "codes").mapInArrow(run, _CODED)


def _means(coded: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after a round: floor(sum / count) of each entry's parts; unused entries stay."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = integers(batch.column("vector").to_pylist())
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(x), parts).astype(np.int64)
                for p, own in enumerate(np.split(x, parts, axis=1)):
                    added = np.zeros((entries, width), x.dtype)
                    np.add.at(added, codes[:, p], own)
                    sums[p] += added
                    counts[p] += np.bincount(codes[:, p], minlength=entries)
        rows = [(p, e, -1, 0, int(counts[p, e])) for p, e in zip(*np.nonzero(counts), strict=True)]
        rows += [(p, e, i, limb, value) for p, e, *_ in rows for i in range(width) for limb, value in _limbs(int(sums[p, e, i]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(map(int, c), t) for c, t in zip(zip(*rows, strict=True), [*[pa.int32()] * 4, pa.int64()], strict=True)], names=[c.split()[0] for c in _SUMS.split(", ")])

    summed = coded.select("vector", "codes").mapInArrow(run, _SUMS).groupBy("part", "entry", "position", "limb").agg(F.sum("total").alias("total"))
    out, totals, counts = codebooks.astype(object), {}, {}
    for part, entry, position, limb, total in summed.collect():  # a row for each number of the codebooks
        if position < 0:
            counts[part, entry] = total
        else:
            totals[part, entry, position] = totals.get((part, entry, position), 0) + (total << (LIMB * limb))
    for (part, entry, position), total in totals.items():
        out[part, entry, position] = total // counts[part, entry]
    return _narrowed(out)


def _narrowed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if not x.size or np.abs(x).max() < SMALL else x


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in codebooks.reshape(-1)).encode()).hexdigest()


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """The final codebooks (part, entry, component), and the rows with codes and errors after them.

    vectors: id, label, vector (finite, one length).
    """
    if entries > 256:
        raise ValueError("codes are bytes")
    first = vectors.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    start = integers([list(r.vector) for r in first])
    if start.shape[1] % parts:
        raise ValueError(f"vectors of {start.shape[1]} components have no {parts} equal parts")
    codebooks = np.stack(np.split(start, parts, axis=1))
    coded = vectors.withColumn("codes", F.lit(None).cast("binary"))
    for _ in range(rounds):
        coded = materialize(_coded(coded, codebooks))
        codebooks = _means(coded, codebooks)
    return codebooks, materialize(_coded(coded, codebooks))


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (of all rows of the label, nulls together), codebooks_sha256."""
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), vector.alias("vector")).filter(finite(F.col("vector")))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").select(F.size("vector").alias("n")).limit(1).collect()
    if not first:
        return rows.select(F.col("id").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    same = F.size("vector") == first[0].n
    codebooks, coded = trained(rows.filter(same), parts, entries, rounds)
    other = rows.filter(~same).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    every = coded.select("id", "label", F.lower(F.hex("codes")).alias("code"), "error").unionByName(other)
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return every.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))


def compress_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL, by comparing every part with every entry; for components whose squares fit 63 bits."""
    out = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT r, p, list_transform(embedding[p * (len(embedding) // {parts}) + 1 : (p + 1) * (len(embedding) // {parts})], lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS v FROM kept, range({parts}) t(p)),
book0 AS (SELECT p, r - 1 AS e, v FROM x WHERE r <= {entries})"""
    for i in range(rounds + 1):
        out += f""",
near{i} AS (SELECT r, p, min(d) AS d, arg_min(e, (d, e)) AS e FROM (SELECT x.r, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN book{i} b USING (p)) GROUP BY r, p)"""
        if i < rounds:
            out += f""",
mean{i} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT n.p, n.e, i, CAST((sum(x.v[i]) - ((sum(x.v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM near{i} n JOIN x USING (r, p), unnest(range(1, len(x.v) + 1)) u(i) GROUP BY n.p, n.e, i) GROUP BY p, e),
book{i + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN mean{i} m ON m.p = b.p AND m.e = b.e)"""
    return f"""{out},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS s FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM kept JOIN coded USING (r), digest
"""
