"""Quality classifier: exact nearest-neighbour voting over labelled latent-semantic vectors.

A text becomes the square roots of the shares of its hashed byte trigrams (digits alike),
of its kinds of characters and of words that repeat the one before, weighted by inverse
document frequency, and is projected on the leading right singular vectors of the labelled
sample. The labelled vectors are broadcast: PER_CLASS rows of each
label at most, RANK numbers each, so under 2 MB whatever the corpus. Every document's cosines
with all of them are computed in blocks; its K nearest vote with their similarity as
weight. If a class has more labelled rows than the sample takes, its votes count for them.

The sample: labelled rows, repeated ids once (smallest text, smallest label), those with the
smallest hash of the id. It is the only thing that is bounded; every document is scored.

An empty or null text, or one without a trigram, has the share of label 1 among the labelled
rows as its score; without any labelled row every score is 0.5. Labels other than 0 and 1
and null ids in labels are ignored. Repeated rows give repeated results.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches, texts_as_bytes, trim, worker_cache

DIMENSIONS, RANK, PER_CLASS, K = 4096, 48, 1500, 8
THRESHOLD = 0.3
#: Documents of a block of cosine products.
BLOCK = 256

_DIGITS = np.arange(256, dtype=np.uint32)
_DIGITS[48:58] = 48
#: Kinds of characters by byte: each ASCII mark is its own, then upper case, lower case, digits, the rest.
_KINDS = np.arange(256)
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[128:] = 65, 97, 48, 128
_KIND_COUNT = 129
#: Words that repeat the word before, and other words.
_REPEATS = 2
WIDTH = DIMENSIONS + _KIND_COUNT + _REPEATS
#: Of the kinds and of the repeats, against 1 of the trigrams.
_STRESS = 1.5


def features(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, of kinds of characters, and of words that repeat the one before."""
    out = np.zeros(WIDTH, np.float32)
    raw = np.frombuffer(text, np.uint8)
    if len(raw) < 3:
        return out
    x = _DIGITS[raw]
    grams = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    slots = (grams * np.uint32(2654435761)) >> np.uint32(20)
    out[:DIMENSIONS] = np.sqrt(np.bincount(slots, minlength=DIMENSIONS) / len(slots))
    out[DIMENSIONS:-_REPEATS] = _STRESS * np.sqrt(np.bincount(_KINDS[raw], minlength=_KIND_COUNT) / len(raw))
    words = text.split()
    if len(words) > 1:
        same = sum(map(eq, words, words[1:])) / (len(words) - 1)
        out[-2:] = _STRESS * np.sqrt([same, 1 - same])
    return out


@dataclass
class Neighbours:
    """idf and projection of texts; unit vectors, labels and weights of the labelled sample; the share of label 1."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    share: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.share)
        if not len(self.vectors):
            return out
        for start in range(0, len(texts), BLOCK):
            x = np.stack([features(t) for t in texts[start : start + BLOCK]])
            q = _unit((x * self.idf) @ self.projection)
            cosines = q @ self.vectors.T
            k = min(K, cosines.shape[1])
            near = np.argpartition(cosines, cosines.shape[1] - k, axis=1)[:, -k:]
            votes = np.maximum(np.take_along_axis(cosines, near, 1), 0) ** 4 * self.weights[near]
            total = votes.sum(1)
            voted = total > 0
            out[start : start + BLOCK][voted] = (votes * self.labels[near]).sum(1)[voted] / total[voted]
        return np.clip(out, 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def fit(x: np.ndarray, labels: np.ndarray, rows_of_class: dict[int, int]) -> Neighbours:
    """x: a row of features() for each labelled text, weighted in place; rows_of_class: labelled rows of each label in all."""
    total = sum(rows_of_class.values())
    share = rows_of_class.get(1, 0) / total if total else 0.5
    if not len(x):
        return Neighbours(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), labels, np.zeros(0), share)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    weighted = np.multiply(x, idf, out=x)
    # leading right singular vectors by subspace iteration from a fixed start
    rank = min(RANK, *weighted.shape)
    basis = np.random.default_rng(0).standard_normal((WIDTH, rank + 8)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    _, _, right = np.linalg.svd(weighted @ basis, full_matrices=False)
    projection = np.ascontiguousarray((basis @ right[:rank].T).astype(np.float32))
    sampled = {c: max(1, int((labels == c).sum())) for c in (0, 1)}
    weights = np.array([rows_of_class[int(c)] / sampled[int(c)] for c in labels])
    return Neighbours(idf, projection, _unit(weighted @ projection), labels.astype(np.float64), weights, share)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Neighbours:
    """From documents and labels (doc_id, quality), without the held-out rows."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = {int(c): int(n) for c, n in known.groupBy("quality").count().collect()}
    picked = [known.filter(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * per_class rows at most
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality_classifier")
        for batch in batches:
            x = [features(t).astype(np.float16).tobytes() for t in texts_as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], ["doc_id", "quality", "x"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality_classifier")
        made = pa.Table.from_batches(batches, schema=pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("x", pa.binary())])).sort_by("doc_id")
        x = np.empty((made.num_rows, WIDTH), np.float32)
        for row, sent in zip(x, made["x"], strict=True):
            row[:] = np.frombuffer(sent.as_buffer(), np.float16)
        model = fit(x, np.array(made["quality"].to_pylist(), np.int64), rows)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])
        del x, made, model
        trim()

    # the bounded sample meets in one task, so that the driver holds the model alone
    made = found.mapInArrow(run, "doc_id long, quality int, x binary").repartition(1).mapInArrow(learned, "model binary")
    sent = made.collect()
    release(docs.sparkSession)
    return pickle.loads(bytes(sent[0].model)) if sent else fit(np.empty((0, WIDTH), np.float32), np.zeros(0, np.int64), rows)


def score(docs: DataFrame, model: Neighbours) -> DataFrame:
    """All columns of docs, then score and predicted."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality_classifier")
        for batch in batches:
            s = shared.value.scores(texts_as_bytes(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())], [*batch.schema.names, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be good, with the columns of docs, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality_classifier")
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(texts_as_bytes(batch.column(at))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), train(docs, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
