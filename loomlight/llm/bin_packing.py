"""Best-fit packing of documents to sequences by a grouping genetic algorithm on islands.

Documents are encoded (with an end id) and only those longer than a sequence are cut, so
that all pieces but the first are full; full pieces are sequences of their own. The other
pieces are dealt by row to shards of about SHARD pieces. On each of ISLANDS islands of a
shard a population evolves: crossover injects a random half of one parent's well-filled
bins into the other, removes the bins that hold duplicates and best-fits the displaced
pieces; mutation empties the least filled bins. After each of EPOCHS but the last, each
island's elite migrates to the next island of the shard; the best packing of all islands
stands. Islands stop at the lower bound. What is left open in the shards' last bins is pooled and
packed once more in the same way.

A shard holds a bounded number of pieces whatever the corpus, so no task gathers more.
A null text is empty (its sequence part is the end id alone). Repeated rows are packed
each; null ids stay null; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from itertools import groupby
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import materialize, small_batches, worker_cache

CAPACITY = 2048
SHARD, ISLANDS = 2048, 2
POPULATION, GENERATIONS, ELITES, EPOCHS = 4, 4, 2, 3
#: Bins filled to this share are not pooled again.
CLOSED = 0.98

# --- encoding -------------------------------------------------------------------------

#: Characters that both tokenizer libraries split alike (all assigned since Unicode 6.1).
_ALIKE = re.compile("[ -~\n\t\xa1-\xac\xae-ɏ]*")
#: White space in one run that the faster library can't look back over.
LONG_SPACE = 100_000
_LONG_SPACE = re.compile("[ \n\t]{%d}" % LONG_SPACE)


def same_merges(merges: list[tuple[bytes, bytes]], ranks: dict[bytes, int]) -> bool:
    """Whether merging by rank of the joined bytes makes the same tokens as the list of merges.

    It does if no token's own derivation by rank uses a pair that isn't in the list: a run over
    a text derives each of its tokens as if the token stood alone, and a pair of the list is
    a candidate of both.
    """
    listed = set(merges)
    for token in ranks:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            if (parts[i], parts[i + 1]) not in listed:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return True


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Encoder:
    """Ids of texts, little-endian unsigned 32-bit.

    The tokenizers library defines them. Stretches of characters that both libraries split
    alike go through the faster one of the same vocabulary, whole, with no table of chunks
    beside it, but for those with LONG_SPACE characters of white space in a run; tests hold same_merges() for the pair of files.
    """

    def __init__(self, json_path: str, ranks_path: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        self.model = chunks.byte_tokenizer(json_path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _alike(self, text: str) -> bool:
        return _ALIKE.fullmatch(text) is not None and "<|" not in text and (len(text) < LONG_SPACE or not _LONG_SPACE.search(text))

    def _part(self, text: str, alike: bool) -> bytes:
        if alike:
            return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
        return _packed(self.model.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if self._alike(text):
            return self._part(text, True)
        first, rest = chunks.space_chunks(text)  # tokens never cross a boundary of these
        parts = [first, *(" " + x for x in rest)]
        return b"".join(self._part("".join(run), alike) for alike, run in groupby(parts, self._alike))


def encoder_of(json_path: str, ranks_path: str) -> Encoder:
    """The worker's encoder of these files."""
    kept = worker_cache("bin_packing")
    if json_path not in kept:
        kept[json_path] = Encoder(json_path, ranks_path)
    return kept[json_path]


def encode_ids(texts: list[str], json_path: str, ranks_path: str) -> Iterator[bytes]:
    """Ids of each text, little-endian unsigned 32-bit."""
    return map(encoder_of(json_path, ranks_path).encode, texts)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, ranks: str, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("bin_packing")
        import public_tokenizers

        json_path, ranks_path = public_tokenizers.path(tokenizer), public_tokenizers.path(ranks)
        end = _packed([end_id])
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_ids([x or "" for x in batch.column(1).to_pylist()], json_path, ranks_path), strict=True):
                ids += end
                rows += [(doc_id, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the genetic algorithm --------------------------------------------------------------

Packing = list[list[int]]


class Bins:
    """Bins by what is free in them; best_fit() takes the fullest that has room."""

    def __init__(self, lengths: list[int], bins: Packing, capacity: int) -> None:
        self.lengths, self.bins, self.capacity = lengths, bins, capacity
        self.by_free: dict[int, list[int]] = {}
        self.mask = 0
        for i, items in enumerate(bins):
            self._put(i, capacity - sum(map(lengths.__getitem__, items)))

    def _put(self, i: int, free: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(i)
            self.mask |= 1 << free

    def best_fit(self, items: list[int]) -> Packing:
        for item in items:
            n = self.lengths[item]
            rest = self.mask >> n
            if rest:
                free = n + (rest & -rest).bit_length() - 1
                at = self.by_free[free]
                i = at.pop()
                if not at:
                    self.mask ^= 1 << free
                self.bins[i].append(item)
                self._put(i, free - n)
            else:
                self.bins.append([item])
                self._put(len(self.bins) - 1, self.capacity - n)
        return self.bins


class Islander:
    """A population of packings of one shard."""

    def __init__(self, lengths: list[int], seed: int, capacity: int = CAPACITY) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.random = random.Random(seed)
        self.least = ceil(sum(lengths) / capacity)

    def fill(self, items: list[int]) -> int:
        return sum(map(self.lengths.__getitem__, items))

    def fitness(self, packing: Packing) -> tuple[int, float]:
        """Fewer bins, then bins as unequal as can be."""
        return -len(packing), sum(self.fill(b) ** 2 for b in packing) / len(packing)

    def ordered(self, items: list[int], noise: float) -> list[int]:
        return sorted(items, key=lambda i: -self.lengths[i] * (1 + noise * self.random.random()))

    def start(self) -> list[Packing]:
        every = range(len(self.lengths))
        first = Bins(self.lengths, [], self.capacity).best_fit(self.ordered(list(every), 0))
        if len(first) == self.least:
            return [first]
        return [first] + [Bins(self.lengths, [], self.capacity).best_fit(self.ordered(list(every), 0.3)) for _ in range(POPULATION - 1)]

    def crossover(self, a: Packing, b: Packing) -> Packing:
        full = sorted(a, key=self.fill, reverse=True)[: max(1, 2 * len(a) // 3)]
        injected = self.random.sample(full, max(1, len(full) // 2))
        held = {i for items in injected for i in items}
        kept, displaced = [list(items) for items in injected], []
        for items in b:
            if held.isdisjoint(items):
                kept.append(list(items))
            else:
                displaced += [i for i in items if i not in held]
        return Bins(self.lengths, kept, self.capacity).best_fit(self.ordered(displaced, 0.05))

    def mutated(self, packing: Packing) -> Packing:
        by_fill = sorted(packing, key=self.fill)
        count = min(len(by_fill), 2 + self.random.randrange(4))
        emptied = by_fill[:count] + (self.random.sample(by_fill[count:], 1) if len(by_fill) > count else [])
        gone = {id(x) for x in emptied}
        return Bins(self.lengths, [list(x) for x in by_fill if id(x) not in gone], self.capacity).best_fit(self.ordered([i for x in emptied for i in x], 0.05))

    def evolve(self, population: list[Packing]) -> list[Packing]:
        """The elite after GENERATIONS, best first; at once if the lower bound is reached."""
        ranked = sorted(population or self.start(), key=self.fitness, reverse=True)
        for _ in range(GENERATIONS):
            if len(ranked[0]) <= self.least:
                break
            mates = ranked[:POPULATION]
            children = []
            for a in mates[: POPULATION // 2]:
                b = self.random.choice(mates)
                children += [self.crossover(a, b), self.mutated(self.crossover(b, a))]
            ranked = sorted(ranked + children, key=self.fitness, reverse=True)[:POPULATION]
        return ranked[:ELITES]


def _bin_of(packing: Packing, n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(packing):
        for i in items:
            out[i] = b
    return out


def _packing_of(bins: list[int]) -> Packing:
    out: Packing = [[] for _ in range(max(bins, default=-1) + 1)]
    for i, b in enumerate(bins):
        out[b].append(i)
    return out


_ITEMS = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def _epoch(islands: DataFrame, items: str, capacity: int, salt: int) -> DataFrame:
    """shard, island, items, elites after an epoch; elites in the input are migrants and survivors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("bin_packing")
        for batch in batches:
            made = []
            for shard, island, rows, before in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                at = Islander([r["length"] for r in rows], hash((shard, island, salt)), capacity)
                elite = at.evolve([_packing_of(x) for x in before or []])
                made.append([_bin_of(x, len(rows)) for x in elite])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.list_(pa.list_(pa.int32())))], ["shard", "island", "items", "elites"])

    return islands.select("shard", "island", "items", "elites").mapInArrow(run, f"shard long, island int, items {items}, elites array<array<int>>")


def _evolved(rows: DataFrame, count: int, level: int, capacity: int) -> DataFrame:
    """The pieces with sequence_id, offset and fill (of their sequence)."""
    session = rows.sparkSession
    small_batches(session, 16)
    shards = ceil(count / SHARD)
    columns = rows.columns
    item = rows.schema.simpleString()
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    gathered = dealt.groupBy("shard").agg(F.collect_list(F.struct(*columns)).alias("items"))  # about SHARD rows each
    items = f"array<{item}>"
    islands = gathered.withColumn("elites", F.lit(None).cast("array<array<int>>")).withColumn("island", F.explode(F.array(*map(F.lit, range(ISLANDS)))))
    own, before = (F.element_at("by_island", x) for x in (F.col("island"), F.pmod(F.col("island") + F.lit(ISLANDS - 1), F.lit(ISLANDS))))
    for epoch in range(1, EPOCHS):
        settled = materialize(_epoch(islands, items, capacity, epoch))
        # migration: each island keeps its elite and takes the best of the one before
        together = settled.groupBy("shard").agg(F.first("items").alias("items"), F.map_from_entries(F.collect_list(F.struct("island", "elites"))).alias("by_island"))
        spread = together.withColumn("island", F.explode(F.array(*map(F.lit, range(ISLANDS)))))
        islands = spread.withColumn("elites", F.concat(own, F.slice(before, 1, 1)))
    ended = _epoch(islands, items, capacity, EPOCHS)
    last = ended.groupBy("shard").agg(F.first("items").alias("items"), F.flatten(F.collect_list("elites")).alias("elites"))
    names = [*columns, "sequence_id", "offset", "fill"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shard, found, elites in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at = Islander([r["length"] for r in found], 0, capacity)
                best = max(map(_packing_of, elites), key=at.fitness)
                for b, members in enumerate(best):
                    offset, fill = 0, at.fill(members)
                    for i in members:
                        out.append((*(found[i][c] for c in columns), (level << 56) | (shard << 20) | b, offset, fill))
                        offset += found[i]["length"]
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"
    return last.mapInArrow(place, schema)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of pieces() with sequence_id and offset."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = materialize(found.select(*columns))
    full = rows.filter(F.col("length") == capacity).select("*", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    partial = rows.filter(F.col("length") < capacity)
    count = partial.count()
    if not count:
        return full
    packed = materialize(_evolved(partial, count, 0, capacity))
    # shards' last bins, pooled; packed again they need no more bins than before
    open_ = packed.filter(F.col("fill") < CLOSED * capacity)
    left = open_.count()
    again = materialize(_evolved(open_.select(*columns), left, 1, capacity)) if left else open_
    old, new = (x.select("sequence_id").distinct().count() for x in (open_, again))
    done = packed.filter(F.col("fill") >= CLOSED * capacity).union(again) if new < old else packed
    return full.union(done.select(*columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(pieces(docs, tokenizer, ranks))
