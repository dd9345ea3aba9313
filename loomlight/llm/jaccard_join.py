"""N-gram Jaccard join: a size-aware join with a light and a heavy side, exact at its threshold.

A document's set holds the hashes of its distinct shingles. Two sets of a and b elements
link when 100 * overlap >= percent * union, that is when they share c(a, b) elements.

* Light side, sets up to ``boundary()`` elements: every subset of c(a, b) elements is
  enumerated for each pair of sizes that can link. Sets that share such a subset link, no
  check is needed, and a star to one set of the smaller size joins them all.
* Heavy side, larger sets (and light ones that can link with them): inverted lists. Lists of
  single shingles would be scanned in vain for every common phrase, so elements are dealt to
  more parts than two linking sets of a size class can differ in, and a list is kept for
  each part's content. There are enough parts that linking sets of a class share at least
  ``Threshold.shared`` lists; so each set leaves all but the last of so many of its longest
  lists, in one order for all, and linking sets still meet in a list. Lists with
  the same member at their head become one. Lists are scanned in stars: each member is checked with one leader. Lists that still hold several components are
  then scanned whole, in blocks of at most BLOCK members by BLOCK, and give the pairs of
  different components that may link, in SHARES: each share is checked and joined before the
  next is taken. So no link between components is lost, and groups of near copies never turn
  into all their pairs.

Before texts are fetched, a pair must pass a bound by sketches: elements are dealt to about
four parts for each difference allowed, a byte stands for each part's content, and each
byte that differs is a difference at least. A link never fails that bound.

The boundary is the largest size up to which enumerating costs less than the lists of a set
and the check of a candidate, in rows (see ``boundary``).

Equal sets are one class: a task makes keys for the first of them only, and the class has one
representative. Checks recompute both sets from the whole texts, which a bitmap of fixed
size preselects. Sets are never collected; the driver sees counts and that bitmap only.

Null or empty texts, or texts without a word: the empty set, linked with nothing. Rows that
share a doc_id are one document with the links of both. A null doc_id links with nothing and
has a null component. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import compact, materialize, release, small_batches, texts_as_bytes, worker_cache
from .components import components, joined

#: Cost of checking a candidate (two texts fetched and cut), in rows of a list.
CHECK_COST = 32
#: Sizes of a class are within this ratio.
CLASS_RATIO = 1.33
#: Bits of a list's key that hold its class.
CLASS_BITS = 6
LAST_CLASS = (1 << CLASS_BITS) - 1
#: Rounds of stars before lists are scanned whole.
STAR_ROUNDS = 1
#: Whole scans take the pairs up to these shares of all, by a hash of the pair. What the first
#: few pairs join needs no look in the next; the last share is all, so every pair is taken.
SHARES = (1 / 16, 1.0)
#: Members of a list that one task compares with as many others.
BLOCK = 1024
#: Lists are met in so many shares of the keys, each of which frees its shuffle before the next.
WAVES = 6
BITMAP_BITS = 22

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, width: int = 3) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of the whole sequence, if there are fewer words."""
    words = text.translate(_LOWER).split()
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\0" + b" ".join(words))] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    found = np.zeros(n, np.uint64)
    for i in range(width):
        found = mix(found * _A + h[i : i + n] * _B + _C)
    return np.unique(found)


class Threshold:
    """What a percentage of the union means for sizes, subsets and parts."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.boundary = self._boundary()

    def overlap(self, a: int, b: int) -> int:
        """The least overlap of linking sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def partners(self, n: int) -> range:
        """Sizes that a set of n elements can link with."""
        return range(-(-self.percent * n // 100), 100 * n // self.percent + 1)

    def subsets(self, n: int) -> list[tuple[int, int, int]]:
        """(smaller size, larger size, subset size) of each enumeration of a light set."""
        return [(min(n, b), max(n, b), c) for b in self.partners(n) if b and (c := self.overlap(n, b)) <= min(n, b)]

    def _boundary(self) -> int:
        n = 1
        while sum(comb(n + 1, c) for _, _, c in self.subsets(n + 1)) <= self._differences(n + 1) + CHECK_COST:
            n += 1
        return n

    def differences(self, a: int, b: int) -> int:
        """The most elements in one of two linking sets of these sizes only."""
        return a + b - 2 * self.overlap(a, b)

    def _differences(self, largest: int) -> int:
        """The most elements in one of two linking sets only, of up to ``largest`` elements each."""
        return max(s - 2 * -(-self.percent * s // (100 + self.percent)) for s in range(max(1, 2 * largest - 60), 2 * largest + 1))

    @lru_cache(4096)  # noqa: B019  a few objects of this kind exist
    def _starts(self, upto: int) -> list[int]:
        out = [-(-self.percent * (self.boundary + 1) // 100)]
        while out[-1] <= upto:
            out.append(int(out[-1] * CLASS_RATIO) + 1)
        return out

    def _spare(self, differences: int) -> tuple[int, int]:
        """Parts beyond the differences, and how many of those that stay equal may be empty.

        A quarter more parts let a set leave so many of its longest lists that those of common
        phrases, whose pairs grow as the square of the rows, are hardly ever among the rest.
        """
        return 3 + differences // 4, 2 + differences // 16

    def shared(self, k: int) -> int:
        """The least number of lists of a class that linking sets share."""
        spare, empty = self._spare(self._differences(self._class_end(k)))
        return spare - empty

    def _class_end(self, k: int) -> int:
        starts = self._starts(1 << 12)
        while len(starts) <= k + 1:
            starts = self._starts(starts[-1] * 2)
        return starts[k + 1] - 1

    def lists(self, n: int) -> list[tuple[int, int, int]]:
        """(class, number of parts, most empty parts that need no list) of the lists that a set of n elements stands in."""
        starts = self._starts(1 << (2 * n).bit_length())
        if n < starts[0]:
            return []
        k = bisect_right(starts, n) - 1
        reach = [k, k + 1] if self.partners(n)[-1] >= starts[k + 1] else [k]
        found = []
        for c in reach:
            differences = self._differences(starts[c + 1] - 1)
            spare, empty = self._spare(differences)
            found.append((c, differences + spare, empty))
        return found


@lru_cache(8)
def threshold(percent: int) -> Threshold:
    return Threshold(percent)


def light_keys(s: np.ndarray, t: Threshold) -> tuple[list[int], list[int]]:
    """Keys of subsets, where the set is of the smaller size of the pair of sizes, and where of the larger."""
    small, large = [], []
    if 0 < len(s) <= t.boundary:
        data = [x.tobytes() for x in s]
        for a, b, c in t.subsets(len(s)):
            (small if len(s) == a else large).extend(xxhash.xxh3_64_intdigest(b"".join(x), seed=a * 1000 + b) for x in combinations(data, c))
    return small, large


def heavy_keys(s: np.ndarray, t: Threshold) -> np.ndarray:
    """Keys of the contents of parts."""
    out = []
    for c, parts, empty in t.lists(len(s)):
        part = (s % np.uint64(parts)).astype(np.int64)
        content, sizes = np.zeros(parts, np.uint64), np.bincount(part, minlength=parts)
        np.add.at(content, part, mix(s + _C))
        keys = mix(content + mix(np.arange(parts, dtype=np.uint64) + np.uint64(c << 32)) * _A)
        keys = (keys & np.uint64(~LAST_CLASS & 0xFFFFFFFFFFFFFFFF)) | np.uint64(min(c, LAST_CLASS))
        out.append(keys if (sizes == 0).sum() > empty else keys[sizes > 0])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(s: np.ndarray, t: Threshold) -> bytes:
    """A byte for each of a power of two of parts: the exclusive or of a byte of each element."""
    size = 1 << max(5, (4 * t.differences(len(s), len(s))).bit_length())
    out = np.zeros(size, np.uint8)
    np.bitwise_xor.at(out, (s & np.uint64(size - 1)).astype(np.int64), (s >> np.uint64(56)).astype(np.uint8))
    return out.tobytes()


def _folded(x: bytes, size: int) -> np.ndarray:
    """The sketch that fewer parts would give."""
    out = np.frombuffer(x, np.uint8)
    while len(out) > size:
        half = len(out) // 2
        out = out[:half] ^ out[half:]
    return out


def may_link(n: np.ndarray, sketches: list[bytes], i: int, others: np.ndarray, t: Threshold, matrix: np.ndarray | None = None) -> np.ndarray:
    """Which of the others (places in n) the set at place i may link with, by sizes and sketches."""
    a, b = np.minimum(n[i], n[others]), np.maximum(n[i], n[others])
    fit = 100 * a >= t.percent * b
    others, a, b = others[fit], a[fit], b[fit]
    if not len(others):
        return others
    most = a + b - 2 * -(-t.percent * (a + b) // (100 + t.percent))
    if matrix is None:
        size = min(len(sketches[i]), *(len(sketches[j]) for j in others))
        own, rest = _folded(sketches[i], size), np.stack([_folded(sketches[j], size) for j in others])
    else:
        own, rest = matrix[i], matrix[others]
    return others[np.count_nonzero(rest != own, axis=1) <= most]


def _lists(values: list) -> pa.Array:
    arrays = [np.asarray(v, np.uint64).view(np.int64) for v in values]
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _sets(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, n, sig and, of the first row with an id of each sig in a task, keys and sketch."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard_join")
        t, seen = threshold(percent), set()
        for batch in batches:
            n, sigs, heavy, small, large, sketches = [], [], [], [], [], []
            for raw, named in zip(texts_as_bytes(batch.column(1)), batch.column(0).is_valid().to_pylist(), strict=True):
                s = shingle_set(raw, width)
                sig = xxhash.xxh3_128_digest(s.tobytes())
                new = named and sig not in seen and len(s) > 0
                if named:
                    seen.add(sig)
                n.append(len(s))
                sigs.append(sig)
                a, b = light_keys(s, t) if new else ([], [])
                small.append(a)
                large.append(b)
                heavy.append(heavy_keys(s, t) if new else [])
                sketches.append(sketch(s, t) if new and len(heavy[-1]) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), _lists(heavy), _lists(small), _lists(large), pa.array(sketches, pa.binary())], ["doc_id", "n", "sig", "heavy", "small", "large", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, sig binary, heavy array<long>, small array<long>, large array<long>, sketch binary")


def _live(sets: DataFrame, node_of: DataFrame) -> DataFrame:
    """key, node, length of the heavy lists that hold two nodes at least, found in WAVES and written."""
    rows = None
    for wave in range(WAVES):
        lists = sets.filter(F.col("doc_id").isNotNull()).select(F.explode("heavy").alias("key"), "doc_id")
        together = lists.filter(F.pmod(F.xxhash64("key"), F.lit(WAVES)) == wave).repartition("key")
        live = together.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low != high").select("key")
        live = together.join(live, "key", "left_semi").join(node_of, "doc_id").select("key", "node").distinct()
        lengths = live.groupBy("key").agg(F.count("*").alias("length")).filter("length > 1")
        part = materialize(live.join(lengths, "key"))
        rows = part if rows is None else rows.union(part)
        del together, live  # with them go the shuffles of all lists
        release(sets.sparkSession)
    return rows


def _shorter(live: DataFrame, t: Threshold) -> DataFrame:
    """key, node without each node's longest lists of a class, one fewer than linking sets share."""
    own = F.col("key").bitwiseAND(F.lit(LAST_CLASS)).cast("int")
    shared = F.get(F.array(*(F.lit(t.shared(k)) for k in range(LAST_CLASS + 1))), own)
    longest = Window.partitionBy("node", "class").orderBy(F.desc("length"), "key")
    ranked = live.withColumn("class", own).withColumn("at", F.row_number().over(longest)).filter(F.col("at") >= shared)
    return ranked.select("key", "node")


def _by_head(lists: DataFrame) -> DataFrame:
    """key, node of lists with the same head (the member of the least hash) as one list; those of one member go."""
    heads = lists.groupBy("key").agg(F.min(F.xxhash64("node")).alias("head"), F.count("*").alias("length")).filter("length > 1").select("key", "head")
    return lists.join(heads, "key").select(F.col("head").alias("key"), "node").distinct()


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id and text of the rows whose id may be among the nodes: all of those, and few others."""
    bits = 1 << BITMAP_BITS
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)).cast("int")
    bitmap = np.zeros(bits, bool)  # as large for any corpus
    bitmap[nodes.select(slot("node").alias("s")).distinct().toArrow()["s"].to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard_join")
        wanted = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(wanted[batch.column(2).to_numpy()])).select([0, 1])

    return docs.select("doc_id", "text", slot("doc_id").alias("slot")).mapInArrow(run, "doc_id long, text string")


def _linked(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Those of the pairs (u, v) that link, by the whole sets; only texts of the pairs are fetched."""
    small_batches(pairs.sparkSession, 128)
    texts = lambda c: _texts_of(docs, pairs.select(F.col(c).alias("node"))).select(F.col("doc_id").alias(c), F.col("text").alias(f"{c}_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard_join")
        last, leader = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for raw_u, raw_v in zip(texts_as_bytes(batch.column(2)), texts_as_bytes(batch.column(3)), strict=True):
                if raw_u != last:
                    last, leader = raw_u, shingle_set(raw_u, width)
                other = shingle_set(raw_v, width)
                common = len(np.intersect1d(leader, other, assume_unique=True))
                keep.append(bool(common) and 100 * common >= percent * (len(leader) + len(other) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return pairs.join(texts("v"), "v").join(texts("u"), "u").select("u", "v", "u_text", "v_text").mapInArrow(run, "u long, v long").distinct()


def _passing(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose sketches let them link."""
    small_batches(pairs.sparkSession)
    of = lambda c: sketches.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard_join")
        t = threshold(percent)
        for batch in batches:
            keep = [
                bool(len(may_link(np.array([a, b]), [x, y], 0, np.array([1]), t)))
                for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            ]
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    both = pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "u_n", "v_n", "u_sketch", "v_sketch")
    return both.mapInArrow(run, "u long, v long").distinct()


def _pair_share(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each pair, in any order of the two."""
    low, high = np.minimum(u, v).astype(np.uint64), np.maximum(u, v).astype(np.uint64)
    return (mix(mix(low * _A + _B) + high * _C) >> np.uint64(11)) / float(1 << 53)


def _across(placed: DataFrame, lists: DataFrame, sketches: DataFrame, percent: int, above: float, upto: float) -> DataFrame:
    """Pairs (u, v) of one list and different components whose sketches let them link, of the share above ... upto.

    placed: key, node, component; lists: key, length of the lists to scan. A long list is cut
    to blocks, and each two blocks meet in a group of their own.
    """
    small_batches(placed.sparkSession)
    rows = placed.join(lists, "key").join(sketches, "node")
    blocks = F.ceil(F.col("length") / BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "n", "sketch")

    def pairs_of(group: list[tuple], t: Threshold) -> list[tuple[int, int]]:
        i, j = group[0][1], group[0][2]
        own, node, component, n = (np.array([r[c] for r in group]) for c in (3, 4, 5, 6))
        if len(np.unique(component)) < 2:
            return []
        sketches_ = [r[7] for r in group]
        size = min(map(len, sketches_))
        matrix = np.stack([_folded(x, size) for x in sketches_])
        found = []
        for a in range(len(group) - 1):
            others = np.arange(a + 1, len(group))
            apart = component[others] != component[a]
            if i != j:
                apart &= own[others] != own[a]
            share = _pair_share(node[a], node[others])
            apart &= (share >= above) & (share < upto)
            found += [(node[a], node[b]) for b in may_link(n, sketches_, a, others[apart], t, matrix)]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("jaccard_join")
        t, group = threshold(percent), []

        def made(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([int(x[c]) for x in found], pa.int64()) for c in (0, 1)], ["u", "v"])

        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    found += pairs_of(group, t)
                    group = []
                group.append(row)
            if found:
                yield made(list(dict.fromkeys(found)))
        if group and (found := pairs_of(group, t)):
            yield made(found)

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def link_components(docs: DataFrame, percent: int = 90, width: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = rows.filter(F.col("doc_id").isNotNull())
    sets = materialize(_sets(rows, percent, width))
    ids = sets.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0)).select("doc_id", "sig")
    classes = ids.groupBy("sig").agg(F.min("doc_id").alias("node"))
    # a document with several rows may have several classes: it links them all, and its keys and sketches are its own
    members = materialize(ids.distinct().join(classes, "sig").select("doc_id", "node").distinct())
    per_id = members.groupBy("doc_id").agg(F.count("*").alias("classes"), F.min("node").alias("node"))
    node_of = materialize(per_id.select("doc_id", F.when(F.col("classes") > 1, F.col("doc_id")).otherwise(F.col("node")).alias("node"), "classes"))
    several, node_of = node_of.filter("classes > 1").select("doc_id"), node_of.select("doc_id", "node")
    links = members.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))

    def lists(column: str) -> DataFrame:
        return sets.filter(F.col("doc_id").isNotNull()).select(F.explode(column).alias("key"), "doc_id")

    # light side: a star to a set of the smaller size of the key
    light = lists("small").withColumn("larger", F.lit(0)).union(lists("large").withColumn("larger", F.lit(1)))
    heads = light.groupBy("key").agg(F.min(F.struct("larger", "doc_id")).alias("head"), F.count("*").alias("m")).filter("m > 1 and head.larger = 0").select("key", F.col("head.doc_id").alias("u"))
    light_links = light.join(heads, "key").filter("doc_id != u").select("u", F.col("doc_id").alias("v")).distinct()
    at = lambda c: node_of.select(F.col("doc_id").alias(c), F.col("node").alias(f"{c}_node"))
    light_links = light_links.join(at("u"), "u").join(at("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    parts = materialize(components(links.union(light_links).filter("u != v").distinct()))

    # heavy side: lists with two members at least, by node
    live = materialize(_by_head(_shorter(_live(sets, node_of), threshold(percent))))
    release(docs.sparkSession)
    drawn = sets.filter("sketch is not null").select("doc_id", "sig", "n", "sketch")
    by_class = drawn.join(classes, "sig").select("node", "sig", "n", "sketch")
    own = drawn.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "sig", "n", "sketch")
    sketches = by_class.union(own).join(live.select("node").distinct(), "node", "left_semi")
    sketches = materialize(sketches.groupBy("node", "sig").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")).select("node", "n", "sketch"))
    numbers = materialize(sets.select("doc_id", "n"))
    del sets, ids, classes, lists, light, heads, light_links, drawn, by_class, own  # with them goes what holds the keys
    release(docs.sparkSession)

    def split_lists(turn: int) -> tuple[DataFrame, DataFrame]:
        """key, node, component of all lists; length and a head of those that hold several components."""
        placed = live.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        head = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("u"), F.col("component").alias("u_component")))
        return placed, placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("length"), head.alias("head")).filter("low != high")

    for turn in range(STAR_ROUNDS):
        placed, split = split_lists(turn)
        pairs = placed.join(split.select("key", "head.u", "head.u_component"), "key").filter("component != u_component").select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct()
        pairs, count = compact(_passing(pairs, sketches, percent))
        if count:
            parts = joined(parts, _linked(pairs, named, percent, width))
        release(docs.sparkSession)
    above = 0.0
    for upto in SHARES:
        placed, split = split_lists(-1)
        pairs = _across(placed, split.select("key", "length"), sketches, percent, above, upto if upto < 1 else 2.0)
        pairs, count = compact(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        if count:
            parts = joined(parts, _linked(pairs, named, percent, width))
        release(docs.sparkSession)
        above = upto
    found = numbers.join(node_of, "doc_id", "left").join(parts, "node", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))
