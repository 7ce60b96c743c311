"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

For an item of L words every window of L words of a document is compared (a shorter document is one window). Windows without a five-word shingle of any
item of their length are similar to none, so only the others are fingerprinted. Their fingerprints are looked up in buckets by 16-bit blocks: the bucket of a
block's value names the items whose block is within a quarter of the radius of it, and of two fingerprints within the radius some block is, so
the buckets name every item within the radius. An item that is named, within the radius and shares a shingle with the stretch of windows gets its exact similarity:
the weights (numbers of occurrences) of shared shingles over those of all, 0.8 or more. The benchmark is read in parts of bounded size, one
scan of the documents each.

RADIUS is what similar windows stay within, whatever the item's length: at a similarity of 0.8 a bit differs with probability 0.15 or less (see
flip_chance()), so more than RADIUS of 64 differ about once in 10^8 pairs; missed() gives the figure for a number of shingles.

Defined cases: items or texts without words match nothing; items of fewer than five words are one shingle; several rows of an item_id or a
doc_id are matched each and give one row by their best window; null ids are kept as null. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

SHINGLE = 5
#: Over four blocks: a pair within it has a block that differs by at most RADIUS // 4 bits.
RADIUS = 28
BLOCKS = 4
#: Groups of 8 items of a length whose buckets a worker keeps; a quarter of a megabyte each.
GROUPS = 128
#: Text of the items that one scan of the documents takes along.
PART_BYTES = 16 << 20


def shingles(words: list[bytes]) -> list[bytes]:
    n = min(SHINGLE, len(words))
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []


def bits_of(shingle: bytes) -> np.ndarray:
    """+1 or -1 for each bit of the shingle's hash."""
    return np.unpackbits(np.frombuffer(xxhash.xxh64_digest(shingle), np.uint8)).astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of bit sums."""
    return np.packbits(sums > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def similarity(a: Counter, b: Counter) -> float:
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def flip_chance(shingles: int, least: float = 0.8) -> float:
    """How likely a bit of the fingerprints of two windows of that many distinct shingles differs, if they are just similar enough.

    Both have `kept` shingles in common and the rest apart; a bit is the sign of a sum of independent signs.
    """
    kept = math.ceil(2 * least * shingles / (1 + least) - 1e-9)
    signs = lambda n: {2 * k - n: math.comb(n, k) / 2**n for k in range(n + 1)}
    rest = signs(shingles - kept)
    up = lambda a: sum(p for b, p in rest.items() if a + b > 0)
    return sum(p * 2 * (x := up(a)) * (1 - x) for a, p in signs(kept).items())


def missed(shingles: int, least: float = 0.8, radius: int = RADIUS) -> float:
    """How likely two such windows differ in more than `radius` bits."""
    p = flip_chance(shingles, least)
    return sum(math.comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(radius + 1, 65))


def near_values(bits: int = 16, radius: int = RADIUS // BLOCKS) -> np.ndarray:
    values = np.arange(1 << bits, dtype=np.uint32)
    return values[np.bitwise_count(values) <= radius]


@dataclass
class Lengths:
    """The items of one length, in words."""

    items: list[int]
    prints: np.ndarray
    weights: list[Counter]
    #: The buckets of the groups used last, of all lengths of an index, by length and group.
    held: dict[tuple[int, int], np.ndarray]

    def buckets(self, group: int) -> np.ndarray:
        """(BLOCKS, 2^16) sets of items, as bits, of one group of 8: those whose block is near this value."""
        name = id(self), group
        if name not in self.held:
            if len(self.held) >= GROUPS:
                self.held.pop(next(iter(self.held)))
            near, found = near_values(), np.zeros((BLOCKS, 1 << 16), np.uint8)
            for k, own in enumerate(self.prints[8 * group : 8 * group + 8]):
                for b in range(BLOCKS):
                    found[b, near ^ np.uint32((int(own) >> 16 * b) & 0xFFFF)] |= np.uint8(1 << k)
            self.held[name] = found
        return self.held[name]

    def named(self, prints: np.ndarray, wanted: set[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The wanted items (their places here) that the buckets of some of the windows name, and those windows, if within the radius."""
        by_group = defaultdict(list)
        for i in sorted(wanted):
            by_group[i // 8].append(i)
        for group, own in by_group.items():
            table, sets = self.buckets(group), np.zeros(len(prints), np.uint8)
            for b in range(BLOCKS):
                sets |= table[b, ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)]
            for i in own:
                at = np.flatnonzero(sets & np.uint8(1 << i % 8))
                at = at[np.bitwise_count(prints[at] ^ self.prints[i]) <= RADIUS]
                if len(at):
                    yield i, at


class Index:
    def __init__(self, items: list[tuple[int | None, bytes]]):
        words = [t.lower().split() for _, t in items]
        self.ids = [k for k, _ in items]
        self.known = {w: k + 1 for k, w in enumerate(sorted({w for x in words for w in x}))}
        by_length = defaultdict(list)
        for k, w in enumerate(words):
            if w:
                by_length[len(w)].append(k)
        self.sizes, self.lengths, self.runs = [len(w) for w in words], {}, {}
        held: dict[tuple[int, int], np.ndarray] = {}
        runs: dict[int, dict[int, dict[int, set[int]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        for n, own in by_length.items():
            weights = [Counter(shingles(words[k])) for k in own]
            prints = packed(np.array([sum(bits_of(s) * c for s, c in w.items()) for w in weights]))
            self.lengths[n] = Lengths(own, prints, weights, held)
            for i, w in enumerate(weights):
                for s in w:
                    runs[min(SHINGLE, n)][self.run_hash([self.known[x] for x in s.split()])][n].add(i)
        for k, found in runs.items():
            hashes = np.array(sorted(found), np.uint64)
            self.runs[k] = hashes, [sorted(found[int(h)].items()) for h in hashes]

    @staticmethod
    def run_hash(numbers: list[int]) -> int:
        h = 0
        for x in numbers:
            h = (h * 0x9E3779B97F4A7C15 + x) & (2**64 - 1)
        return h

    def seeds(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int, set[int]]]:
        """(place, run length, item length, items) where a run of words is a shingle of items of that length."""
        for k, (hashes, lengths) in self.runs.items():
            if len(numbers) < k:
                continue
            parts = [numbers[j : len(numbers) - k + 1 + j] for j in range(k)]
            at = np.flatnonzero(np.logical_and.reduce([p > 0 for p in parts]))
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for p in parts:
                h = h * np.uint64(0x9E3779B97F4A7C15) + p[at].astype(np.uint64)
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in np.flatnonzero(hashes[place] == h):
                for n, items in lengths[place[i]]:
                    yield int(at[i]), k, n, items

    def seeded(self, texts: list[bytes]) -> tuple[list[list[bytes]], dict[int, list[tuple[int, int, int, set[int]]]]]:
        """The words of the texts, and by text its seeds."""
        words = [t.lower().split() for t in texts]
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate([[0], np.cumsum(size + 1)])  # a zero after each text
        numbers = np.zeros(int(first[-1]), np.int64)
        for k, w in enumerate(words):
            numbers[first[k] : first[k] + size[k]] = np.fromiter(map(self.known.get, w, repeat(0)), np.int64, len(w))
        found = defaultdict(list)
        for at, k, n, items in self.seeds(numbers):
            doc = int(np.searchsorted(first, at, "right")) - 1
            found[doc].append((at - int(first[doc]), k, n, items))
        return words, found

    def matches(self, words: list[bytes], seeds: list[tuple[int, int, int, set[int]]], least: float) -> dict[int, tuple[float, int]]:
        """item -> (similarity, first word of its best window, the first of equals)."""
        spans = defaultdict(list)
        for at, k, n, items in seeds:
            last = max(0, len(words) - n)
            spans[n].append((min(last, max(0, at + k - n)), min(last, at), items))
        best: dict[int, tuple[float, int]] = {}
        for n, own_spans in spans.items():
            own, size = self.lengths[n], min(n, len(words))
            k = min(SHINGLE, n)
            if size < k:
                continue
            for a, last, wanted in joined(own_spans):
                b = last + size
                here = [b" ".join(words[i : i + k]) for i in range(a, b - k + 1)]
                sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum([bits_of(s) for s in here], axis=0)])
                at, held = np.arange(last - a + 1), size - k + 1
                prints = packed(sums[at + held] - sums[at])
                for i, found in own.named(prints, wanted):
                    shared = self.overlaps(own.weights[i], here, held, int(found[0]), int(found[-1]))[found - found[0]]
                    s = shared / (own.weights[i].total() + held - shared)
                    j = int(np.argmax(s))
                    item = own.items[i]
                    if s[j] >= least and (item not in best or (-s[j], a + int(found[j])) < (-best[item][0], best[item][1])):
                        best[item] = float(s[j]), a + int(found[j])
        return best

    @staticmethod
    def overlaps(weights: Counter, here: list[bytes], held: int, first: int, last: int) -> np.ndarray:
        """Shared weight of an item and each of the windows of `held` shingles that start from `first` to `last`: each step takes one shingle in and one out."""
        count, shared, out = Counter(), 0, np.zeros(last - first + 1, np.int64)
        for j in range(first, last + held):
            s = here[j]
            if s in weights:
                count[s] += 1
                shared += count[s] <= weights[s]
            if j >= first + held - 1:
                at = j - held + 1
                out[at - first] = shared
                s = here[at]
                if s in weights:
                    shared -= count[s] <= weights[s]
                    count[s] -= 1
        return out


def joined(spans: list[tuple[int, int, set[int]]]) -> list[tuple[int, int, set[int]]]:
    """Spans (first, last, items) that meet or touch as one, with the items of all."""
    out: list[tuple[int, int, set[int]]] = []
    for a, b, items in sorted(spans, key=lambda x: x[:2]):
        if out and a <= out[-1][1] + 1:
            out[-1][2].update(items)
            out[-1] = out[-1][0], max(b, out[-1][1]), out[-1][2]
        else:
            out.append((a, b, set(items)))
    return out


#: The index that this worker built last, by the name of its part of the benchmark.
LAST: dict[str, Index] = {}


def index_of(name: str, items: list[tuple[int | None, bytes]]) -> Index:
    """The index of a part, built once a worker."""
    if name not in LAST:
        LAST.clear()
        LAST[name] = Index(items)
    return LAST[name]


def parts_of(benchmark: DataFrame, most: int = PART_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in parts of at most `most` bytes (one item at least)."""
    part, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).toLocalIterator():
        raw = r.text.encode()
        if part and size + len(raw) > most:
            yield part
            part, size = [], 0
        part.append((r.item_id, raw))
        size += len(raw)
    if part:
        yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, similarity, start (first word of the best window), n_words (of it): a row for each document and item that match."""
    shape = "doc_id long, item_id long, similarity double, start long, n_words long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in parts_of(benchmark):
        own = scanned(rows, items, least, shape)
        out = own if out is None else out.unionByName(own)
    if out is None:
        return docs.sparkSession.createDataFrame([], shape)
    best = F.max_by(F.struct("start", "n_words"), F.struct("similarity", -F.col("start")))
    return out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), best.alias("w")).select("doc_id", "item_id", "similarity", "w.start", "w.n_words")


def scanned(rows: DataFrame, items: list[tuple[int | None, bytes]], least: float, shape: str) -> DataFrame:
    sent, name = rows.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(name, sent.value)
        names = [x.split()[0] for x in shape.split(", ")]
        for part, texts in slices(batches):
            words, seeds = index.seeded(texts)
            out = []
            for doc, own in seeds.items():
                doc_id = part.column(0)[doc].as_py()
                for i, (s, at) in index.matches(words[doc], own, least).items():
                    n = min(len(words[doc]), index.sizes[i])
                    out.append((doc_id, index.ids[i], s, at, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=names)

    return rows.mapInArrow(each, shape)


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """docs, with all their columns, without the rows whose text matches an item."""
    for items in parts_of(benchmark):
        docs = docs.filter(~leaks(docs, items, least))
    return docs


def leaks(docs: DataFrame, items: list[tuple[int | None, bytes]], least: float) -> Column:
    sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    @F.arrow_udf("boolean")
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = index_of(name, sent.value)
        for batch in batches:
            found = np.zeros(len(batch), bool)
            at = 0
            for _, texts in slices([pa.RecordBatch.from_arrays([batch], ["text"])], column=0):
                words, seeds = index.seeded(texts)
                for doc, own in seeds.items():
                    found[at + doc] = bool(index.matches(words[doc], own, least))
                at += len(texts)
            yield pa.array(found)

    return each(F.col("text").cast("string"))
