"""Substring dedup of word windows behind a count-min prefilter.

A window is `size` consecutive words. Each window is counted under its minimizer, the smallest hash among its short
word runs: equal windows have equal minimizers, so the sketch's count of the minimizer is never below the window's own.
First pass: each task sketches the minimizers of its documents, and the sketches are merged block by block. Second pass:
only windows whose estimate says "repeated" are emitted and exactly grouped by a 128-bit hash, to find the smallest document of
each. The merged sketch keeps one bit a cell (two or more) and grows with the text up to `max_sketch_bytes`; past that
its estimates get looser and the exact pass reads more, but no window is lost.

Exact copies of a text are told apart first: all but the smallest document of each are removed as a whole (if they have a window at all)
and stay out of both passes. The table of copied texts is sent to the tasks up to `max_copies_bytes`, those with the most copies first;
copies beyond it go through the windows like any other text.

Defined cases: a null or empty text has no words; rows that repeat a doc_id are judged each, and windows they share with rows of the
same id stay; null ids count as one id before all others. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, ids_of, slices, spread_join, written

RUN = 8
BLOCK = 1 << 16
ROWS = 2
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word)
        return made


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Runs:
    """Hashes of all runs of words of a sequence, by prefix sums modulo 2^64."""

    def __init__(self, words: np.ndarray, base: int):
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words), base, np.uint64)]))
        inverse = np.uint64(pow(base, -1, 2**64))
        self.inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words), inverse, np.uint64)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers[:-1], dtype=np.uint64)])

    def of(self, n: int, at: np.ndarray | None = None) -> np.ndarray:
        if at is None:
            return (self.sums[n:] - self.sums[:-n]) * self.inverse[: len(self.sums) - n]
        return (self.sums[at + n] - self.sums[at]) * self.inverse[at]


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return x if width == n else np.minimum(x[: len(x) - (n - width)], x[n - width :])


def windows_of(texts: list[bytes], hashes: WordHashes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Runs | None, np.ndarray]:
    """Of all windows of the texts: start in the joined words, text, minimizer; then the words' runs and the texts' first words."""
    words = [t.split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate([[0], np.cumsum(n)])
    if first[-1] < size:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), None, first
    values = np.fromiter((h for x in words for h in map(hashes.__getitem__, x)), np.uint64, int(first[-1]))
    text = np.repeat(np.arange(len(words)), np.maximum(n - size + 1, 0))
    start = np.arange(len(text)) + np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(np.maximum(n - size + 1, 0))[:-1]]), np.maximum(n - size + 1, 0))
    runs = Runs(values, BASES[0])
    run = min(RUN, size)
    least = sliding_min(mixed(runs.of(run)), size - run + 1)
    return start, text, least[start], runs, first


def cells_of(minimizer: np.ndarray, width: int) -> list[np.ndarray]:
    return [(mixed(minimizer + np.uint64(k + 1)) & np.uint64(width - 1)).astype(np.int64) for k in range(ROWS)]


class Copies:
    """Texts that several documents hold, and the smallest of these."""

    ROW_BYTES = 24

    def __init__(self, docs: DataFrame, max_bytes: int):
        each = docs.select(doc_key().alias("doc"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5"))
        found = each.groupBy("md5").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).filter("first < last")
        rows = found.orderBy(F.desc("n"), "md5").limit(max_bytes // self.ROW_BYTES).select("md5", "first").toLocalIterator()
        pairs = sorted((bytes.fromhex(r.md5), r.first) for r in rows)
        self.keys = np.array([k for k, _ in pairs], "S16") if pairs else np.zeros(0, "S16")
        self.first = np.array([d for _, d in pairs], np.int64)

    def later(self, texts: list[bytes], docs: np.ndarray) -> np.ndarray:
        """Which of the texts are known to be held by a smaller document."""
        if not len(self.keys):
            return np.zeros(len(texts), bool)
        own = np.array([hashlib.md5(t, usedforsecurity=False).digest() for t in texts], "S16")
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        return (self.keys[at] == own) & (self.first[at] < docs)


def sketch(docs: DataFrame, size: int, max_sketch_bytes: int, copies: Broadcast) -> np.ndarray:
    """(ROWS, width / 8) bytes: one bit a cell, set where windows of two or more runs of documents' words meet."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    width = BLOCK
    while width < chars // 16 and ROWS * width * 2 <= 8 * max_sketch_bytes:
        width *= 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, cells = WordHashes(), [[] for _ in range(ROWS)]
        for part, texts in slices(batches):
            texts = [b"" if c else t for t, c in zip(texts, copies.value.later(texts, ids_of(part)), strict=True)]
            _, text, least, _, _ = windows_of(texts, hashes, size)
            if len(least):
                fresh = np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
                for held, cell in zip(cells, cells_of(least[fresh], width), strict=True):
                    held.append(cell)
        for k, held in enumerate(cells):
            if not held:
                continue
            cell, count = np.unique(np.concatenate(held), return_counts=True)
            block = cell // BLOCK
            cuts = np.flatnonzero(np.diff(block)) + 1
            low = (cell % BLOCK).astype("<u2")
            parts = [(int(b[0]), x[n == 1].tobytes(), x[n > 1].tobytes()) for b, x, n in zip(np.split(block, cuts), np.split(low, cuts), np.split(count, cuts), strict=True)]
            for at in range(0, len(parts), 1000):
                own = parts[at : at + 1000]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(own), pa.int32()), *(pa.array(c, t) for c, t in zip(zip(*own, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True))], ["row", "block", "once", "more"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(BLOCK, np.uint8)
        for once, more in zip(pdf["once"], pdf["more"], strict=True):
            for cells, n in ((once, 1), (more, 2)):
                own = np.frombuffer(cells, "<u2")
                count[own] = np.minimum(count[own] + n, 2)
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "block": pdf["block"].iloc[:1], "bits": [np.packbits(count > 1).tobytes()]})

    parts = docs.mapInArrow(partial, "row int, block int, once binary, more binary")
    bits = np.zeros((ROWS, width // 8), np.uint8)
    for r in parts.groupBy("row", "block").applyInPandas(merged, "row int, block int, bits binary").toLocalIterator():
        bits[r.row, r.block * BLOCK // 8 : (r.block + 1) * BLOCK // 8] = np.frombuffer(r.bits, np.uint8)
    return bits


def repeated(docs: DataFrame, bits: np.ndarray, size: int, copies: Broadcast) -> DataFrame:
    """h1, h2 (the window), doc, at: of the windows that the sketch estimates as repeated.

    at: the CRC-32 of the text, for rows that share an id, and the place of the window's first word in the lower 31 bits.
    """
    sent, width = docs.sparkSession.sparkContext.broadcast(bits), bits.shape[1] * 8

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = WordHashes(), sent.value
        for part, texts in slices(batches, limit=2 << 20):
            crc = np.array([zlib.crc32(t) for t in texts], np.int64)
            texts = [b"" if c else t for t, c in zip(texts, copies.value.later(texts, ids_of(part)), strict=True)]
            start, text, least, runs, first = windows_of(texts, hashes, size)
            maybe = np.ones(len(start), bool)
            for row, cell in enumerate(cells_of(least, width)):
                maybe &= (held[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
            start, text = start[maybe], text[maybe]
            if not len(start):
                continue
            words = (runs.sums[1:] - runs.sums[:-1]) * runs.inverse[:-1]
            other = Runs(mixed(words), BASES[1])
            columns = mixed(runs.of(size, start)).view(np.int64), mixed(other.of(size, start)).view(np.int64), ids_of(part)[text], crc[text] << 31 | (start - first[text])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "doc", "at"])

    return docs.mapInArrow(each, "h1 long, h2 long, doc long, at long")


def dedup_windows(docs: DataFrame, size: int = 50, max_sketch_bytes: int = 64 << 20, max_copies_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space), one row for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    copies = rows.sparkSession.sparkContext.broadcast(Copies(rows, max_copies_bytes))
    found = written(repeated(rows, sketch(rows, size, max_sketch_bytes, copies), size, copies), "windows")
    first = found.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("h1", "h2", "first")
    later = spread_join(found, written(first, "windows-first"), ["h1", "h2"], F.xxhash64("doc")).filter("doc > first")
    place = F.col("at").bitwiseAND(2**31 - 1).cast("int")
    spans = later.groupBy("doc", F.shiftright("at", 31).alias("crc")).agg(F.collect_list(place).alias("pos"))
    keyed = rows.select("doc_id", "text", doc_key().alias("doc"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    keyed = keyed.join(spans, ["doc", "crc"], "left").select("doc_id", "text", "pos")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            out, total, removed = [], [], []
            for text, pos, copy in zip(texts, part.column(2), copies.value.later(texts, ids_of(part)), strict=True):
                words = text.split()
                total.append(len(words))
                if copy and len(words) >= size:
                    words = []
                elif pos.is_valid:
                    edge, at = np.zeros(len(words) + 1, np.int32), pos.values.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + size, -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    words = [words[k] for k in stay.tolist()]
                removed.append(total[-1] - len(words))
                out.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return keyed.mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept string")


