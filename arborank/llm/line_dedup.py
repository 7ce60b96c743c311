"""Incremental line dedup over exact reference counts, with sharded cuckoo filters in front of them.

The index holds three tables: `postings` (line key, document), `refs` (line key, number of documents, largest
document) and `filters` (one cuckoo filter a shard, over the keys that enough documents share). Inserting or deleting
documents rewrites the counts from the postings it touches and adds keys to, or takes keys from, the filters, so that
a deletion gives back exactly the counts of an index that never saw the document. A filter that gets too full for its keys is built
anew, larger, from the exact ones. Deciding on documents probes the filters first, each where the lines of its shard are dealt: a line
that its filter doesn't know is surely kept, and only the others are joined with the exact counts.

Defined cases: a null or empty text has one empty line; lines whose key has fewer than `min_chars` code points always
stay; rows that repeat a doc_id count as one document; null ids count as one document, before all others. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, free_names, ids_of, probed, slices, spread_join, written

BLANKS = b" \t\n\x0b\x0c\r"
SLOTS = 4
#: Keys a filter is laid out for, so that it has some 64 KB.
SHARD_KEYS = 1 << 14


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """For each line its 16-byte key, None where it is too short to count."""
    found = []
    for line in text.split(b"\n"):
        key = line.strip(BLANKS).lower()
        n = len(key)
        if n >= min_chars and (n >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            found.append(xxhash.xxh3_128_digest(key))
        else:
            found.append(None)
    return found


class CuckooFilter:
    """Approximate set of 16-byte keys with deletion: 16-bit fingerprints, two buckets of four slots a key."""

    def __init__(self, n_buckets: int, slots: np.ndarray | None = None):
        self.n = n_buckets  # a power of two
        self.slots = np.zeros((n_buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """keys: (n, 2) unsigned 64-bit halves, without repeats. Doubles its size until all fit."""
        n = 1 << max(2, int(np.ceil(np.log2(max(1, len(keys)) / SLOTS / 0.6))))
        while True:
            made = cls(n)
            if all(made.add(k) for k in keys):
                return made
            n *= 2

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tag = (keys[:, 1] >> np.uint64(48)).astype(np.uint64)
        tag[tag == 0] = 1
        first = keys[:, 0] & np.uint64(self.n - 1)
        return tag.astype(np.uint16), first, self.other(first, tag)

    def other(self, bucket: np.ndarray, tag: np.ndarray) -> np.ndarray:
        step = (tag.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return (bucket ^ step) & np.uint64(self.n - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        tag, a, b = self.places(keys)
        return (self.slots[a] == tag[:, None]).any(1) | (self.slots[b] == tag[:, None]).any(1)

    def add(self, key: np.ndarray) -> bool:
        tag, a, b = (x[0] for x in self.places(key.reshape(1, 2)))
        for bucket in (a, b):
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = tag
                return True
        at = b
        for turn in range(200):
            slot = turn % SLOTS
            self.slots[at, slot], tag = tag, self.slots[at, slot]
            at = self.other(np.array([at], np.uint64), np.array([tag], np.uint64))[0]
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = tag
                return True
        return False

    def remove(self, key: np.ndarray) -> bool:
        tag, a, b = (x[0] for x in self.places(key.reshape(1, 2)))
        for bucket in (a, b):
            held = np.flatnonzero(self.slots[bucket] == tag)
            if len(held):
                self.slots[bucket, held[0]] = 0
                return True
        return False


def halves(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def shard_of(n_shards: int, key: str = "key"):
    return (F.conv(F.hex(F.substring(key, 9, 4)), 16, 10).cast("long") % n_shards).cast("int")


@dataclass(frozen=True)
class LineIndex:
    """One state of the index; insert and delete return the next one."""

    postings: DataFrame  # doc long, key binary; no repeats
    refs: DataFrame  # key, n_docs, last_doc
    filters: DataFrame  # shard, n_buckets, slots
    n_shards: int
    min_docs: int = 3
    min_chars: int = 20

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> LineIndex:
        posted = written(postings_of(docs, min_chars), "line-postings")
        refs = written(counted(posted), "line-refs")
        hot = refs.filter(F.col("n_docs") >= min_docs).select("key")
        return cls(posted, refs, *new_filters(hot), min_docs, min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds documents; one that is there already keeps the lines it has and gains the new ones."""
        new = postings_of(docs, self.min_chars).join(self.postings, ["doc", "key"], "left_anti")
        new = written(new, "line-postings")
        more = self.refs.select("key", "n_docs", "last_doc").unionByName(counted(new))
        refs = more.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        return self.moved(self.postings.unionByName(new), refs)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Takes documents out by doc_id. Only keys of theirs are counted anew."""
        gone = doc_ids.select(doc_key().alias("doc")).distinct()
        left = written(self.postings.join(gone, "doc", "left_anti"), "line-postings")
        touched = self.postings.join(gone, "doc", "left_semi").select("key").distinct()
        refs = self.refs.join(touched, "key", "left_anti").unionByName(counted(left.join(touched, "key", "left_semi")))
        return self.moved(left, refs)

    def moved(self, postings: DataFrame, refs: DataFrame) -> LineIndex:
        refs = written(refs, "line-refs")
        was, now = (x.filter(F.col("n_docs") >= self.min_docs).select("key") for x in (self.refs, refs))
        room = self.filters.agg(F.sum("n_buckets")).first()[0] or 0
        if now.count() > 0.7 * SLOTS * room:
            return LineIndex(postings, refs, *new_filters(now), self.min_docs, self.min_chars)
        changes = now.join(was, "key", "left_anti").withColumn("add", F.lit(True)).unionByName(was.join(now, "key", "left_anti").withColumn("add", F.lit(False)))
        return LineIndex(postings, refs, changed_filters(self.filters, changes, now, self.n_shards), self.n_shards, self.min_docs, self.min_chars)

    def drops(self, docs: DataFrame, postings: DataFrame | None = None) -> DataFrame:
        """doc, drop (keys of its lines that go), for documents that lose any. postings: those of docs, if they are at hand."""
        posted = postings_of(docs, self.min_chars) if postings is None else postings
        hot = self.refs.filter(F.col("n_docs") >= self.min_docs).select("key", "last_doc")
        known = written(self.known(posted), "line-known")
        return spread_join(known, hot, ["key"], F.xxhash64("doc")).filter(F.col("doc") < F.col("last_doc")).groupBy("doc").agg(F.collect_list("key").alias("drop"))

    def decide(self, docs: DataFrame, postings: DataFrame | None = None) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept (the text without its dropped lines), one row for each row of docs."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), doc_key().alias("doc"))
        rows = rows.join(self.drops(docs, postings), "doc", "left").select("doc_id", "text", "drop")
        return rows.mapInArrow(kept_lines(self.min_chars), "doc_id long, n_lines long, n_dropped long, kept string")

    def applied(self, docs: DataFrame, postings: DataFrame | None = None) -> DataFrame:
        """docs, with all their columns, with the text that decide() keeps."""
        doc, drop = free_names(docs, "__doc", "__drop")
        drops = self.drops(docs, postings).select(F.col("doc").alias(doc), F.col("drop").alias(drop))
        rows = docs.withColumn(doc, doc_key()).join(drops, doc, "left")
        min_chars = self.min_chars

        @F.arrow_udf("string")
        def kept(text: pa.Array, drop: pa.Array) -> pa.Array:
            return pa.array([t if not d else without(t.encode(), set(d), min_chars)[0].decode("utf-8", "replace") for t, d in zip(text.to_pylist(), drop.to_pylist(), strict=True)], pa.string())

        return rows.select(*[kept(F.col("text").cast("string"), F.col(drop)).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])

    def known(self, postings: DataFrame) -> DataFrame:
        """doc, key: the postings whose key the filter of its shard may hold."""

        def test(shard: tuple, batch: pa.RecordBatch) -> np.ndarray:
            n, slots = shard
            return CuckooFilter(n, np.frombuffer(slots, np.uint16).reshape(n, SLOTS)).has(halves(batch.column(1).to_pylist()))

        rows = postings.select("doc", "key", shard_of(self.n_shards).alias("shard"))
        return probed(rows, self.filters, F.xxhash64("doc"), test)


def postings_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, key) without repeats within a row."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found = [list({k for k in line_keys(t, min_chars) if k}) for t in texts]
            doc = np.repeat(ids_of(part), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array([k for x in found for k in x], pa.binary())], ["doc", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(keys, "doc long, key binary")


def counted(postings: DataFrame) -> DataFrame:
    """Exact reference counts. Rows of a key are added up before they are dealt by key, so no task holds a frequent one's."""
    return postings.select("key", "doc").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))


def new_filters(hot: DataFrame) -> tuple[DataFrame, int]:
    n_shards = max(1, -(-hot.count() // SHARD_KEYS))
    none = hot.sparkSession.createDataFrame([], "shard int, n_buckets int, slots binary")
    return changed_filters(none, hot.withColumn("add", F.lit(True)), hot, n_shards), n_shards


def changed_filters(filters: DataFrame, changes: DataFrame, held: DataFrame, n_shards: int) -> DataFrame:
    """Filters after adding and removing keys, one shard a group; held: all keys that they then hold.

    A shard holds about SHARD_KEYS keys by its number. One that has no room for its new keys is built from all that it holds.
    """

    def change(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        shard = int(old["shard"].iloc[0] if len(old) else new["shard"].iloc[0])
        fresh = halves(list(new["key"][new["add"]])) if len(new) else np.zeros((0, 2), np.uint64)
        if len(old):
            n = int(old["n_buckets"].iloc[0])
            made = CuckooFilter(n, np.frombuffer(old["slots"].iloc[0], np.uint16).reshape(n, SLOTS).copy())
            for k in halves(list(new["key"][~new["add"]])) if len(new) else ():
                made.remove(k)
            if not all(made.add(k) for k in fresh):
                return pd.DataFrame({"shard": [shard], "n_buckets": [0], "slots": [b""]})
        else:
            made = CuckooFilter.of(fresh)
        return pd.DataFrame({"shard": [shard], "n_buckets": [made.n], "slots": [made.slots.tobytes()]})

    def changed(old: DataFrame, new: DataFrame) -> DataFrame:
        by_shard = new.withColumn("shard", shard_of(n_shards)).select("key", "add", "shard").groupBy("shard")
        return written(old.groupBy("shard").cogroup(by_shard).applyInPandas(change, "shard int, n_buckets int, slots binary"), "line-filters")

    found = changed(filters, changes)
    full = found.filter("n_buckets = 0").select("shard")
    if full.isEmpty():
        return found
    own = held.withColumn("shard", shard_of(n_shards)).join(full, "shard", "left_semi").select("key", F.lit(True).alias("add"))
    return found.filter("n_buckets > 0").unionByName(changed(filters.limit(0), own))


def without(text: bytes, gone: set[bytes], min_chars: int) -> tuple[bytes, int]:
    """The text without the lines of these keys, and the number of lines that stay."""
    stay = [line for line, key in zip(text.split(b"\n"), line_keys(text, min_chars), strict=True) if key not in gone]
    return b"\n".join(stay), len(stay)


def kept_lines(min_chars: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            out, lines, dropped = [], [], []
            for text, drop in zip(texts, part.column(2).to_pylist(), strict=True):
                n = text.count(b"\n") + 1
                if drop:
                    text, stay = without(text, set(drop), min_chars)
                    n_dropped = n - stay
                else:
                    n_dropped = 0
                out.append(text)
                lines.append(n)
                dropped.append(n_dropped)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return kept


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Builds the index over docs and decides on the same documents."""
    index = LineIndex.build(docs, min_docs, min_chars)
    return index.decide(docs, index.postings)
