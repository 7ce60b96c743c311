"""Phrases whose words keep company: counted in FM-indexes of word ids, scored by their weakest cut.

A task gathers the texts of a language up to some `shard_words` words, numbers their words and builds the Burrows-Wheeler transforms of the number sequence and of
its reverse (`Shard`). Suffixes are sorted as deep as the longest phrase, which is all that intervals of that depth need. The shards are written
once, bucketed by their number.

The words' counts are summed over all shards first. Each shard is then told the numbers of its own frequent words, since rarer ones are in no frequent phrase, and
extends their intervals a word at a time: bigrams to the left by the forward transform, trigrams to the right by the reverse one, and so in turn, both
intervals kept in step. It sends each phrase once, with its count; those are summed over all shards. What a shard holds and sends is bounded by its
own words, and no count or vocabulary is ever sent to all tasks. Shorter phrases that turn out rare don't hold back longer ones: to tell each shard which of its
phrases are frequent moves more rows, the more so the larger the corpus, than it saves.

Defined cases: null and empty texts have no words; a null language is `und`; repeated rows and repeated ids count each time; a language without frequent
phrases has no row; counts up to 10^15 are exact.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import LOWER, UPPER, shared_dir, slices, spread_join, written

#: Bytes that end a piece, and the byte that stands for them: no UTF-8 text has it.
ENDS, END = b".,;:!?\n\x0b\x0c\r", b"\xff"
PLAIN = bytes.maketrans(UPPER.encode() + ENDS, LOWER.encode() + END * len(ENDS))
#: Parts of a language that are ranked apart before they meet.
RANK_PARTS = 64


def word_list(text: bytes) -> list[bytes]:
    """The words of the text with A-Z in small letters, and END where pieces end."""
    return text.translate(PLAIN).replace(END, b" " + END + b" ").split()


def sorted_suffixes(ids: np.ndarray, depth: int) -> np.ndarray:
    """Where the suffixes start, in the order of their first `depth` numbers at least."""
    bits, key, have = max(1, int(ids.max(initial=0)).bit_length()), ids.astype(np.int64), 1
    after = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])
    while have < depth and bits * (have + 1) <= 62:
        key = key << bits | after(ids, have)
        have += 1
    order = np.argsort(key, kind="stable")
    while have < depth:
        rank = np.zeros(len(ids), np.int64)
        rank[order[1:]] = np.cumsum(np.diff(key[order]) != 0)
        key = rank * (len(ids) + 1) + after(rank + 1, have)
        order, have = np.argsort(key, kind="stable"), 2 * have
    return order


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes: all lowest bytes, then all second ones and so on."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


@dataclass(frozen=True)
class Level:
    """Phrases of one length in a shard: their intervals in both transforms, and their words, a row a phrase."""

    low: np.ndarray
    back: np.ndarray
    size: np.ndarray
    words: np.ndarray


class Shard:
    """A bidirectional FM-index over word ids from 1; 0 ends a piece."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray, counts: np.ndarray):
        """counts: how often each word occurs, by its id less 1."""
        self.words = len(counts)
        #: For each word, how many symbols of the text are smaller.
        self.starts = len(forward) - counts.sum() + np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
        self.counts = counts
        self.sides = {"left": (forward, self.steps(forward)), "right": (backward, self.steps(backward))}

    @staticmethod
    def transforms(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward transform of a text that starts and ends with 0."""
        return tuple(x[sorted_suffixes(x, depth) - 1] for x in (ids, ids[::-1]))

    @staticmethod
    def steps(bwt: np.ndarray) -> np.ndarray:
        """Where each row's symbol stands in the first column: symbols before it and equal ones above it."""
        out = np.empty(len(bwt), np.int64)
        out[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
        return out

    def single(self, words: np.ndarray) -> Level:
        """The level of single words."""
        starts = self.starts[words - 1]
        return Level(starts, starts, self.counts[words - 1].astype(np.int64), words[:, None])

    def extended(self, level: Level, side: str, wanted: np.ndarray) -> Level:
        """The phrases with one wanted word more on that side. wanted: a mask of the words' numbers."""
        bwt, steps = self.sides[side]
        own, other = (level.low, level.back) if side == "left" else (level.back, level.low)
        offsets = np.cumsum(level.size) - level.size
        parent = np.repeat(np.arange(len(own)), level.size)
        rows = np.arange(len(parent)) - offsets[parent] + own[parent]
        key = parent * (self.words + 1) + bwt[rows]
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order], prepend=-1))
        size = np.diff(np.append(cuts, len(order)))
        at = order[cuts]
        parent, symbol = parent[at], bwt[rows[at]]
        low, back = steps[rows[at]], other[parent] + cuts - offsets[parent]  # smaller symbols of the interval come before
        keep = wanted[symbol]
        low, back, size, parent, symbol = (x[keep] for x in (low, back, size, parent, symbol))
        new, words = symbol[:, None], level.words[parent]
        return Level(low, back, size, np.hstack([new, words])) if side == "left" else Level(back, low, size, np.hstack([words, new]))


def side_of(depth: int) -> str:
    """Where phrases of that many words get their last one from."""
    return "right" if depth % 2 else "left"


def shards(docs: DataFrame, depth: int, shard_words: int) -> DataFrame:
    """shard, lang, words, counts, length, forward, backward. A task holds one language's words of a shard, or less of several."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 24)
        held: dict[str, tuple[dict, list[np.ndarray]]] = {}
        sizes: dict[str, int] = defaultdict(int)

        def built(lang: str) -> pa.RecordBatch:
            names, parts = held.pop(lang)
            sizes.pop(lang)
            ids = np.concatenate([np.zeros(1, np.int64), *parts])
            ids = ids[(ids > 0) | np.append(True, ids[:-1] > 0)]
            counts = np.bincount(ids, minlength=len(names))[1:]
            order = np.argsort(-counts, kind="stable")  # small numbers for frequent words
            rank = np.zeros(len(names), np.int64)
            rank[order + 1] = np.arange(1, len(names))
            forward, backward = Shard.transforms(rank[ids], depth)
            words = pa.array(list(names)[1:], pa.binary()).take(pa.array(order)).cast(pa.string(), safe=False)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays(
                [pa.array([next(number)], pa.int64()), pa.array([lang]), one(words), one(pa.array(counts[order], pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([packed(forward)], pa.binary()), pa.array([packed(backward)], pa.binary())],
                ["shard", "lang", "words", "counts", "length", "forward", "backward"],
            )

        for part, texts in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                if lang not in held:
                    names = defaultdict(count().__next__)
                    held[lang] = names, []
                    assert names[END] == 0
                names, parts = held[lang]
                own = np.fromiter(map(names.__getitem__, [*word_list(text), END]), np.int64)
                parts.append(own.astype(np.int32))
                sizes[lang] += len(own)
                if sum(sizes.values()) >= shard_words:
                    yield built(max(sizes, key=sizes.get))
        for lang in list(held):
            yield built(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "shard long, lang string, words array<string>, counts array<long>, length long, forward binary, backward binary")


def sent(indexes: DataFrame, told: DataFrame, most_words: int) -> DataFrame:
    """w1, w2 and so on (0 after the last word) and n: each shard's phrases of 2 to most_words frequent words.

    told: shard, told: the shard's own frequent words, as (place, id) with ids from 1.
    """
    names = [*(f"w{k + 1}" for k in range(most_words)), "n"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n = batch.column(1)[k].as_py()
                shard = Shard(unpacked(batch.column(2)[k].as_py(), n), unpacked(batch.column(3)[k].as_py(), n), batch.column(0)[k].values.to_numpy())
                places, ids = (batch.column(4)[k].values.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (0, 1))
                called = np.zeros(shard.words + 1, np.int64)
                called[places + 1] = ids
                level = shard.single(np.sort(places) + 1)
                for depth in range(2, most_words + 1):
                    level = shard.extended(level, side_of(depth), called > 0)
                    for a in range(0, len(level.size), 1 << 18):
                        words, size = called[level.words[a : a + (1 << 18)]], level.size[a : a + (1 << 18)]
                        none = np.zeros(len(size), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(words[:, d] if d < depth else none) for d in range(most_words)] + [pa.array(size)], names)

    rows = indexes.join(told, "shard").select("counts", "length", "forward", "backward", "told")
    return rows.mapInArrow(each, ", ".join(f"{x} long" for x in names))


def described(rows: DataFrame, below: DataFrame, words: int) -> DataFrame:
    """lang, phrase, last, the words, f and the counts of all beginnings and ends, of rows (w1 to w<words>, f) and those of one word less."""
    own = [f"w{k}" for k in range(1, words + 1)]
    head = below.select(*own[:-1], "lang", F.col("phrase").alias("before"), F.col("starts").alias("starts0"))
    tail = below.select(*[F.col(x).alias(y) for x, y in zip(own[:-1], own[1:], strict=True)], "last", F.col("ends").alias("ends0"))
    found = spread_join(written(spread_join(rows.select(*own, "f"), head, own[:-1], F.xxhash64(own[-1])), "phrases"), tail, own[1:], F.xxhash64("w1"))
    f = F.array("f")
    return written(found.select(*own, "lang", F.concat_ws(" ", "before", "last").alias("phrase"), "last", "f", F.concat("starts0", f).alias("starts"), F.concat("ends0", f).alias("ends")), "phrases")


def weakest_cut(words: int) -> Column:
    """(score, k, l, r) of the cut with the least floor(1000000 a a / (l r)), the first of equals. Decimals keep all digits."""
    cuts = [f"struct((cast(1000000 as decimal(7,0)) * cast(f as decimal(15,0)) * cast(f as decimal(15,0))) div (cast(starts[{k - 1}] as decimal(19,0)) * cast(ends[{words - k - 1}] as decimal(19,0))) as score, {k} as k, starts[{k - 1}] as l, ends[{words - k - 1}] as r)" for k in range(1, words)]
    return F.expr(f"array_min(array({', '.join(cuts)}))")


def phrases(docs: DataFrame, most_words: int = 3, least: int = 10, shard_words: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """All phrases of 2 to most_words words that occur `least` times or more in their language, and the words of each language.

    The first: lang, phrase, words, a, l, r, score (see weakest_cut()), left and right (how often the most frequent phrase with one word more
    before or after it occurs; 0 if below `least`, or beyond most_words). The second: lang, n.
    """
    spark, name = docs.sparkSession, f"shards_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards(docs, most_words, shard_words).write.bucketBy(buckets, "shard").option("path", shared_dir(spark, "shards")).saveAsTable(name)
    try:
        indexes = spark.table(name)
        own = indexes.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x")).select("shard", "lang", "place", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
        words = written(own.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
        # the smallest numbers for the most frequent words, so that most rows that move are short
        frequent = written(numbered(words.filter(F.col("f") >= least).withColumn("rare", -F.col("f")), ["rare", "lang", "word"], "id"), "frequent")
        told = own.join(frequent.select("lang", "word", "id"), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("place", "id")).alias("told"))  # no longer than the shard
        keys = [f"w{k}" for k in range(1, most_words + 1)]
        sums = sent(indexes, told, most_words).repartition(*keys).groupBy(*keys).agg(F.sum("n").alias("f"))
        found = written(sums.filter(F.col("f") >= least), "found")
    finally:
        spark.sql(f"drop table if exists {name}")
    levels = [frequent.select(F.col("id").alias("w1"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("starts"), F.array("f").alias("ends"))]
    for k in range(2, most_words + 1):
        rows = found.filter(F.col(f"w{k}") > 0)
        levels.append(described(rows if k == most_words else rows.filter(F.col(f"w{k + 1}") == 0), levels[-1], k))
    out = None
    for k in range(2, most_words + 1):
        rows = levels[k - 1].select(*keys[:k], "lang", "phrase", F.lit(k).alias("words"), F.col("f").alias("a"), weakest_cut(k).alias("cut"))
        for side, ends in (("left", keys[1 : k + 1]), ("right", keys[:k])) if k < most_words else ():
            longer = levels[k].groupBy(*[F.col(x).alias(y) for x, y in zip(ends, keys[:k], strict=True)]).agg(F.max("f").alias(side))
            rows = rows.join(longer, keys[:k], "left")
        sides = [F.coalesce(F.col(c), F.lit(0)).alias(c) if k < most_words else F.lit(0).cast("long").alias(c) for c in ("left", "right")]
        rows = rows.select("lang", "phrase", "words", "a", *[F.col(f"cut.{c}").alias(c) for c in ("l", "r", "score")], *sides)
        out = rows if out is None else out.unionByName(rows)
    return out, words.groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, top: int = 2000, inside: int = 50, shard_words: int = 2_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, count and text.

    A phrase goes where a longer one that holds it occurs `inside` percent as often or more. It is enough to look one word further: what holds
    a phrase and is longer still holds one of those, which is at least as frequent.
    """
    found, sizes = phrases(docs, most_words, least, shard_words)
    found = found.filter(100 * F.greatest("left", "right") < inside * F.col("a"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    best = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)  # RANK_PARTS * top rows a language at most
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
