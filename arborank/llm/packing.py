"""Best-fit packing of tokenized documents by minimum bin slack.

Every document becomes its token ids and one end id, cut into pieces of at most the sequence length. Only the
histogram of piece lengths (at most one number a length) goes to the driver. There, a subset-sum bitset over the lengths
that are left finds the fullest combination for the next bin; the combination is taken as often as its lengths last,
so each step uses up a length and the plan has no more steps than there are lengths. Pieces then take the plan's
places by their rank among the pieces of their length, which is counted by task and length and needs no group in one place.

Defined cases: a null or empty text is its end id alone; rows that repeat a document are packed each; an empty table
gives no pieces. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_of, written

#: Words whose ids a Python worker keeps, across tasks.
CACHED_WORDS = 200_000
#: New words that the tokenizer gets at once.
BATCH = 2000
#: Fixed value: the short forms that the tokenizer cuts off as pieces of their own.
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"


def byte_signs() -> dict[int, int]:
    """The sign that byte-level vocabularies write for each byte: itself if it can be printed, else the next from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


BYTE_SIGNS = byte_signs()


def piece_patterns() -> tuple[re.Pattern, re.Pattern]:
    """(words that need no tokenizer but its model, the pieces of such a word in small letters).

    These are words of Latin signs up to U+024F that are no space or control sign and whose small form is one such sign. Below
    U+0300 nothing composes, so they are in composed form as they stand.
    """
    signs = [c for c in map(chr, range(33, 0x250)) if category(c) not in ("Cc", "Zs") and len(c.lower()) == 1 and ord(c.lower()) < 0x250]
    letters = "".join(c for c in signs if category(c)[0] == "L")
    digits = "".join(c for c in signs if category(c)[0] == "N")
    return re.compile(f"[{re.escape(''.join(signs))}]+"), re.compile(f"{SHORT}|[{letters}]+|[{digits}]|[^{letters}{digits}]+")


PLAIN, PARTS = piece_patterns()


class WordIds(dict):
    """Token ids (little-endian bytes) of each word that white space bounds; no token of the vocabulary spans such space.

    Words that PLAIN knows are cut into pieces here and go piece by piece to the tokenizer's model; all others go through
    the whole tokenizer as they stand, as do words in which a special token may be written out.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def learn(self, words: list[bytes]) -> None:
        """Makes sure that all the words are there."""
        if len(self) > CACHED_WORDS:
            self.clear()
        tokenize, rest, pieces = self.tokenizer.model.tokenize, [], {}
        for w in words:
            if w in self:
                continue
            x = w.decode("utf-8", "replace")
            if not w:
                self[w] = b""
            elif PLAIN.fullmatch(x) and "<|" not in x:
                found = b""
                for part in PARTS.findall(x.lower()):
                    if part not in pieces:
                        pieces[part] = array("I", [t.id for t in tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_SIGNS))]).tobytes()
                    found += pieces[part]
                self[w] = found
            else:
                rest.append((w, x))
        for at in range(0, len(rest), BATCH):
            own = rest[at : at + BATCH]
            for (w, _), x in zip(own, self.tokenizer.encode_batch_fast([x for _, x in own], add_special_tokens=False), strict=True):
                self[w] = array("I", x.ids).tobytes()


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def ids_of_texts(texts: pa.Array, ids: WordIds) -> Iterator[np.ndarray]:
    """The token ids of each text (string or large string, no nulls). Each distinct word of all of them is looked up once."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    _, place, raw = words.dictionary.cast(pa.large_string()).buffers()
    place, raw = np.frombuffer(place, np.int64, len(words.dictionary) + 1).tolist(), raw.to_pybytes() if raw else b""
    distinct = [raw[a:b] for a, b in zip(place, place[1:], strict=False)]
    ids.learn(distinct)
    own = [ids[w] for w in distinct]
    size = np.fromiter(map(len, own), np.int64, len(own)) // 4
    first, flat = np.cumsum(size) - size, np.frombuffer(b"".join(own), "<u4")
    word = words.indices.to_numpy(zero_copy_only=False)
    n_words = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    ends = np.concatenate([[0], np.cumsum(size[word])])
    found = flat[np.repeat(first[word] - ends[:-1], size[word]) + np.arange(ends[-1])]
    for a, b in zip(ends[[0, *n_words[:-1]]].tolist(), ends[n_words].tolist(), strict=True):
        yield found[a:b]


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long"


def pieces_of(docs: DataFrame, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """One row a piece, with its number among those of its length in its task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, task = word_ids(tokenizer), np.array([end_id], "<u4"), TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        for part in parts_of(batches, limit=8 << 20):
            rows = []
            for doc, found in zip(part.column(0).to_pylist(), ids_of_texts(pc.fill_null(part.column(1), ""), ids), strict=True):
                found = np.concatenate([found, end])
                for k, at in enumerate(range(0, len(found), size)):
                    own = found[at : at + size]
                    n = len(own)
                    rows.append((doc, k, at, n, zlib.crc32(own), task, seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of the available lengths with the largest sum up to `room`, as {length: number}.

    Bit s of the set after each step tells that sum s can be made from the lengths so far. Lengths come longest first,
    in parts of 1, 2, 4, ... copies, and the search stops once the room can be filled.
    """
    limit, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & limit
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    total, found = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            found[length] = found.get(length, 0) + take
            total -= length * take
    return found


def plan_of(counts: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """[(bins, combination)], as minimum bin slack fills one bin after another from what is left.

    Each bin takes the longest length that is left and the fullest combination beside it.
    """
    left, plan = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        made = {longest: 1}
        if longest < size:
            for k, n in fullest({k: n for k, n in rest.items() if n > 0 and k <= size - longest}, size - longest).items():
                made[k] = made.get(k, 0) + n
        times = min(left[k] // n for k, n in made.items())
        plan.append((times, made))
        for k, n in made.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def places_of(plan: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, uses a sequence and offset within it, of each step that uses the length."""
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for times, made in plan:
        offsets = accumulate((k * n for k, n in made.items()), initial=0)
        for (k, n), offset in zip(made.items(), offsets, strict=False):
            places.setdefault(k, []).append((ranks.get(k, 0), first, n, offset))
            ranks[k] = ranks.get(k, 0) + n * times
        first += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*x, strict=True)) for k, x in places.items()}


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece."""
    pieces = written(pieces_of(docs, tokenizer, size, end_id), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `size` rows at most
    places = pieces.sparkSession.sparkContext.broadcast(places_of(plan_of(counts, size)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(by_task.withColumn("before", before).drop("n"), ["length", "task"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                first_rank, first, uses, start = places.value[int(k)]
                step = np.searchsorted(first_rank, rank[own], "right") - 1
                turn, nth = np.divmod(rank[own] - first_rank[step], uses[step])
                sequence[own], offset[own] = first[step] + turn, start[step] + nth * k
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(3).cast(pa.int64()), batch.column(4), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
