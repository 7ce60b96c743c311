"""Quality by kernel ridge regression over document statistics, calibrated by isotonic regression.

Every text is reduced to the STATISTICS below, which are written once. They are standardised by sums over the learning rows and sent through random
Fourier features, cos(x W + u) with Gaussian W, whose products approximate a Gaussian kernel. Each task sums the normal equations of its
own rows, apart for each of FOLDS folds by a hash of the id; the sums are added in two rounds of tasks and only one total reaches the driver, of a size
that depends on the number of features alone. A ridge fit without each fold scores that fold; those scores, counted on a fixed grid, are
what the isotonic curve is drawn through. The final weights use all folds.

All labelled rows are learnt from, at every size of the input. No id, language or source enters a score.

Defined cases: a null or empty text has all statistics 0 and gets a score like any other; labels other than 0 and 1 and labels without a document are unused; an id with
several labels counts as the least of them; repeated rows count and are scored each; with labels of one class or none every score is the smoothed
share of good ones, (good + 1) / (all + 2).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

STATISTICS = (
    "words", "chars", "word_length", "word_spread", "upper", "digits", "symbols", "stops", "calls", "blanks", "lines", "distinct", "distinct_root", "top_word",
    "same_as_before", "repeated_triples", "repeated_lines", "repeated_sentences", "sentence_length", "marked_words", "capital_words", "beyond_ascii", "short_words", "long_words", "line_length",
)
FOLDS = 4
#: The grid on which scores of the folds are counted, from -0.5 to 1.5.
GRID = 2048
SENTENCE = re.compile(rb"[.!?\n]+")
#: Kinds of bytes: 1 upper case, 2 lower case, 3 digit, 4 stop, 5 call, 6 other sign, 7 space, 8 line end, 9 beyond ASCII.
KIND = np.full(256, 6, np.uint8)
for _kind, _bytes in ((1, range(65, 91)), (2, range(97, 123)), (3, range(48, 58)), (4, b".,;:"), (5, b"!?"), (7, b" \t\r\x0b\x0c"), (8, b"\n"), (9, range(128, 256))):
    KIND[list(_bytes)] = _kind


def repeats(items: list) -> float:
    """The share of items that occurred before."""
    return 1 - len(set(items)) / len(items) if items else 0.0


def statistics(text: bytes) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(text)
    kinds = np.bincount(KIND[np.frombuffer(text, np.uint8)], minlength=10) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    parts = [x for s in SENTENCE.split(text) if (x := s.strip())]
    firsts, lasts = (KIND[np.frombuffer(b"".join([w[at : at + 1 or None] for w in words]), np.uint8)] for at in (0, -1))
    letters = kinds[1] + kinds[2]
    return [
        math.log1p(n), math.log1p(size), math.log(lengths.mean()), math.log1p(lengths.std()), kinds[1] / letters if letters else 0.0, *(math.sqrt(kinds[k]) for k in (3, 6, 4, 5)), kinds[7], math.sqrt(kinds[8]),
        len(counts) / n, math.log(len(counts) / math.sqrt(n)), math.sqrt(max(counts.values()) / n), math.sqrt(sum(map(bytes.__eq__, words, words[1:])) / n),
        math.sqrt(repeats(list(zip(words, words[1:], words[2:])))), math.sqrt(repeats(lines)), math.sqrt(repeats(parts)), math.log1p(n / max(1, len(parts))),
        float((lasts == 6).mean()), float((firsts == 1).mean()), math.sqrt(kinds[9]), float((lengths <= 3).mean()), float((lengths >= 16).mean()), math.log1p(size / max(1, len(lines))),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of each text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, x array<double>")


def matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


@dataclass(frozen=True)
class Model:
    """Standardisation, features and weights, and the points of the isotonic curve."""

    share: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    turn: np.ndarray | None = None
    shift: np.ndarray | None = None
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] = field(default=(np.zeros(1), np.zeros(1)))

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.clip((x - self.mean) / self.scale, -5, 5) @ self.turn + self.shift
        return np.hstack([np.cos(z) * math.sqrt(2 / self.turn.shape[1]), np.ones((len(x), 1))])

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        """The curve at raw scores; a thousandth of the raw score's own order breaks the ties of its level stretches."""
        curve = np.interp(raw, *self.knots)
        return np.clip(0.999 * curve + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share) if self.weights is None else self.calibrated(self.features(x) @ self.weights)


#: Arrays that one task adds up in a round.
FAN_IN = 16


def added(parts: DataFrame, tasks: int) -> np.ndarray:
    """The sum of arrays held as bytes, one row a task at most, added in rounds of FAN_IN times fewer tasks. One array comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                own = np.frombuffer(x.as_py(), np.float64)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        parts = parts.repartition(tasks).mapInArrow(add, "sums binary")
    rows = parts.collect()
    return np.frombuffer(rows[0].sums, np.float64) if rows else np.zeros(0)


def task_sums(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of `of` over all batches: summed within each task first. rows: a scan of a table."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["sums"])

    return added(rows.mapInArrow(each, "sums binary"), rows.rdd.getNumPartitions())


def ridge(sums: np.ndarray, decay: float) -> np.ndarray:
    """Weights from the normal equations, rows of (Z'Z, Z'y); the constant, which comes last, is not shrunk."""
    a, b = sums[:, :-1].copy(), sums[:, -1]
    a[np.diag_indices(len(a) - 1)] += decay
    a[-1, -1] += 1e-9
    return np.linalg.solve(a, b)


def isotonic(at: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising curve nearest to the shares good / n by pooling adjacent violators. at: rising places, n: above 0."""
    blocks: list[list[float]] = []  # place * n, good, n
    for x, g, m in zip(at, good, n, strict=True):
        blocks.append([x * m, g, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(rows: DataFrame, features: int = 384, width: float = 1.5, decay: float = 0.3, seed: int = 42) -> Model:
    """rows: x, y (0 or 1) and fold, a written table. `width` is the kernel's, in units of the root of the number of statistics."""
    d = len(STATISTICS)
    plain = rows.select("x", "y", "fold")

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x, y = matrix(batch, 0), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
        return np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)])

    sums = task_sums(plain, moments)
    n, good = (sums[0], sums[1]) if len(sums) else (0.0, 0.0)
    share = (good + 1) / (n + 2)
    if not 0 < good < n:
        return Model(share)
    mean = sums[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(sums[2 + d :] / n - mean**2, 1e-8))
    draw = np.random.default_rng(seed)
    blank = Model(share, mean, scale, draw.normal(0, 1 / (width * math.sqrt(d)), (d, features)), draw.uniform(0, 2 * math.pi, features))
    size = features + 1

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z, y, fold = blank.features(matrix(batch, 0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float), batch.column(2).to_numpy(zero_copy_only=False)
        out = np.zeros((FOLDS, size, size + 1))
        for k in range(FOLDS):
            own = z[fold == k]
            out[k] = np.hstack([own.T @ own, (own.T @ y[fold == k])[:, None]])
        return out.ravel()

    folds = task_sums(plain, equations).reshape(FOLDS, size, size + 1)
    total = folds.sum(0)
    without = np.stack([ridge(total - f, decay) for f in folds], 1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = (blank.features(matrix(batch, 0)) @ without)[np.arange(batch.num_rows), batch.column(2).to_numpy(zero_copy_only=False)]
            at = np.floor((np.clip(raw, -0.5, 1.5) + 0.5) * GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1).cast(pa.int32())], ["at", "y"])

    counts = plain.mapInArrow(placed, "at int, y int").groupBy("at").agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")).orderBy("at").collect()  # 2 * GRID + 1 rows at most
    at, good_at, n_at = (np.array([float(r[k]) for r in counts]) for k in range(3))
    return Model(share, mean, scale, blank.turn, blank.shift, ridge(total, decay), isotonic((at + 0.5) / GRID - 0.5, good_at, n_at))


def learning_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """x, y, fold of the documents with a label. labels: doc_id, quality."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    return stats.join(known, "doc_id").select("x", "y", fold.alias("fold"))


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of measured() rows."""
    sent = stats.sparkSession.sparkContext.broadcast(model)  # its size depends on the number of features alone

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = sent.value.scores(matrix(batch, 1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return stats.mapInArrow(each, "doc_id long, score double")


def held_out(column: str = "doc_id"):
    """Rows that learning never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def rate(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id and score by a model that learnt from the labels outside held_out()."""
    stats = written(measured(docs), "statistics")
    rows = written(learning_rows(stats, labels.select("doc_id", "quality").filter(~held_out())), "learning")
    return scored(stats, fit(rows, **settings))
