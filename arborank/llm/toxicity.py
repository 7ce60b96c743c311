"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A sentence's score is a logistic function of its words' features (the word and its first letters); a document is toxic
unless all of its sentences are clean: p(document) = 1 - product of (1 - p(sentence)). Training reads at most
`max_per_class` labelled documents a class, those with the smallest hash of their id: their features are counted on Spark, the
best are kept, and the likelihood of the document labels is climbed over the sentences that hold any. Classes are
weighted back to their shares. A sentence without any of the features counts nothing, so that length alone makes no document toxic.
Scoring reads every whole text and also names the sentences that score highest.

Defined cases: a null or empty text has no sentence and scores 0; without labels of both classes the model knows no feature; an id with
several labels is toxic if any says so; repeated rows are scored each; labels without a document are unused.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

SENTENCE = re.compile(r"[.!?\n…]+")
#: The largest log odds of a sentence before its features count.
BIAS = -12.0
EDGES = ".,;:!?\"'()[]{}<>|*#-_“”«»¡¿"


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s.strip()]


def features(word: str) -> list[str]:
    word = word.lower().strip(EDGES)
    if not word:
        return []
    return [word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n)]


@dataclass(frozen=True)
class Model:
    bias: float = BIAS
    weights: dict[str, float] = field(default_factory=dict)


class WordScores(dict):
    """The sum of the weights of a word's features."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 100_000:
            self.clear()
        self[word] = made = sum(self.weights.get(f, 0.0) for f in features(word))
        return made


def sampled(docs: DataFrame, labels: DataFrame, max_per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic) of the sample, a row an id, and the number of labelled ids a class."""
    labels = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    part = [labels.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for k in (0, 1)]
    chosen = part[0].unionByName(part[1])  # 2 * max_per_class rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), sizes  # one row an id


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = 4000, max_features: int = 4000, rounds: int = 600) -> Model:
    """labels: doc_id, toxic. Both bounds hold at every size of the input."""
    rows, sizes = sampled(docs, labels, max_per_class)
    rows = rows.persist()
    try:
        taken = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
        if not taken.get(0) or not taken.get(1):
            return Model()
        chosen = best_features(rows, taken, max_features)
        return fit([tuple(r) for r in bags(rows, chosen).collect()], chosen, {k: sizes[k] / taken[k] for k in taken}, rounds)
    finally:
        rows.unpersist()


def best_features(rows: DataFrame, taken: dict[int, int], most: int) -> dict[str, float]:
    """The features that lean most to toxic documents, with their log odds."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            own = [list({f for w in {*t.decode("utf-8", "replace").split()} for f in features(w)}) for t in texts]
            toxic = np.repeat(part.column(2).to_numpy(zero_copy_only=False).astype(np.int32), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array([f for x in own for f in x], pa.string()), pa.array(toxic)], ["feature", "toxic"])

    counts = rows.select("doc_id", "text", "toxic").mapInArrow(found, "feature string, toxic int").groupBy("feature").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("fine"))
    odds = F.log((F.col("bad") + 0.1) / (taken[1] + 0.2)) - F.log((F.col("fine") + 0.1) / (taken[0] + 0.2))
    # how far the share of toxic documents is from chance, in standard errors
    share = taken[1] / (taken[0] + taken[1])
    n = F.col("bad") + F.col("fine")
    z = (F.col("bad") - n * share) / F.sqrt(n * (share * (1 - share)) + 0.5)
    best = counts.filter("bad >= 2").select("feature", odds.alias("odds"), z.alias("z")).filter("z > 3.6").orderBy(F.desc("z"), "feature").limit(most)
    return {r.feature: r.odds for r in best.collect()}


def bags(rows: DataFrame, chosen: dict[str, float]) -> DataFrame:
    """toxic, hits (of each sentence that has any chosen feature, their numbers)."""
    numbers = {f: k for k, f in enumerate(chosen)}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            hits = [[x for s in sentences(t.decode("utf-8", "replace")) if (x := [numbers[f] for w in s.split() for f in features(w) if f in numbers])] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(2).cast(pa.int32()), pa.array(hits, pa.list_(pa.list_(pa.int32())))], ["toxic", "hits"])

    return rows.select("doc_id", "text", "toxic").mapInArrow(each, "toxic int, hits array<array<int>>")


def fit(bags: list[tuple[int, list[list[int]]]], chosen: dict[str, float], weight: dict[int, float], rounds: int, decay: float = 1e-4, step: float = 0.05) -> Model:
    """Climbs the weighted likelihood of the noisy-or by Adam. With softplus s(z) summed over the sentences to S, p = 1 - exp(-S)."""
    toxic = np.array([b[0] for b in bags], float)
    each = np.array([weight[int(y)] for y in toxic])
    each /= each.sum()
    doc = np.array([d for d, b in enumerate(bags) for _ in b[1]], np.int64)
    hits = [x for b in bags for x in b[1]]
    sentence = np.repeat(np.arange(len(hits)), [len(x) for x in hits])
    feature = np.array([f for x in hits for f in x], np.int64)
    w, b = 0.5 * np.clip(np.array(list(chosen.values())), -4, 6), BIAS
    start = w.copy()
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(sentence, w[feature], len(hits)) if len(hits) else np.zeros(0)
        total = np.bincount(doc, np.logaddexp(0, z), len(bags))
        pull = each * np.where(toxic > 0, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0)
        dz = pull[doc] / (1 + np.exp(-np.clip(z, -50, 50)))
        grad = np.concatenate([np.bincount(feature, dz[sentence], len(w)) + decay * (w - start), [dz.sum() + 1e-4 * (b - BIAS)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, b = w - move[:-1], float(min(b - move[-1], BIAS))
    return Model(b, dict(zip(chosen, w.tolist(), strict=True)))


def noisy_or(text: str, bias: float, words: WordScores) -> tuple[float, int, list[tuple[float, int]]]:
    """The document's score, its number of sentences, and (score, number) of those above 0.5."""
    parts, total, top = sentences(text), 0.0, []
    for k, s in enumerate(parts):
        x = sum(map(words.__getitem__, s.split()))
        if x:
            z = bias + x
            total += math.log1p(math.exp(z)) if z < 30 else z
            if z > 0:
                top.append((1 / (1 + math.exp(-min(z, 50))), k))
    return -math.expm1(-total), len(parts), top


def scored(docs: DataFrame, model: Model, worst: int = 3) -> DataFrame:
    """doc_id, score, n_sentences, worst (number of the sentence and its score, of the highest ones above 0.5)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordScores(sent.value.weights)
        for part, texts in slices(batches):
            found = [noisy_or(t.decode("utf-8", "replace"), sent.value.bias, words) for t in texts]
            tops = [[{"sentence": k, "score": p} for p, k in sorted(top, key=lambda x: (-x[0], x[1]))[:worst]] for _, _, top in found]
            kind = pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int32()), pa.array(tops, kind)], ["doc_id", "score", "n_sentences", "worst"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, score double, n_sentences int, worst array<struct<sentence:int,score:double>>")


def score(model: Model, text: Column) -> Column:
    """The score of a text column, as in scored()."""

    @F.arrow_udf("double")
    def each(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = WordScores(model.weights)
        for batch in texts:
            yield pa.array([noisy_or(t.as_py() or "", model.bias, words)[0] for t in batch], pa.float64())

    return each(text.cast("string"))


def held_out(column: str = "doc_id"):
    """Rows that training never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def rate(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """scored() by a model that learnt from the labels outside held_out()."""
    return scored(docs, train(docs, labels.select("doc_id", "toxic").filter(~held_out()), **bounds))
