import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from arborank.llm import kernel_quality as kernel
from arborank.llm import queries

from .rows import documents, documents_df, prose


def labelled(n=320):
    r = random.Random(5)
    docs, labels = [], []
    for k in range(n):
        text = ". ".join(prose(r.randrange(8, 20), 1000 + 40 * k + j, 300).capitalize() for j in range(r.randrange(3, 12)))
        bad = k % 4 == 0
        if bad:
            text = text.upper() if k % 8 else " | ".join(text.split())
        docs.append((k, text))
        labels.append((k, int(not bad)))
    return docs, labels


def labels_df(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_it_learns_and_scores_every_row(spark):
    docs, labels = labelled()
    rows = kernel.rate(documents_df(spark, [*docs, (None, None), (900, ""), (900, " \n "), *documents()]), labels_df(spark, [*labels, (None, 1), (5000, 1), (900, None)])).collect()
    y = dict(labels)
    assert len(rows) == len(docs) + 3 + len(documents()) and all(0 <= r.score <= 1 for r in rows)
    held = [(r.score, y[r.doc_id]) for r in rows if r.doc_id in y and r.doc_id > 20 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 50 and sum((s >= 0.7) == bool(v) for s, v in held) >= 0.95 * len(held)


def test_labels_of_one_class_or_none(spark):
    df = documents_df(spark)
    for labels, want in (([], 1 / 2), ([(1, 1), (3, 1), (3, 7)], 3 / 4), ([(1, 0)], 1 / 3)):
        kept = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 4 != 2]
        assert len(kept) == len(labels)
        assert {r.score for r in kernel.rate(df, labels_df(spark, labels)).collect()} == {want}
    assert kernel.rate(documents_df(spark, []), labels_df(spark, [])).collect() == []


def test_fit_against_plain_numpy(spark):
    """Ridge weights from one least squares problem, the curve by its min-max formula."""
    docs, labels = labelled(160)
    stats = kernel.measured(documents_df(spark, docs))
    rows = spark.createDataFrame(kernel.learning_rows(stats, labels_df(spark, [*labels, (0, 0), (1, 1)])).collect())
    model = kernel.fit(rows, features=32, decay=0.2)
    x, y, fold = (np.array([r[k] for r in rows.collect()], float) for k in ("x", "y", "fold"))
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-4))
    z = np.hstack([np.cos(np.clip((x - model.mean) / model.scale, -5, 5) @ model.turn + model.shift) * math.sqrt(2 / 32), np.ones((len(x), 1))])

    def plain(z, y):
        shrink = math.sqrt(0.2) * np.eye(33)[:32]
        return np.linalg.lstsq(np.vstack([z, shrink]), np.concatenate([y, np.zeros(32)]), rcond=None)[0]

    assert np.allclose(model.weights, plain(z, y), atol=1e-5)
    raw = np.zeros(len(y))
    for k in range(kernel.FOLDS):
        raw[fold == k] = z[fold == k] @ plain(z[fold != k], y[fold != k])
    at = np.floor((np.clip(raw, -0.5, 1.5) + 0.5) * kernel.GRID)
    places = np.unique(at)
    good, n = (np.array([f(at == p) for p in places]) for f in (lambda m: y[m].sum(), np.sum))
    best = [max(min(good[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(places))) for i in range(k + 1)) for k in range(len(places))]
    curve = np.interp((places + 0.5) / kernel.GRID - 0.5, *model.knots)
    ends = np.isin(np.round((places + 0.5) / kernel.GRID - 0.5, 9), np.round(model.knots[0], 9))
    assert np.allclose(curve[ends], np.array(best)[ends], atol=1e-9) and (np.diff(model.knots[1]) > 0).all()
    assert {round(v, 9) for v in model.knots[1]} == {round(float(v), 9) for v in best}


def test_features_approximate_a_gaussian_kernel():
    draw = np.random.default_rng(1)
    d = len(kernel.STATISTICS)
    m = kernel.Model(0.5, np.zeros(d), np.ones(d), draw.normal(0, 1 / math.sqrt(d), (d, 20_000)), draw.uniform(0, 2 * math.pi, 20_000))
    x = draw.normal(0, 1, (20, d))
    z = m.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * d))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_statistics():
    assert kernel.statistics(b"") == kernel.statistics(b" \n\t") == [0.0] * len(kernel.STATISTICS)
    one = dict(zip(kernel.STATISTICS, kernel.statistics("Ab cd. Ab cd!\nAb cd. x### Straße\nAb cd.".encode()), strict=True))
    assert one["words"] == math.log1p(10) and one["top_word"] == math.sqrt(0.4) and one["same_as_before"] == 0
    assert abs(one["distinct"] - 5 / 10) < 1e-9 and one["repeated_lines"] == 0 and abs(one["repeated_sentences"] ** 2 - 3 / 5) < 1e-9
    assert abs(one["marked_words"] - 0.1) < 1e-9 and abs(one["capital_words"] - 0.5) < 1e-9
    assert all(math.isfinite(v) for _, t in documents() for v in kernel.statistics((t or "").encode()))


def test_held_out_accuracy_on_the_tables(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op12_kernel_quality(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").filter("quality is not null").collect()
    held = [(rows[r.doc_id].predicted, r.quality) for r in labels if r.doc_id in rows and rows[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in rows.items())
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_sums_are_added_in_rounds(spark):
    df = spark.range(0, 1000, 1, 37).select(F.col("id").cast("double").alias("v"))
    assert kernel.task_sums(df, lambda b: np.array([b.column(0).to_numpy().sum(), b.num_rows])).tolist() == [499500.0, 1000.0]
    assert len(kernel.task_sums(df.filter("v < 0"), lambda b: np.ones(1))) == 0
