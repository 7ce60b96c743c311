"""Products of sparse rows against plain loops, and that nothing is joined or shuffled for a pair."""

import math
import random

from pyspark.sql import functions as F

from arborank.operators import lexical as L
from arborank.operators import sparse
from arborank.operators.ordering import top_per


def documents(n=60, seed=3):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    rows = [(d, sorted(set(draw.choices(words, [1 / (k + 1) for k in range(40)], k=12)))) for d in range(n)]
    rows += [(n + d, rows[1][1]) for d in range(9)] + [(n + 20, ["lonely"])]  # copies, and a document that shares no term
    return {d: {w: 1.0 + (d % 7) * 0.1 if d < n else 1.1 for w in t} for d, t in rows}


def table(spark, docs):
    return spark.createDataFrame([(d, w, x) for d, t in docs.items() for w, x in t.items()], "doc_id long, term string, w double").repartition(3)


def test_similar_docs_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(sparse, "QUERY_ROWS", 8)
    monkeypatch.setattr(sparse, "ENTRY_ROWS", 16)
    monkeypatch.setattr(sparse, "HELD", 50)
    docs = documents()
    want = {}
    for a in [d for d in docs if d % 5 == 0]:
        sims = {b: round(sum(x * docs[b][w] for w, x in docs[a].items() if w in docs[b]), 6) for b in docs if b != a and docs[a].keys() & docs[b].keys()}
        want[a] = [(b, s) for b, s in sorted(sims.items(), key=lambda r: (-r[1], r[0]))[:5]]
    found = L.similar_docs(table(spark, docs), spark.createDataFrame([(d,) for d in docs if d % 5 == 0], "doc_id long"), 5)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # no row for a pair, nor for a shared term
    got = {}
    for r in found.orderBy("a", "rk").collect():
        got.setdefault(r.a, []).append((r.b, r.sim))
    assert got == {a: rows for a, rows in want.items() if rows}


def test_bm25_gives_only_the_best_of_each_task(spark):
    docs = documents()
    post = table(spark, docs).select("doc_id", "term", F.lit(1).cast("bigint").alias("tf"))
    queries = spark.createDataFrame([(q, f"w{w}", 1 + w % 2) for q in range(4) for w in range(q, 40, 4)], "query_id long, term string, qtf long")
    every = L.bm25(post, queries, "plus")
    best = L.bm25(post, queries, "plus", k=3)
    rows = lambda x: sorted((r.query_id, r.doc_id, round(r.score, 6)) for r in top_per(x.withColumn("score", F.round("score", 6)), ["query_id"], [F.desc("score"), F.col("doc_id")], 3).collect())
    assert rows(best) == rows(every) and best.count() <= 3 * 4 * best.rdd.getNumPartitions() < every.count() * 4


def test_no_queries(spark):
    post = table(spark, documents()).select("doc_id", "term", F.lit(1).cast("bigint").alias("tf"))
    assert L.bm25(post, spark.createDataFrame([], "query_id long, term string, qtf long"), k=3).isEmpty()


def test_similar_ensemble_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(sparse, "QUERY_ROWS", 8)
    monkeypatch.setattr(sparse, "ENTRY_ROWS", 16)
    docs = documents()
    draw = random.Random(5)
    vectors = {d: [draw.gauss(0, 1) for _ in range(4)] for d in [*docs, 500]}  # 500 has no weights
    vectors[3] = [0.0] * 4
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {}
    for a in [d for d in vectors if d % 5 == 0]:
        scores = {}
        for b in [d for d in vectors if d != a]:
            long = (dot(vectors[a], vectors[a]) * dot(vectors[b], vectors[b])) ** 0.5
            sparse_part = sum(x * docs.get(b, {}).get(w, 0) for w, x in docs.get(a, {}).items())
            scores[b] = round(0.2 * (dot(vectors[a], vectors[b]) / long if long else 0) + 0.8 * sparse_part, 6)
        want[a] = [(b, s) for b, s in sorted(scores.items(), key=lambda r: (-r[1], r[0]))[:5]]
    dense = spark.createDataFrame(list(vectors.items()), "id long, v array<double>").repartition(3)
    found = L.similar_ensemble(table(spark, docs), dense, spark.createDataFrame([(d,) for d in vectors if d % 5 == 0], "doc_id long"), 5, 0.2)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.orderBy("a", "rk").collect():
        got.setdefault(r.a, []).append((r.b, r.score))
    assert got == want


def test_bm25_without_what_was_read_in_blocks_of_either_side(spark, monkeypatch):
    for name, value in (("QUERY_ROWS", 4), ("ENTRY_ROWS", 5), ("ENTRY_BLOCK", 7)):
        monkeypatch.setattr(sparse, name, value)
    draw = random.Random(2)
    words = [f"w{k}" for k in range(15)]
    post = spark.createDataFrame([(d, w, draw.randint(1, 4)) for d in range(20) for w in draw.sample(words, 6)], "doc_id long, term string, tf long").repartition(3)
    for users, terms in ((3, 2), (60, 9)):  # few queries, and so many that the documents go to them
        queries = spark.createDataFrame([(q, w, draw.randint(1, 3)) for q in range(users) for w in draw.sample(words, terms)], "query_id long, term string, qtf long").repartition(3)
        read = spark.createDataFrame([(q, d) for q in range(0, users + 3, 2) for d in draw.sample(range(25), 8)], "query_id long, doc_id long")
        want = L.best_docs(L.bm25(post, queries), 3, read)
        asked = []
        monkeypatch.setattr(sparse, "asking", lambda *x, real=sparse.asking, asked=asked: asked.append(1) or real(*x))
        found = L.best_docs(L.bm25(post, queries, k=3, taken=read), 3)
        monkeypatch.undo()
        for name, value in (("QUERY_ROWS", 4), ("ENTRY_ROWS", 5), ("ENTRY_BLOCK", 7)):
            monkeypatch.setattr(sparse, name, value)
        assert "LeftAnti" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in want.collect())
        assert bool(asked) == (users == 60)


def test_profile_terms_move_lists(spark):
    draw = random.Random(6)
    words = [f"w{k:02}" for k in range(30)]
    post = {(d, w): draw.randint(1, 5) for d in range(12) for w in draw.sample(words, 14)}
    history = {(u, d) for u in range(9) for d in draw.sample(range(12), 3)}
    df = {w: sum(x == w for _, x in post) for w in words}
    n = len({d for d, _ in post})
    table = spark.createDataFrame([(d, w, c) for (d, w), c in post.items()], "doc_id long, term string, tf long").repartition(3)
    read = spark.createDataFrame(sorted(history), "user_id long, doc_id long").repartition(3)
    for how in ("tf", "concat", "tfidf", "distinct"):
        want = []
        for u in range(9):
            counts = {}
            for (d, w), c in post.items():
                counts[w] = counts.get(w, 0) + c * ((u, d) in history)
            counts = {w: round(c * math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1), 6) if how == "tfidf" else c for w, c in counts.items() if c}
            best = sorted(counts, key=lambda w: w if how == "distinct" else (-counts[w], w))[:5]
            want += [(u, w, {"tf": min(counts[w], 3), "concat": counts[w]}.get(how, 1)) for w in best]
        found = L.profile_terms(read, table, cap=5, how=how)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "explode(" in plan and "Exchange" not in plan.split("explode(")[0]  # terms are counted where the lists are
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)
