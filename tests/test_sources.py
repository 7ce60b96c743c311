"""Files in and out, parsers, the service's calls and the trained models."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from arborank import api
from arborank.functions import expressions as X
from arborank.operators import lexical as L
from arborank.operators import models as M
from arborank.operators import scoring as S
from arborank.sources import files, sinks


def test_csv(spark, tmp_path):
    for name, body in (("news", 'url1,"a ""b""\nc"\nurl2,\n'), ("sport", "url3,x,too,many\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "t.csv").write_text("url,title\n" + body)
    rows = files.csv_folders(spark, f"{tmp_path}/*/t.csv", "url string, title string").collect()
    assert {(r.url, r.title, r.source_category) for r in rows} >= {("url1", 'a "b"\nc', "news"), ("url2", None, "news")}
    kept = files.csv_table(spark, f"{tmp_path}/sport/t.csv", "url string, title string", lenient=True).count()
    assert kept == 0


def test_word_vectors_and_lists(spark, tmp_path):
    (tmp_path / "v.vec").write_text("3 2\na 1.0 2\nb 0 -1e-1\nbroken x y\nshort 1\n")
    rows = {r.word: list(r.embedding) for r in files.word_vectors(spark, str(tmp_path / "v.vec"), 2).collect()}
    assert rows == {"a": [1.0, 2.0], "b": [0.0, -0.1]}
    (tmp_path / "stop.txt").write_text("the\n of \n\nthe\n")
    assert files.word_list(spark, str(tmp_path / "stop.txt")) == ["of", "the"]
    (tmp_path / "ids.json").write_text(json.dumps({"u1": 0, "u2": 1}))
    assert {tuple(r) for r in files.id_map(spark, str(tmp_path / "ids.json")).collect()} == {("u1", 0), ("u2", 1)}


def test_alignment(spark):
    catalogue = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx int, key string")
    vectors = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [4.0])], "key string, embedding array<double>")
    assert {r.idx: list(r.embedding) for r in files.aligned_vectors(catalogue, vectors, 2).collect()} == {0: [1.0, 2.0], 1: [4.0, 0.0], 2: [0.0, 0.0]}


def test_parsers(spark):
    rows = spark.createDataFrame([("<h2>No</h2><a href=\"/x\">1</a><a class='c' href=\"/y-123\">2</a>",), ("",)], "h string")
    got = rows.select(files.cards(F.col("h")), files.first_match(F.col("h"), "<h1>([^<]*)</h1>", "<h2>([^<]*)</h2>"), files.number_at_end(F.get(files.cards(F.col("h")), F.lit(1)))).collect()
    assert [tuple(r) for r in got] == [(["/x", "/y-123"], "No", "123"), ([], None, None)]
    c = "array<struct<author:string,user_id:string,text:string,replies:array<struct<author:string,user_id:string,text:string>>>>"
    threads = spark.createDataFrame([("u1", [("A", "1", "hi", [("B", "2", "yo"), ("C", "3", "no")]), ("D", "4", "alone", [])]), ("u2", None)], f"article_url string, comments {c}")
    got = sorted(tuple(r) for r in files.flat_comments(threads).collect())
    assert got == [("u1", "A", "1", "hi", "B", "2", "yo"), ("u1", "A", "1", "hi", "C", "3", "no"), ("u1", "D", "4", "alone", "", "", ""), ("u2", "NO_COMMENT", "NO_COMMENT", "NO_COMMENT", "", "", "")]
    a, b = files.profile_fields(F.lit("Ann | joined 05/2020"), r"\| joined")
    assert tuple(spark.range(1).select(a, b).first()) == ("Ann", "05/2020")


def test_upsert_and_unseen(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in files.upserted(old, new, "k").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r.k for r in files.unseen(new, old, "k").collect()] == [3]


def test_sinks(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 0.5)], "src int, dst int, w double")
    sinks.write_graph({"reads": edges, "answers": edges.unionAll(edges)}, str(tmp_path / "g"))
    assert sinks.read_graph(spark, str(tmp_path / "g"), "answers").count() == 2
    for model, v in (("a", 0.1), ("b", 0.3)):
        sinks.write_metrics(spark.createDataFrame([("recall", 10, v)], "metric string, k bigint, value double"), model, str(tmp_path / "m"))
    assert [tuple(r) for r in sinks.leaderboard(spark, str(tmp_path / "m")).collect()] == [("recall", 10, "b", 0.3)]
    assert sinks.markdown(edges, "Edges").splitlines()[-1] == "| 1 | 2 | 0.5 |"


def test_shared_tables_can_be_cleared(spark):
    import os

    from arborank.sources import storage

    df = storage.written(spark.range(3).toDF("a"), "t")
    assert df.count() == 3 and os.path.isdir(storage.shared_root(spark))
    storage.clear_shared(spark)
    assert not os.path.isdir(storage.shared_root(spark))


def catalogue(spark):
    r = random.Random(1)
    items = [(k, f"title{k} {'apple' if k % 3 else 'pear'}", "words here", "ab"[k % 2], [r.gauss(0, 1) for _ in range(4)]) for k in range(20)]
    train = spark.createDataFrame([(u, i, 1.0) for u in range(8) for i in range(u, u + 6)], "user_id long, item_id long, r double")
    return api.Catalogue(spark.createDataFrame(items, "item_id long, title string, description string, category string, embedding array<double>"), train, S.similarity(train, k=5))


def test_recommend(spark):
    c = catalogue(spark)
    both = api.recommend(c, api.Request(user_id=2, history=[2, 3], k=5)).collect()
    assert len(both) == 5 and not {r.item_id for r in both} & {2, 3} and {r.source for r in both} <= {"CF", "Content"}
    assert api.recommend(c, api.Request()).collect() == []
    cold = api.recommend(c, api.Request(history=[1], filters=["a"], k=3)).collect()
    assert {r.source for r in cold} == {"Content"} and {r.category for r in cold} == {"a"}
    assert {r.source for r in api.recommend(c, api.Request(user_id=2, history=[2], alpha=1.0)).collect()} == {"CF"}


def test_search(spark):
    c = catalogue(spark)
    assert {r.item_id for r in api.search(c, "Pear", k=50).collect()} == {k for k in range(20) if k % 3 == 0}
    assert api.search(c, "nothing").collect() == []
    assert {r.item_id for r in api.search(c, "pear", filters=["b"]).collect()} == {3, 9, 15}
    assert api.configuration(c) == {"categories": ["a", "b"], "users": 8}


def test_svd_finds_the_best_rank(spark):
    r = np.random.default_rng(0)
    dense = r.normal(size=(12, 3)) @ r.normal(size=(3, 9))
    rows = spark.createDataFrame([(u, i, float(dense[u, i])) for u in range(12) for i in range(9)], "user_id long, item_id long, r double")
    users, items = M.svd(rows, 3)
    got = {(x.user_id, x.item_id): x.score for x in M.factor_scores(users, items).collect()}
    assert max(abs(got[u, i] - dense[u, i]) for u in range(12) for i in range(9)) < 1e-6


def test_als_is_not_negative(spark):
    rows = spark.createDataFrame([(u, i, float(1 + (u + i) % 3)) for u in range(8) for i in range(8)], "user_id int, item_id int, r double")
    users, items = M.als(rows, 4)
    assert all(x >= 0 for r in users.collect() for x in r.v) and items.count() == 8


def test_bpr_lowers_the_loss(spark):
    triples = spark.createDataFrame([(u, u % 4, (u + 2) % 4) for u in range(12)], "user_id long, pos long, neg long")
    start = lambda key, n: spark.range(n).select(F.col("id").alias(key), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda d: X.hash_unit(F.lit(key), F.col("id"), d) - 0.5).alias("v"))
    users, items = start("user_id", 12), start("item_id", 4)

    def loss(a, b):
        return S.bpr_loss(triples, M.factor_scores(a, b)).first().bpr_loss

    assert loss(*M.bpr(triples, users, items, rounds=4, rate=0.5)) < loss(users, items)


def test_word_and_document_vectors(spark):
    docs = spark.createDataFrame([(k, "red blue red green" if k % 2 else "one two two three") for k in range(20)], "doc_id long, text string")
    vectors = M.word2vec(docs, X.tokens(F.col("text")), 4)
    assert vectors.count() == 6
    post = L.postings(docs, X.tokens(F.col("text")))
    table = {r.word: np.array(r.embedding) for r in vectors.collect()}
    for how in ("mean", "sum", "tfidf", "sif"):
        got = {(r.doc_id, r.dim): r.value for r in M.doc_vectors(post, vectors, how).collect()}
        assert len(got) == 80
        if how in ("mean", "sum"):
            want = (2 * table["red"] + table["blue"] + table["green"]) / (4 if how == "mean" else 1)
            assert all(abs(got[1, d] - want[d]) < 1e-6 for d in range(4))


def test_first_component_goes(spark):
    r = np.random.default_rng(1)
    rows = [(k, (np.array([5.0, 0, 0]) * r.normal() + r.normal(size=3) * 0.1).tolist()) for k in range(50)]
    got = np.array([list(x.embedding) for x in M.without_first_component(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()])
    assert np.abs(got).max() < 1.0


def test_quantizer(spark):
    r = np.random.default_rng(2)
    rows = spark.createDataFrame([(k, r.normal(size=4).tolist()) for k in range(60)], "vec_id long, embedding array<double>")
    got = S.quantize(rows, 2, 4).collect()
    assert all(len(x.codes) == 2 and all(0 <= c < 4 for c in x.codes) for x in got) and len(got) == 60


def test_settings(spark, tmp_path):
    (tmp_path / "c.toml").write_text('name = "x"\n[spark]\n"spark.sql.shuffle.partitions" = 4\n[crawl]\npages = [1, 2]\n')
    assert files.settings(spark, str(tmp_path / "c.toml")) == {"name": "x", "spark": {"spark.sql.shuffle.partitions": 4}, "crawl": {"pages": [1, 2]}}
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_checkpoints_of_the_wrong_shape_are_left(spark, tmp_path):
    factors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    sinks.save_checkpoint(factors, str(tmp_path), "a", 5, 2)
    assert sinks.best_checkpoint(spark, str(tmp_path), 3, 2) is None
    assert sinks.best_checkpoint(spark, str(tmp_path), 2, 2).count() == 2


def test_texts_survive_csv(spark, tmp_path):
    rows = [(1, ' "a",\n b \\" '), (2, "x\t,;"), (3, "é\n\n")]
    sinks.write_csv(spark.createDataFrame(rows, "k long, s string"), str(tmp_path / "t"))
    assert sorted(tuple(r) for r in files.csv_table(spark, str(tmp_path / "t"), "k long, s string").collect()) == rows


def test_lsa_is_the_best_rank(spark):
    r = np.random.default_rng(4)
    dense = np.abs(r.normal(size=(15, 3)) @ r.normal(size=(3, 10)))
    weights = spark.createDataFrame([(d, f"t{k}", float(dense[d, k])) for d in range(15) for k in range(10)], "doc_id long, term string, w double")
    got = {x.vec_id: np.array(x.embedding) for x in M.lsa(weights, 10, rounds=8).collect()}
    mine = np.array([[got[a] @ got[b] for b in range(15)] for a in range(15)])
    assert np.abs(mine - dense @ dense.T).max() < 1e-6


def test_training_ends_when_it_gets_no_better(spark):
    triples = spark.createDataFrame([(u, u % 3, (u + 1) % 3) for u in range(9)], "user_id long, pos long, neg long")
    start = lambda key, n: spark.range(n).select(F.col("id").alias(key), F.transform(F.sequence(F.lit(1), F.lit(2)), lambda d: X.hash_unit(F.lit(key), F.col("id"), d) - 0.5).alias("v"))
    values = iter([1.0, 2.0, 1.5, 1.2, 9.0])
    users, _, seen = M.trained(triples, start("user_id", 9), start("item_id", 3), lambda u, i: next(values), rounds=10, patience=2)
    assert seen == [(0, 1.0), (1, 2.0), (2, 1.5), (3, 1.2)] and users.count() == 9
