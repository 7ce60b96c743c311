"""Vectors stay arrays up to the sums, and the pairs behind a graph are read once."""

import datetime

from pyspark.sql import functions as F

import __spark_entry__ as entry
from arborank.operators import graph as G
from arborank.operators import models as M
from arborank.plans import model_queries as Q
from arborank.sources.bindings import Tables

DATA = "/root/testdata/sf0.001"


def test_document_vectors_are_summed_as_arrays(spark):
    post = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "b", 3)], "doc_id long, term string, tf long")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, -1.0])], "word string, embedding array<double>")
    found = M.doc_vectors(post, vectors, "sum")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # dimensions become rows above the sums, not below
    assert sorted(map(tuple, found.collect())) == [(1, 0, 5.0), (1, 1, 3.0), (2, 0, 9.0), (2, 1, -3.0)]


def test_session_vectors_are_summed_as_arrays(spark):
    plan = entry.queries()["session_profiles"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode(transform") < plan.index("Aggregate")


def test_layers_read_the_written_edges(spark):
    t = Tables(spark, DATA)
    edges = Q.interest(t)
    for rows in (edges, Q.start_vectors(edges)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
    assert edges.filter(F.col("src").startswith("u")).count() == edges.filter(F.col("src").startswith("i")).count() > 0


def test_a_triple_carries_one_difference(spark):
    triples = spark.createDataFrame([(1, 10, 11), (2, 10, 11), (1, 11, 12), (3, 10, 99)], "user_id long, pos long, neg long")
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 2.0]), (3, [1.0, 1.0])], "user_id long, v array<double>")
    items = spark.createDataFrame([(10, [1.0, 2.0]), (11, [3.0, 1.0]), (12, [0.0, 1.0])], "item_id long, v array<double>")
    got = M.gapped(triples, triples.select("pos", "neg").distinct(), users, items)
    assert sorted((r.user_id, r.pos, r.neg, r.u, r.d) for r in got.collect()) == [(1, 10, 11, [1.0, 0.0], [-2.0, 1.0]), (1, 11, 12, [1.0, 0.0], [3.0, 0.0]), (2, 10, 11, [0.5, 2.0], [-2.0, 1.0])]
    one = M.bpr(triples, users, items, rounds=1, rate=1.0, decay=0.0)[1].filter("item_id = 12").first().v
    pull = 1 / (1 + 2.718281828459045**3.0)  # user 1 with items 11 and 12
    assert abs(one[0] + pull) < 1e-9 and abs(one[1] - 1.0) < 1e-9


def test_asked_cross_category_moves_classes(spark, monkeypatch):
    monkeypatch.setattr(G, "LIST_ITEMS", 3)
    rows = [(u, c) for u in range(60) for c in "abcdef" if (u >> (ord(c) - 97)) & 1 or u % 7 == 0]
    each = spark.createDataFrame(rows, "user_id long, category string")
    has = {u: {c for v, c in rows if v == u} for u in range(60)}
    want = sorted((a, b, len(has[a] & has[b])) for a in range(0, 60, 5) for b in range(60) if a != b and len(has[a] & has[b]) >= 3)
    asked = each.filter("user_id % 5 = 0")
    found = G.asked_cross_category(each, asked, 3)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()  # pairs of users are neither counted nor joined


def test_day_adjacency_joins_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "LIST_ITEMS", 3)
    day = datetime.date(2024, 1, 1)
    days = spark.createDataFrame([(i, day + datetime.timedelta(days=i % 3)) for i in range(20)] + [(30, None), (31, day + datetime.timedelta(days=9))], "item_id long, day date")
    reads = spark.createDataFrame([(u, (u * u + k) % 20, 1.0) for u in range(12) for k in range(3)], "src long, dst long, w double").unionByName(spark.createDataFrame([(0, 30, 1.0), (1, 31, 1.0)], "src long, dst long, w double"))
    users = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (40, 41)], "src long, dst long")
    same = days.join(days.select("day", F.col("item_id").alias("dst")), "day").filter("item_id < dst").select(F.col("item_id").alias("src"), "dst")
    sorted_rows = lambda rows: sorted((r.src, r.dst, round(r.w, 9)) for r in rows.collect())
    found = G.day_adjacency(reads, days, users, 0.5)
    assert sorted_rows(found) == sorted_rows(G.block_adjacency(reads, same, users, 0.5))
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()  # edges are weighed where they are made
