"""Edge cases of the reference-side operators."""

import datetime
import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from arborank.functions import expressions as X
from arborank.operators import graph as G
from arborank.operators import interactions as I
from arborank.operators import lexical as L
from arborank.operators import ordering as O
from arborank.operators import ranking as R
from arborank.operators import scoring as S
from arborank.plans import service_queries
from arborank.sources import bindings


def test_clean_ids(spark):
    raw = ["123.0", "123", "", "nan", "NaN", "NAN", None, "N/A", "N/A (Format Error)", "abc", "NO_COMMENT", " 7 ", "1e3", "inf"]
    rows = spark.createDataFrame([(x,) for x in raw], "s string").select(X.clean_id(F.col("s")), X.real_id(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["123", "123", None, None, None, None, None, "N/A", "N/A (Format Error)", "abc", "NO_COMMENT", "7", "1000", "inf"]
    assert [r[1] for r in rows] == ["123", "123", None, None, None, None, None, None, None, "abc", None, "7", "1000", "inf"]


def test_reactions(spark):
    raw = ["5", "", "1.2K", "-3", None, "2.5"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "s string").select(X.non_negative(F.col("s"))).collect()]
    assert got == [5, 0, 0, 0, 0, 2.5]


def test_dates(spark):
    cases = {
        "2h trước": "2025-01-01 10:00:00", "30p trước": "2025-01-01 11:30:00", "5h trước - site": "2025-01-01 07:00:00", "3p trước, 2h trước": "2025-01-01 10:00:00",
        "23:59 31/12": "2024-12-31 23:59:00", "08:00 1/1": "2025-01-01 08:00:00", "9:5  1/1": "2025-01-01 09:05:00", "Lúc 9:05 1/1 (GMT+7)": "2025-01-01 09:05:00",
        "10:00 29/2": None, "25:00 1/1": None, "junk": None, "": None, "nan": None, None: None,
    }
    now = F.lit("2025-01-01 12:00:00").cast("timestamp")
    rows = spark.createDataFrame([(x,) for x in cases], "s string").select("s", X.relative_date(F.col("s"), now).cast("string").alias("at")).collect()
    assert {r.s: r["at"] for r in rows} == cases
    rows = spark.createDataFrame([("on 05/11/2023, 10:00",), ("none",), ("31/02/2023",), (None,)], "s string").select(X.day_in_text(F.col("s"))).collect()
    assert [r[0] for r in rows] == [datetime.date(2023, 11, 5), None, None, None]


def test_first_by_puts_nulls_last(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, None, 6), (1, 0, 7), (2, None, 8)], "k int, ts int, v int")
    assert sorted(tuple(r) for r in bindings.first_by(rows, ["k"], [F.col("ts"), F.col("v")]).collect()) == [(1, 0, 7), (2, None, 8)]


def test_k_core(spark):
    r = random.Random(1)
    for least in (2, 3, 9):
        pairs = {(r.randrange(12), r.randrange(12)) for _ in range(60)}
        want = set(pairs)
        while True:
            users = {u for u, _ in want if sum(x == u for x, _ in want) >= least}
            items = {i for _, i in want if sum(x == i for _, x in want) >= least}
            new = {(u, i) for u, i in want if u in users and i in items}
            if new == want:
                break
            want = new
        got = {tuple(x) for x in I.k_core(spark.createDataFrame(sorted(pairs), "user_id long, item_id long"), least, least).collect()}
        assert got == want
        assert {tuple(x) for x in I.k_core(spark.createDataFrame(sorted(want), "user_id long, item_id long"), least, least).collect()} == want


def test_splits(spark):
    rows = [(u, i, datetime.datetime(2024, 1, 1 + i)) for u, n in ((1, 1), (2, 2), (3, 5), (4, 10)) for i in range(n)]
    pairs = spark.createDataFrame(rows, "user_id long, item_id long, ts timestamp")
    for split in (I.split_hash, I.split_time, I.split_per_user, I.split_last_out):
        got = split(pairs).collect()
        assert sorted((r.user_id, r.item_id) for r in got) == sorted(r[:2] for r in rows)
        assert {r.split for r in got} <= {"train", "test"}
    assert all(r.split == "train" for r in I.split_per_user(pairs).collect() if r.user_id == 1)
    last = {r.user_id: r.item_id for r in I.split_last_out(pairs).collect() if r.split == "test"}
    assert last == {2: 1, 3: 4, 4: 9}
    by_time = I.split_time(pairs).collect()
    assert max(r.ts for r in by_time if r.split == "train") <= min(r.ts for r in by_time if r.split == "test")


def test_numbered(spark):
    r = random.Random(2)
    values = r.sample(range(10000), 500)
    got = O.numbered(spark.createDataFrame([(v,) for v in values], "v long"), ["v"]).collect()
    assert {x.v: x.rn for x in got} == {v: k + 1 for k, v in enumerate(sorted(values))}
    assert O.numbered(spark.createDataFrame([], "v long"), ["v"]).collect() == []


def test_negatives_are_free(spark):
    pairs = spark.createDataFrame([(u, i) for u in range(5) for i in range(u, u + 10)], "user_id long, item_id long")
    got = I.negatives(pairs, pairs, pairs, 3).collect()
    own = {tuple(r) for r in pairs.collect()}
    assert len(got) == 15 and not {(r.user_id, r.item_id) for r in got} & own


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(99, 99)]
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {x.node: x.label for x in G.components(spark.createDataFrame(edges, "src long, dst long")).collect()} == label


def test_adjacency_is_symmetric(spark):
    edges = G.as_nodes(spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (2, 2, 0.5)], "src long, dst long, w double"))
    got = {(r.src, r.dst): r.w for r in G.normalised(edges).collect()}
    assert all(abs(got[b, a] - w) < 1e-12 for (a, b), w in got.items())
    assert abs(got["u1", "i1"] - 2 / math.sqrt(3 * 2)) < 1e-12


def test_same_days(spark):
    days = spark.createDataFrame([(k, datetime.date(2024, 1, 1 + d)) for k, d in enumerate((0, 0, 2, 5, 6))], "item_id long, day date")
    assert sorted(tuple(r) for r in G.same_days(days).collect()) == [(0, 1)]
    assert sorted(tuple(r) for r in G.same_days(days, 2).collect()) == [(0, 1), (0, 2), (1, 2), (3, 4)]


def test_vectors(spark):
    rows = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    got = rows.select(X.cosine(F.col("a"), F.col("b")), X.unit(F.col("a"))).collect()
    assert [r[0] for r in got] == [0.0, 1.0, 0.0]
    assert [list(r[1]) for r in got] == [[0.0, 0.0], [0.6, 0.8], [1.0, 0.0]]


def test_tokens(spark):
    rows = spark.createDataFrame([("<b>Hi</b> see https://x.y/z, the Café!",), ("",), ("the of",), (None,)], "s string")
    got = [r[0] for r in rows.select(X.tokens(X.cleaned(F.col("s")), ["the", "of", "see"])).collect()]
    assert got == [["hi", "café"], [], [], None]
    got = [r[0] for r in spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>").select(X.ngrams(F.col("w"), 2)).collect()]
    assert got == [["a b", "b c"], [], []]


def test_bm25_against_a_loop(spark):
    docs = [(1, "a b b c"), (2, "a d"), (3, "e e e f"), (4, "")]
    post = L.postings(spark.createDataFrame(docs, "doc_id long, text string"), X.tokens(F.col("text")))
    queries = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "zz", 1), (2, "zz", 1)], "query_id long, term string, qtf long")
    tf = {d: {w: t.split().count(w) for w in t.split()} for d, t in docs if t}
    n, avg = len(tf), sum(sum(x.values()) for x in tf.values()) / len(tf)
    for kind in ("okapi", "plus", "l"):
        want = {}
        for d, words in tf.items():
            for term, q in (("a", 1), ("b", 2)):
                if term in words:
                    df = sum(term in x for x in tf.values())
                    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
                    length = 0.25 + 0.75 * sum(words.values()) / avg
                    if kind == "l":
                        c = words[term] / length
                        s = 2.5 * (c + 0.5) / (1.5 + c + 0.5)
                    else:
                        s = words[term] * 2.5 / (words[term] + 1.5 * length) + (0.5 if kind == "plus" else 0)
                    want[d] = want.get(d, 0) + q * idf * s
        got = {r.doc_id: r.score for r in L.bm25(post, queries, kind).collect()}
        assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in got)


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1), (3, 13, 1)], "user_id long, item_id long, rk long")
    test = spark.createDataFrame([(1, 11), (1, 12), (1, 99), (2, 50), (3, 13)], "user_id long, item_id long")
    got = {r.metric: r.value for r in R.list_metrics(ranked, test, [2]).collect()}
    ndcg = (1 / math.log2(3)) / (1 + 1 / math.log2(3))
    f1 = 2 * (1 / 3) * 0.5 / (1 / 3 + 0.5)
    want = {"recall": (1 / 3 + 0 + 1) / 3, "precision": (0.5 + 0 + 0.5) / 3, "ndcg": (ndcg + 0 + 1) / 3, "hit": 2 / 3, "mrr": (0.5 + 0 + 1) / 3, "map": (0.25 + 0 + 1) / 3, "f1": (f1 + 0 + 2 * 0.5 / 1.5) / 3}
    assert got.keys() == want.keys() and all(abs(got[m] - want[m]) < 1e-6 for m in want)


def test_auc_with_ties(spark):
    scores = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.1), (2, 1, 0.4)], "user_id long, item_id long, score double")
    got = R.auc(scores, spark.createDataFrame([(1, 2), (2, 1)], "user_id long, item_id long")).collect()
    assert [(r.user_id, r.auc) for r in got] == [(1, 0.5)]


def candidates(n=30, seed=5):
    r = np.random.default_rng(seed)
    return [(1, k, round(float(r.random()), 3)) for k in range(n)], {k: r.normal(size=4) for k in range(n)}, {k: int(r.integers(0, 4)) for k in range(n)}


def test_mmr_against_a_loop(spark):
    rows, vectors, _ = candidates()
    got = R.mmr(spark.createDataFrame(rows, "user_id long, item_id long, score double"), spark.createDataFrame([(k, v.tolist()) for k, v in vectors.items()], "vec_id long, embedding array<double>"), 8)
    score, chosen = {k: s for _, k, s in rows}, []
    cos = lambda a, b: float(vectors[a] @ vectors[b] / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b]))
    for _ in range(8):
        left = [k for k in score if k not in chosen]
        chosen.append(max(left, key=lambda k: (round(0.5 * score[k] - 0.5 * max(cos(k, c) for c in chosen), 9) if chosen else score[k], score[k], -k)))
    assert [r.item_id for r in got.orderBy("rk").collect()] == chosen


def test_calibration_against_a_loop(spark):
    rows, _, cats = candidates()
    share = {0: 0.5, 1: 0.5}
    got = R.calibrated(
        spark.createDataFrame(rows, "user_id long, item_id long, score double"), spark.createDataFrame(list(cats.items()), "item_id long, category int"), spark.createDataFrame([(1, c, p) for c, p in share.items()], "user_id long, category int, p double"), 8
    )
    score, chosen = {k: s for _, k, s in rows}, []
    for n in range(1, 9):

        def value(k, n=n):
            new = [cats[x] for x in [*chosen, k]]
            kl = sum((q := new.count(c) / (n + 1e-9)) * math.log((q + 1e-9) / (share.get(c, 0) + 1e-9)) for c in set(new))
            return round(0.5 * score[k] - 0.5 * kl, 9), score[k], -k

        chosen.append(max((k for k in score if k not in chosen), key=value))
    assert [r.item_id for r in got.orderBy("rk").collect()] == chosen


def test_scaling_of_equal_scores(spark):
    rows = spark.createDataFrame([(1, 1, 3.0), (1, 2, 3.0), (2, 1, 1.0), (2, 2, 5.0)], "user_id long, item_id long, score double")
    assert sorted(tuple(r) for r in R.scaled(rows).collect()) == [(1, 1, 1.0), (1, 2, 1.0), (2, 1, 0.0), (2, 2, 1.0)]


def test_slope_one_by_hand(spark):
    rows = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.5), (2, 1, 2.0)], "user_id long, item_id long, r double")
    got = S.slope_one(rows, spark.createDataFrame([(2,)], "user_id long")).collect()
    assert [(r.item_id, r.score) for r in got] == [(2, 2.5)]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "user_id long, item_id long, r double, ts timestamp")
    assert S.similarity(none).collect() == []
    assert R.masked_top(none.withColumnRenamed("r", "score"), none, 5).collect() == []
    assert I.split_per_user(none).collect() == []
    assert G.shared_interest(none).collect() == []


def test_cross_category_of_all_users(spark):
    """The classes stand for just the pairs that the join gives, users without any link included."""
    r = random.Random(7)
    rows = [(u, c) for u in range(60) for c in range(5) if r.random() < 0.6] + [(60, 0), (61, None)]
    uc = spark.createDataFrame(rows, "user_id long, category int")
    want = {(p.src, p.dst) for p in G.cross_category(uc, 3).collect()}
    got = {x.user_id: x for x in G.cross_category_classes(uc, 3).collect()}
    assert got.keys() == {u for u, _ in rows}
    assert {(a, b) for a in got for b in got if a < b and got[b]["class"] in got[a].linked} == want
    assert all(x.links == sum(u in p for p in want) for u, x in got.items())


def test_cross_category_query_has_all_users(spark):
    import __spark_entry__ as entry

    data = "/root/testdata/sf0.001"
    users = bindings.interactions(bindings.Tables(spark, data)).select("user_id").distinct().count()
    assert entry.queries()["g7_cross_category_all"](spark, data).count() == users


def test_ranking_over_all_neighbours(spark):
    """Lists reach items that only neighbours past the twentieth share."""
    import __spark_entry__ as entry

    data = "/root/testdata/sf0.001"
    tables = bindings.Tables(spark, data)
    train = I.split_time(bindings.interactions(tables)).filter("split = 'train'").select("user_id", "item_id", F.lit(1.0).alias("r"))
    scores = S.item_scores(train, S.similarity(train)).join(train, ["user_id", "item_id"], "left_anti")
    want = {(x.user_id, n + 1): round(s, 5) for x in scores.groupBy("user_id").agg(F.collect_list("score").alias("s")).collect() for n, s in enumerate(sorted(x.s, reverse=True)[:10])}
    got = {(x.user_id, x.rk): round(x.score, 5) for x in entry.queries()["rank_masked_top10_all"](spark, data).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-5 for k in want)


def test_running_sums(spark):
    rows = [(k, (k * 7) % 5) for k in range(50)]
    got = {r.k: r.total for r in O.running(spark.createDataFrame(rows, "k int, v int"), ["k"], F.col("v"), "total").collect()}
    assert got == {k: sum(v for j, v in rows if j <= k) for k, _ in rows}
    assert O.running(spark.createDataFrame([], "k int, v int"), ["k"], F.col("v"), "total").collect() == []


def test_wide_keys_are_paired_in_parts(spark, monkeypatch):
    rows = spark.createDataFrame([(1 if k < 40 else k, k, float(k % 3)) for k in range(60)], "user_id long, item_id long, r double")
    pairs = lambda: sorted(tuple(r) for r in S.overlaps(rows, "user_id", "item_id").collect())
    want = pairs()
    monkeypatch.setattr(O, "WIDE_KEY", 7)
    assert pairs() == want and len(want) == 40 * 39
    assert max(r["__part"] for r in O.paired(rows, "user_id", "item_id")[0].collect()) > 0


def test_query_sets_go_in_blocks(spark):
    rows = spark.createDataFrame([(k, [float(k), 1.0, float(k % 4)]) for k in range(30)], "vec_id long, embedding array<double>")
    whole = S.similar_vectors(rows, rows, 3)
    near = lambda block: block.select("vec_id")
    assert sorted(r[0] for r in O.by_block(rows, "vec_id", near, size=4).collect()) == list(range(30))
    assert whole.count() == 90


def test_negatives_of_users_with_few_free_items(spark):
    pairs = spark.createDataFrame([(u, i) for u in range(4) for i in range(12) if u == 3 or i < 9 - u], "user_id long, item_id long")
    got = [tuple(r) for r in I.negatives(pairs, pairs, pairs, 5).collect()]
    own = {tuple(r) for r in pairs.collect()}
    assert len(got) == len(set(got)) and not set(got) & own
    assert {u: sum(x == u for x, _ in got) for u in range(4)} == {0: 3, 1: 4, 2: 5, 3: 0}


def test_composed_and_simple_text(spark):
    rows = spark.createDataFrame([("e\u0301t\u00e9 <b>A-1</b>  x_y!",), (None,), ("",)], "s string").select(X.composed(F.col("s")), X.simple_clean(X.composed(F.col("s")))).collect()
    assert [tuple(r) for r in rows] == [("\u00e9t\u00e9 <b>A-1</b>  x_y!", "\u00e9t\u00e9 a 1 x_y"), (None, ""), ("", "")]


def test_social_noise_keeps_the_signs(spark):
    rows = spark.createDataFrame([("a", 0, 0.5), ("a", 1, -0.5), ("b", 0, 0.0), ("b", 1, 2.0)], "node string, dim int, value double")
    got = {(r.node, r.dim): r.value for r in S.noisy(rows, 0).collect()}
    assert got["a", 0] > 0.5 and got["a", 1] < -0.5 and got["b", 0] == 0 and got["b", 1] > 2
    assert abs(math.hypot(got["a", 0] - 0.5, got["a", 1] + 0.5) - 0.1) < 1e-9


def test_pairs_of_days_are_made_of_lists(spark, monkeypatch):
    monkeypatch.setattr(G, "LIST_ITEMS", 3)
    first = datetime.date(2020, 1, 1)
    rows = [(k, first + datetime.timedelta(days=k * k % 7), "xy"[k % 2] if k % 5 else None) for k in range(30)] + [(99, None, "x")]
    days = spark.createDataFrame([r[:2] for r in rows], "item_id long, day date")
    kinds = spark.createDataFrame([(r[0], r[2]) for r in rows], "item_id long, category string")
    known = rows[:-1]
    for window, categories in ((0, None), (1, None), (3, kinds)):
        found = G.same_days(days, window, categories)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        near = lambda a, b: abs((a[1] - b[1]).days) <= window and (categories is None or a[2] == b[2] is not None)  # noqa: B023, E731
        assert sorted(map(tuple, found.collect())) == [(a[0], b[0]) for a in known for b in known if a[0] < b[0] and near(a, b)]


def test_the_file_of_augmented_edges_holds_no_pairs_of_items(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(service_queries.sinks, "write_csv", lambda df, path, f=service_queries.sinks.write_csv: (sent.append(df.count()), f(df, path)))
    rows = service_queries.augmented_edges(bindings.Tables(spark, "/root/testdata/sf0.001"))
    assert 0 < sent[0] < rows.count() / 2


def test_a_users_draws_stay_in_its_row(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(I, "written", lambda df, what, f=I.written: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), f(df, what))[1])
    monkeypatch.setattr(I, "MOST_DRAWS", 8)
    pairs = spark.createDataFrame([(u, i) for u in range(6) for i in range(40) if i % 6 != u], "user_id long, item_id long")
    got = sorted(tuple(r) for r in I.negatives(pairs, pairs, pairs, 4).collect())
    numbers = range(40)
    want = []
    for u in range(6):
        found, d = [], 0
        while len(found) < 4:
            d += 1
            i = numbers[int(int(hashlib.md5(f"{u}:{d}:42".encode()).hexdigest()[:8], 16) / 4294967296 * 40)]
            found += [i] if i % 6 == u and i not in found else []
        want += [(u, i) for i in found]
    assert got == sorted(want)
    draws = [p for p in plans if "md5" in p]
    assert draws and not any("Window" in p or "Aggregate" in p or "explode" in p for p in draws)
