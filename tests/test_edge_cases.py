"""Hubs, users and items that a table lacks, settings, and the last steps of cleaning."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborank.functions import expressions as X
from arborank.operators import graph as G
from arborank.operators import interactions as I
from arborank.operators import ordering as O
from arborank.operators import ranking as R
from arborank.operators import scoring as S
from arborank.sources import files


def test_a_star_of_many_nodes_has_one_label(spark, monkeypatch):
    monkeypatch.setattr(O, "HOT_ROWS", 1000)
    edges = spark.range(1, 100_001).selectExpr("id as src", "200000 as dst").union(spark.createDataFrame([(300000, 300001)], "src long, dst long"))
    found = G.components(edges).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in found} == {1: 100_001, 300000: 2}


def test_rows_of_wide_keys_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(O, "WIDE_KEY", 7)
    a = [(k % 3 and 1, f"x{k}") for k in range(40)]
    b = [(k % 2, f"y{k}") for k in range(9)]
    one, other = spark.createDataFrame(a, "k int, x string"), spark.createDataFrame(b, "k int, y string")
    found = sorted((r.k, r.x, r.y) for r in O.met(one, other, ["k"], "x").collect())
    assert found == sorted((i, x, y) for i, x in a for j, y in b if i == j)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_spread(spark, monkeypatch, how):
    monkeypatch.setattr(O, "HOT_ROWS", 10)
    rows = [("hot" if k % 3 else f"k{k}", k) for k in range(200)] + [(None, 900)]
    df = spark.createDataFrame(rows, "key string, n long")
    lookup = spark.createDataFrame([("hot", 1.0), ("k3", 2.0)], "key string, v double")
    found = sorted((r.n, r.v) for r in O.spread_join(df, lookup, ["key"], F.xxhash64("n"), how).collect() if r.v is not None)
    assert found == [(n, {"hot": 1.0, "k3": 2.0}[k]) for k, n in rows if k in ("hot", "k3")]
    assert O.spread_join(df, lookup, ["key"], F.xxhash64("n"), how).count() == (len(rows) if how == "left" else len(found))


def candidates(spark):
    r = random.Random(1)
    rows = [(u, i, round(r.random(), 3)) for u in range(3) for i in range(12)]
    vectors = {i: np.array([r.gauss(0, 1) for _ in range(3)]) for i in range(12) if i not in (2, 5)}
    cats = {i: "ab"[i % 2] for i in range(12) if i != 7}
    return rows, vectors, cats, spark.createDataFrame(rows, "user_id long, item_id long, score double"), spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>"), spark.createDataFrame(list(cats.items()), "item_id long, category string")


def test_items_without_a_vector_stay_in_the_list(spark):
    rows, vectors, _, scores, table, _ = candidates(spark)
    found = {}
    for r in R.mmr(scores, table, 12).orderBy("user_id", "rk").collect():
        found.setdefault(r.user_id, []).append(r.item_id)
    for u in range(3):
        score = {i: s for x, i, s in rows if x == u}
        unit = {i: vectors[i] / np.linalg.norm(vectors[i]) if i in vectors else np.zeros(3) for i in score}
        chosen = [max(score, key=lambda i: (score[i], -i))]
        while len(chosen) < len(score):
            left = [i for i in score if i not in chosen]
            chosen.append(max(left, key=lambda i: (round(0.5 * score[i] - 0.5 * max(float(unit[i] @ unit[j]) for j in chosen), 9), score[i], -i)))
        assert found[u] == chosen


def test_users_without_a_history_keep_their_list(spark):
    rows, _, cats, scores, table, categories = candidates(spark)
    history = spark.createDataFrame([(0, "a", 0.75), (0, "b", 0.25), (1, "b", 1.0)], "user_id long, category string, p double")
    found = {}
    for r in R.calibrated(scores, categories, history, 6).orderBy("user_id", "rk").collect():
        found.setdefault(r.user_id, []).append(r.item_id)
    goals = {0: {"a": 0.75, "b": 0.25}, 1: {"b": 1.0}, 2: {}}
    assert found.keys() == goals.keys()
    for u, goal in goals.items():
        score = {i: s for x, i, s in rows if x == u}
        chosen = []
        for n in range(1, 7):

            def value(i, chosen=chosen, n=n, score=score, goal=goal):
                kinds = [cats.get(j, "") for j in [*chosen, i]]
                p = {c: kinds.count(c) / (n + 1e-9) for c in {*kinds, *goal}}
                return round(0.5 * score[i] - 0.5 * sum(v * math.log((v + 1e-9) / (goal.get(c, 0.0) + 1e-9)) for c, v in p.items()), 9)

            chosen.append(max((i for i in score if i not in chosen), key=lambda i: (value(i), score[i], -i)))
        assert found[u] == chosen
    chain = R.reranked(scores, table, categories, history, 5, 8).groupBy("user_id").count().collect()
    assert {r.user_id: r["count"] for r in chain} == {0: 5, 1: 5, 2: 5}


def test_numbers_and_signs_go_as_stated(spark):
    cases = {"12.x": "x", "1.5a": "5a", "12. b": "b", "3 4.5 6": "", "x1 2y": "x1 2y", "đ5 5đ": "đ5 5đ", "“a” ‘b’ …c–d—e": "“a” ‘b’ c d e", "٣٤ a": "a"}
    rows = spark.createDataFrame([(x,) for x in cases], "s string")
    got = rows.select("s", F.trim(F.regexp_replace(F.regexp_replace("s", X.UNICODE + X.NUMBERS, " "), "[…–—.]|\\s+", " ")).alias("t"), X.cleaned(F.col("s"), numbers=False).alias("c")).collect()
    assert {r.s: " ".join(r.t.split()) for r in got} == cases
    assert next(r.c for r in got if r.s.startswith("“")).split() == ["“a”", "‘b’", "c", "d", "e"]


def test_yaml_settings(spark, tmp_path):
    text = """# settings
model:
  name: "light gcn"  # quoted
  layers: 3
  rate: 1e-3
  flags: [true, no, 2]
  sizes:
    - 64
    - 32.5
  deep:
    on: True
    off: null
spark:
  spark.sql.test.setting: 7
last: text with: colon
"""
    (tmp_path / "s.yaml").write_text(text)
    found = files.settings(spark, str(tmp_path / "s.yaml"))
    assert found == {"model": {"name": "light gcn", "layers": 3, "rate": 0.001, "flags": [True, "no", 2], "sizes": [64, 32.5], "deep": {"on": True, "off": None}}, "spark": {"spark.sql.test.setting": 7}, "last": "text with: colon"}
    assert spark.conf.get("spark.sql.test.setting") == "7"
    with pytest.raises(ValueError):
        files.plain_yaml("a: &anchor 1")
    assert files.plain_yaml("") == {} and files.plain_yaml("a:\nb: 1\n") == {"a": None, "b": 1}


def test_first_found(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "c").mkdir()
    assert files.first_found(spark, [str(tmp_path / x) for x in "abc"]) == str(tmp_path / "b")
    with pytest.raises(FileNotFoundError):
        files.first_found(spark, [str(tmp_path / "x")])


def test_auc_of_all_pairs(spark):
    r = random.Random(5)
    rows = [(u, i, r.choice([0.1, 0.2, 0.2, 0.7, r.random()])) for u in range(6) for i in range(9)]
    pos = {(u, i) for u, i, s in rows if r.random() < 0.3 + 0.4 * s}
    df, good = spark.createDataFrame(rows, "user_id long, item_id long, score double"), spark.createDataFrame(sorted(pos), "user_id long, item_id long")
    p, n = [s for u, i, s in rows if (u, i) in pos], [s for u, i, s in rows if (u, i) not in pos]
    want = sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))
    row = R.auc_all(df, good).first()
    assert abs(row.auc - want) < 1e-6 and (row.positives, row.negatives) == (len(p), len(n))
    assert R.auc_all(df, good.limit(0)).first().auc is None


def test_fifths(spark):
    pairs = spark.createDataFrame([(u, i) for u in range(1, 9) for i in range(u)], "user_id long, item_id long")
    rows = I.split_fifths(pairs, 2).collect()
    for u in range(1, 9):
        own = [r.split for r in rows if r.user_id == u]
        assert len(own) == (0 if u < 2 else u) and own.count("train") == (0 if u < 2 else int(u * 0.8))


def test_loss_by_batches(spark):
    r = np.random.default_rng(6)
    a, b = r.normal(size=(10, 3)), r.normal(size=(10, 3))
    df = lambda m: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id long, v array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    losses = []
    for part in (range(0, 10, 2), range(1, 10, 2)):
        s = unit(a[list(part)]) @ unit(b[list(part)]).T / 0.2
        losses += list(np.log(np.exp(s).sum(1)) - np.diag(s))
    row = S.info_nce(df(a), df(b), batch=F.col("id") % 2).first()
    assert abs(row.info_nce - np.mean(losses)) < 1e-5 and row.n == 10


def test_maps_of_users(spark):
    r = np.random.default_rng(8)
    vectors = {i: r.normal(size=5) for i in range(9)}
    profiles = {1: r.normal(size=5), 2: r.normal(size=5), 3: r.normal(size=5)}
    history, shown = [(1, 0), (1, 1), (1, 2), (2, 3), (1, 99)], [(1, 4), (1, 5)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    frame = lambda rows: spark.createDataFrame(rows, "user_id long, item_id long")
    rows = R.mapped_users(spark.createDataFrame([(u, v.tolist()) for u, v in profiles.items()], "user_id long, v array<double>"), frame(history), frame(shown), table).collect()
    assert {r.user_id for r in rows} == {1, 2}  # the third has one point
    m = np.array([profiles[1], *[vectors[i] for i in (0, 1, 2, 4, 5)]])
    c = m - m.mean(0)
    values, axes = np.linalg.eigh(c.T @ c)
    best = axes[:, np.argsort(-values)[:2]].T
    best = best * np.sign(best[np.arange(2), np.abs(best).argmax(1)])[:, None]
    want = {None if k == 0 else (0, 1, 2, 4, 5)[k - 1]: p for k, p in enumerate(c @ best.T)}
    own = {r.item_id: (r.x, r.y) for r in rows if r.user_id == 1}
    assert own.keys() == want.keys() and all(np.allclose(own[i], want[i]) for i in want)
    assert all(r.y == 0 for r in rows if r.user_id == 2) and {r.kind for r in rows if r.user_id == 1} == {"User", "History", "Recommendation"}


def test_cached_pages_that_share_an_address(spark, tmp_path):
    from __spark_entry__ import queries

    rows = [(0, "a://x", "<p>one</p>"), (1, "a://x", "<p>other</p>"), (2, "a://x", "<b>longer one</b>"), (4, None, "<i>"), (6, "a://y", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: r.size for r in queries()["cache_lookup"](spark, str(tmp_path)).collect()}
    assert found == {p: len(h) if h and p % 2 == 0 else None for p, _, h in rows}


def test_components_of_days_make_no_pairs(spark, monkeypatch):
    from arborank.operators import graph as G

    days = [(i, d) for i, d in enumerate(["2001-01-01"] * 4 + ["2001-01-02"] + ["2001-01-03"] * 2)]
    rows = spark.createDataFrame(days, "item_id long, day string").selectExpr("item_id", "cast(day as date) as day")
    assert G.same_day_stars(rows).count() == 4  # the pairs are 7
    label = lambda edges: {r.node: r.label for r in G.components(edges).collect()}
    assert label(G.same_day_stars(rows)) == label(G.same_days(rows)) == {0: 0, 1: 0, 2: 0, 3: 0, 5: 5, 6: 5}
