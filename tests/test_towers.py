"""towers whose triples lie in blocks, and scores of which only the best leave a task."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborank.operators import models as M
from arborank.operators import neighbours as N
from arborank.operators import ranking as R
from arborank.operators import scoring as S
from arborank.operators import towers as T


def test_erf():
    x = np.concatenate([np.random.default_rng(1).normal(size=5000) * 3, [0.0, 1e-9, -1e-9, 5.9999, 6.0, -7.0, 40.0, np.inf, -np.inf]])
    assert np.abs(T.erf(x) - [math.erf(v) for v in x]).max() < 1e-15
    assert np.isnan(T.erf(np.array([np.nan, 1.0]))).tolist() == [True, False]


def tables(spark, kind):
    """A reader with very many triples, one without a profile, an item without a vector and one with none at all."""
    draw = np.random.default_rng(2)
    users = {u: draw.normal(size=4) for u in range(12) if u != 5}
    items = {i: draw.normal(size=4).astype(np.float32 if kind == "float" else float) for i in range(15) if i not in (3, 4)}
    triples = sorted({(int(u) if k % 2 else 0, int(p), int(n)) for k, (u, p, n) in enumerate(draw.integers(0, (12, 15, 15), (500, 3)))})
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in items.items()] + [(4, None)], f"item_id long, v array<{kind}>")
    return triples, users, items, (spark.createDataFrame(triples, "user_id long, pos long, neg long"), spark.createDataFrame([(u, v.tolist()) for u, v in users.items()], "user_id long, v array<double>"), rows)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_triples_lie_in_blocks(spark, monkeypatch, kind):
    triples, users, items, frames = tables(spark, kind)
    known = sorted((u, p, n) for u, p, n in triples if u in users and p in items and n in items)
    monkeypatch.setattr(T, "BLOCK_TRIPLES", 60)
    found = spark.read.parquet(T.examples(*frames, 3)).collect()
    assert len(found) < len(known) / 10 and {b.batch for b in found} == {0, 1, 2}
    got, moved = [], 0
    names = [{v.astype(t).tobytes(): k for k, v in x.items()} for x, t in ((users, float), (items, np.float32 if kind == "float" else float))]
    for b in found:
        u, i = np.frombuffer(b.users).reshape(b.n_users, -1), np.frombuffer(b.items, np.float32 if kind == "float" else float).reshape(b.n_items, -1)
        at = [np.frombuffer(x, np.int32) for x in (b.u_at, b.p_at, b.n_at)]
        assert 0 < len(at[0]) <= 60
        got += [(names[0][u[x].tobytes()], names[1][i[y].tobytes()], names[1][i[z].tobytes()]) for x, y, z in zip(*at, strict=True)]
        moved += b.n_users + b.n_items
    assert sorted(got) == known and moved < len(known)  # three for each triple before


def test_blocks_train_as_rows_do(spark, monkeypatch):
    triples, users, items, frames = tables(spark, "double")
    rows = [(u, p, n) for u, p, n in triples if u in users and p in items and n in items]
    draw = np.random.default_rng(42)
    both = [T.start(4, 2, draw), T.start(4, 2, draw)]
    plain = [T.forward(both[0], users[u][None])[0] @ (T.forward(both[1], items[n][None])[0] - T.forward(both[1], items[p][None])[0]).T for u, p, n in rows]
    want = np.logaddexp(0, np.array(plain).ravel() / 0.2).mean()
    one = T.train(*frames, out=2, batches=1, epochs=2)
    assert one.losses[0] == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(T, "BLOCK_TRIPLES", 40)
    monkeypatch.setattr(T, "TOWER_ROWS", 3)
    many = T.train(*frames, out=2, batches=1, epochs=2)
    assert np.allclose(one.losses, many.losses, atol=1e-12)
    assert all(np.allclose(getattr(one, s)[k], getattr(many, s)[k], atol=1e-9) for s in ("user", "item") for k in T.NAMES)


def test_best_unseen_items_meet_in_cells(spark, monkeypatch):
    for name, size in (("FREE_PARTS", 30), ("FREE_QUERIES", 6), ("AT_ONCE", 2)):
        monkeypatch.setattr(N, name, size)
    draw = np.random.default_rng(3)
    users = spark.createDataFrame([(u, draw.integers(-2, 3, 3).astype(float).tolist()) for u in range(20)], "user_id long, v array<double>")
    items = spark.createDataFrame([(i, draw.integers(-2, 3, 3).astype(float).tolist()) for i in range(100)], "item_id long, v array<double>")  # many ties
    pairs = {(int(u), int(i)) for u, i in draw.integers(0, (40, 130), (900, 2))} | {(7, i) for i in range(100)} | {(8, i) for i in range(96)}
    seen = spark.createDataFrame([*pairs, (None, 1), (1, None)], "user_id long, item_id long")
    want = R.masked_top(M.factor_scores(users, items), seen, 5)
    got = M.factor_top(users, items, seen, 5)
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    assert got.filter("user_id = 7").count() == 0 and got.filter("user_id = 8").count() == sum((8, i) not in pairs for i in range(96, 100)) < 5
    vectors = [rows.select(F.col(c).alias("id"), "v") for rows, c in ((users, "user_id"), (items, "item_id"))]
    assert N.free_products(*vectors, seen.select(F.col("user_id").alias("a"), F.col("item_id").alias("b")), 1).count() < 1000  # of 2000 pairs
    assert M.factor_top(users.limit(0), items, seen, 5).count() == M.factor_top(users, items.limit(0), seen, 5).count() == 0


@pytest.mark.parametrize("how, last", [("mean", None), ("mean", 3), ("sum", None), ("max", None), ("last", None), ("recency", None), ("session", 4)])
def test_profiles(spark, how, last):
    draw = np.random.default_rng(4)
    v = {i: draw.normal(size=3) for i in range(9)}
    reads = [(int(u), int(i), int(ts), k) for k, (u, i, ts) in enumerate(draw.integers(0, (6, 10, 12), (60, 3)))] + [(9, 0, 1, 60)]
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()] + [(9, None)], "vec_id long, embedding array<double>")
    made = S.profiles(spark.createDataFrame(reads, "user_id long, item long, ts long, event_id long"), vectors, how, last)
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()  # no row for a number of a vector
    got = {r.user_id: np.array(r.v) for r in made.collect()}
    for u in {r[0] for r in reads}:
        own = sorted((r for r in reads if r[0] == u), key=lambda r: (r[2], r[3]), reverse=True)[: 1 if how == "last" else last]
        n = len(own)
        weights = [{"session": 0.9**age, "recency": 0.5 + 0.5 * (n - 1 - age) / (n - 1) if n > 1 else 1.0}.get(how, 1.0) for age in range(n)]
        rows = [(v[r[1]], w) for r, w in zip(own, weights, strict=True) if r[1] in v]
        if not rows:
            assert u not in got
            continue
        x, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        assert np.allclose(got[u], x.max(0) if how == "max" else w @ x if how == "sum" else w @ x / w.sum())
