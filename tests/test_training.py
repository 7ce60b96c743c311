import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborank.operators import models as M
from arborank.operators import towers as T
from arborank.operators.ordering import quantiles


def test_slopes_of_the_towers():
    """Gradients against differences of the loss."""
    draw = np.random.default_rng(1)
    user, item = T.start(5, 4, draw), T.start(5, 4, draw)
    user["gain"], item["shift"] = draw.normal(size=5), draw.normal(size=5)
    u, p, n = (draw.normal(size=(7, 5)) for _ in range(3))
    _, du, di = T.loss_and_slopes(user, item, u, p, n, 0.3)
    for tower, grads in ((user, du), (item, di)):
        for name in T.NAMES:
            for at in [tuple(draw.integers(0, k) for k in tower[name].shape) for _ in range(3)]:
                kept = tower[name][at]
                sides = []
                for move in (1e-5, -1e-5):
                    tower[name][at] = kept + move
                    sides.append(T.loss_and_slopes(user, item, u, p, n, 0.3)[0])
                tower[name][at] = kept
                assert abs((sides[0] - sides[1]) / 2e-5 - grads[name][at]) < 1e-5 * max(1, abs(grads[name][at]))


def test_towers_learn(spark):
    """Readers like items of their own kind, which neither vector shows in the same place."""
    draw = np.random.default_rng(2)
    turn = draw.normal(size=(6, 6))
    kinds = draw.normal(size=(4, 6))
    items = [(k, (kinds[k % 4] + 0.2 * draw.normal(size=6)).tolist()) for k in range(40)]
    profiles = [(k, ((kinds[k % 4] + 0.2 * draw.normal(size=6)) @ turn).tolist()) for k in range(60)]
    triples = [(u, int(draw.integers(0, 10)) * 4 + u % 4, int(draw.integers(0, 10)) * 4 + (u + 1 + int(draw.integers(0, 3))) % 4) for u in range(60) for _ in range(12)]
    frames = spark.createDataFrame(triples, "user_id long, pos long, neg long"), spark.createDataFrame(profiles, "user_id long, v array<double>"), spark.createDataFrame(items, "item_id long, v array<double>")
    found = T.train(*frames, batches=3, epochs=6, rate=0.02)
    assert len(found.losses) == 6 and found.losses[-1] < 0.5 * found.losses[0]
    users = {r.user_id: np.array(r.v) for r in found.users(frames[1]).collect()}
    made = {r.item_id: np.array(r.v) for r in found.items(frames[2]).collect()}
    best = {u: max(made, key=lambda i: float(v @ made[i])) for u, v in users.items()}
    assert sum(best[u] % 4 == u % 4 for u in best) >= 0.9 * len(best)
    none = T.train(frames[0].limit(0), frames[1], frames[2])
    assert none.losses == [] and none.users(frames[1]).count() == 60


def test_nmf(spark):
    draw = np.random.default_rng(3)
    r = np.round(draw.gamma(1, 2, (14, 3)) @ draw.gamma(1, 2, (3, 11))) * (draw.uniform(size=(14, 11)) < 0.8)
    df = spark.createDataFrame([(u, i, float(r[u, i])) for u in range(14) for i in range(11) if r[u, i]], "user_id long, item_id long, r double")
    users, items, errors = M.nmf(df, 3, 25)
    assert all(b <= a * (1 + 1e-9) for a, b in zip(errors, errors[1:], strict=False))
    w, h = (np.array([row.v for row in x.orderBy(key).collect()]) for x, key in ((users, "user_id"), (items, "item_id")))
    assert (w >= 0).all() and (h >= 0).all() and abs(((r - w @ h.T) ** 2).sum() - errors[-1]) < 1e-6 * (r**2).sum()
    a, b = draw.uniform(0.5, 1.5, (14, 3)), draw.uniform(0.5, 1.5, (11, 3))
    for _ in range(400):
        a *= (r @ b) / np.maximum(a @ (b.T @ b), 1e-12)
        b *= (r.T @ a) / np.maximum(b @ (a.T @ a), 1e-12)
    plain = ((r - a @ b.T) ** 2).sum()
    assert errors[-1] <= plain + 0.02 * (r**2).sum()
    assert M.nmf(df.limit(0), 3, 2)[2] == []


@pytest.mark.parametrize("grouped", [False, True])
def test_quantiles(spark, monkeypatch, grouped):
    from arborank.operators import ordering

    monkeypatch.setattr(ordering, "HOT_ROWS", 5)
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), None if r.random() < 0.1 else float(r.choice([1, 2, 2, 2, 7, r.randrange(50), r.random()]))) for _ in range(400)] + [("one", 3.0), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.1, 0.5, 0.99, 1.0]
    by = ["g"] if grouped else []
    found = {(x.g if grouped else None): [x[f"q{k}"] for k in range(5)] for x in quantiles(df, "v", shares, by).collect()}
    groups = {g for g, v in rows if v is not None} if grouped else {None}
    assert found.keys() == groups
    for g, values in found.items():
        own = [v for x, v in rows if v is not None and (not grouped or x == g)]
        assert np.allclose(values, np.quantile(own, shares), atol=1e-12)
    assert quantiles(df.filter("v is null"), "v", [0.5]).collect() == []
    assert df.agg(F.percentile("v", 0.99)).first()[0] == pytest.approx(quantiles(df, "v", [0.99]).first().q0, abs=1e-12)
    assert math.isfinite(found[next(iter(found))][0])
