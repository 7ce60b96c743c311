"""Content scores and what is made of them come out of the cells that multiply them: no pair of user and item is shuffled."""

import numpy as np
import pytest

import __spark_entry__ as entry
from arborank.operators import neighbours as N
from arborank.plans import model_queries as Q
from arborank.sources.bindings import Tables

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["score_minmax", "freshness", "session_boost", "hybrid_dense"])
def test_nothing_is_moved_after_the_cells(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    after = plan.split("MapInArrow")[0]
    assert "Exchange" not in after and "Window" not in after and "Join" not in after


def test_what_was_read_goes_to_the_cells(spark):
    assert "LeftAnti" not in entry.queries()["two_towers_zero_shot"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_popular_scores_are_the_first_of_all(spark):
    t = Tables(spark, DATA)
    rows = Q.popular_scores(t, 3).collect()
    users = {r.user_id for r in Q.reading_history(t, "embeddings").filter("user_id % 20 = 0").collect()}
    counts = sorted(((r.item_id, r.score) for r in Q.popular_items(t).collect()), key=lambda r: (-r[1], r[0]))[:3]
    assert sorted((r.user_id, r.item_id, r.score) for r in rows) == sorted((u, *c) for u in users for c in counts)


def test_the_chain_gets_a_users_first_alone(spark):
    assert Q.fresh_scores(Tables(spark, DATA), 0.2, True, k=5).groupBy("user_id").count().agg({"count": "max"}).first()[0] < 20  # 5 and near ones, of each part


def test_scored_and_ends_against_numpy(spark, monkeypatch):
    for name, value in (("PART_ROWS", 20), ("QUERY_ROWS", 5), ("BLOCK_ROWS", 8), ("AT_ONCE", 3)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(12, 4)), rng.normal(size=(70, 5))
    a[3, :3], b[9, :3] = 0, 0
    table = lambda m: spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "id long, v array<double>").repartition(3)

    def score(cosines, vectors, own, theirs):
        x = cosines + own * theirs[:, 0]
        return [np.where(theirs[:, 1] > 1, np.nan, x), x * 2]

    cosines = N.cosine_of(a[:, :3], b[:, :3])
    value = cosines + a[:, 3:] * b[:, 3]
    want = {(i, j): round(value[i, j], 9) for i in range(12) for j in range(70) if b[j, 4] <= 1}
    found = N.scored(table(a), table(b), 3, score, ["x", "y"]).collect()
    assert {(r.a, r.b): round(r.x, 9) for r in found} == want and all(r.y == 2 * r.x for r in found)
    first = {(r.a, r.b) for r in N.scored(table(a), table(b), 3, score, ["x", "y"], 4).collect()}
    assert all({(i, j) for _, j in sorted((-x, j) for (u, j), x in want.items() if u == i)[:4]} <= first for i in range(12)) and len(first) < len(want)
    near = {r.a: (round(r.lo, 9), round(r.hi, 9)) for r in N.ends(table(a[:, :3]), table(b[:, :3]), False).collect()}
    assert near == {i: (round(cosines[i].min(), 9), round(cosines[i].max(), 9)) for i in range(12)}
