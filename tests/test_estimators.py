import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from arborank.operators.estimators import FactorRanker, FactorRankerModel, last_round


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(u, 4 * k + u % 4) for u in range(24) for k in range(5) if (u + k) % 3], "reader long, story long").cache()


def vectors(df, key):
    return {r[key]: np.array(r.v) for r in df.collect()}


def test_fit_save_load(spark, pairs, tmp_path):
    ranker = FactorRanker(maxIter=8, rank=6, stepSize=0.5, userCol="reader", itemCol="story", draws=8)
    model = ranker.fit(pairs)
    scored = model.transform(pairs.select("reader").distinct().crossJoin(pairs.select("story").distinct()).withColumn("__x", F.lit(1)))
    assert scored.columns == ["reader", "story", "__x", "score"]
    own = scored.groupBy((F.col("story") % 4 == F.col("reader") % 4).alias("own")).agg(F.avg("score").alias("s")).collect()
    s = {r.own: r.s for r in own}
    assert s[True] > s[False] + 0.05
    unknown = model.transform(spark.createDataFrame([(999, 1), (1, 999)], "reader long, story long")).collect()
    assert [r.score for r in unknown] == [0.0, 0.0]
    model.write().overwrite().save(str(tmp_path / "model"))
    again = FactorRankerModel.load(str(tmp_path / "model"))
    assert again.rounds == 8 and again.getOrDefault("rank") == 6 and again.getOrDefault("userCol") == "reader"
    a, b = vectors(model.users, "user_id"), vectors(again.users, "user_id")
    assert a.keys() == b.keys() and all((a[k] == b[k]).all() for k in a)
    assert sorted(map(tuple, again.transform(pairs).collect())) == sorted(map(tuple, model.transform(pairs).collect()))
    ranker.save(str(tmp_path / "ranker"))
    assert FactorRanker.load(str(tmp_path / "ranker")).getOrDefault("stepSize") == 0.5


def test_resume_gives_the_same_factors(spark, pairs, tmp_path):
    path = str(tmp_path / "rounds")
    settings = {"rank": 4, "userCol": "reader", "itemCol": "story", "draws": 5}
    whole = FactorRanker(maxIter=4, **settings).fit(pairs)
    FactorRanker(maxIter=2, checkpointPath=path, **settings).fit(pairs)
    assert last_round(spark, path) == 2
    (tmp_path / "rounds" / "round-2" / "items" / "_SUCCESS").unlink()  # cut off while the second round was written
    assert last_round(spark, path) == 1
    model = FactorRanker(maxIter=4, checkpointPath=path, **settings).fit(pairs)
    assert last_round(spark, path) == 4
    for side, key in (("users", "user_id"), ("items", "item_id")):
        a, b = vectors(getattr(whole, side), key), vectors(getattr(model, side), key)
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    same = FactorRanker(maxIter=4, checkpointPath=path, **settings).fit(pairs)
    assert all((vectors(same.users, "user_id")[k] == v).all() for k, v in vectors(model.users, "user_id").items())


def test_in_a_pipeline_and_empty(spark, pairs):
    pipeline = Pipeline(stages=[SQLTransformer(statement="select reader as user_id, story as item_id from __THIS__ where reader is not null"), FactorRanker(maxIter=1, rank=3, draws=3)])
    assert pipeline.fit(pairs).transform(pairs).filter("score <> 0").count() > 0
    assert FactorRanker(maxIter=1, userCol="reader", itemCol="story").fit(pairs.limit(0)).users.count() == 0
