"""CF-22: the pairwise ranking model as an Estimator and a Model of pyspark.ml, with parameters, persistence and resumption.

fit() writes the factors of every round into `checkpointPath`, if one is set, and starts from the last round that is whole there; a fit that was cut off, or one with more
rounds, goes on instead of beginning again.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasMaxIter, HasSeed, HasStepSize
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import dot, hash_unit
from ..sources.files import first_found
from .interactions import negatives
from .models import bpr


class FactorParams(HasMaxIter, HasSeed, HasStepSize):
    """maxIter rounds of stepSize; rank numbers a vector; decay of the weights; userCol, itemCol and scoreCol; checkpointPath."""

    rank = Param(Params._dummy(), "rank", "numbers of a vector", TypeConverters.toInt)
    decay = Param(Params._dummy(), "decay", "weight decay", TypeConverters.toFloat)
    draws = Param(Params._dummy(), "draws", "negatives of a user", TypeConverters.toInt)
    userCol = Param(Params._dummy(), "userCol", "column of users", TypeConverters.toString)
    itemCol = Param(Params._dummy(), "itemCol", "column of items", TypeConverters.toString)
    scoreCol = Param(Params._dummy(), "scoreCol", "column of scores", TypeConverters.toString)
    checkpointPath = Param(Params._dummy(), "checkpointPath", "folder of the rounds' factors; none if empty", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(maxIter=10, seed=42, stepSize=0.05, rank=16, decay=1e-4, draws=20, userCol="user_id", itemCol="item_id", scoreCol="score", checkpointPath="")


class FactorRanker(Estimator, FactorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns vectors of users and items from pairs (userCol, itemCol), which count once each."""

    @keyword_only
    def __init__(self, *, maxIter: int = 10, seed: int = 42, stepSize: float = 0.05, rank: int = 16, decay: float = 1e-4, draws: int = 20, userCol: str = "user_id", itemCol: str = "item_id", scoreCol: str = "score", checkpointPath: str = ""):
        FactorParams.__init__(self)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> FactorRankerModel:
        get = self.getOrDefault
        pairs = dataset.select(F.col(get("userCol")).cast("long").alias("user_id"), F.col(get("itemCol")).cast("long").alias("item_id")).filter("user_id is not null and item_id is not null").distinct()
        drawn = negatives(pairs, pairs, pairs, get("draws"), get("seed")).withColumnRenamed("item_id", "neg")
        # a user's negatives are dealt to its positives in turn
        numbered = drawn.groupBy("user_id").agg(F.sort_array(F.collect_list("neg")).alias("negs"))  # `draws` a user
        place = F.pmod(F.xxhash64("item_id", F.lit(get("seed"))), F.size("negs")).cast("int")
        triples = pairs.join(numbered, "user_id").select("user_id", F.col("item_id").alias("pos"), F.get("negs", place).alias("neg"))
        path, done = get("checkpointPath"), 0
        users, items = (start(pairs, key, get("rank"), get("seed")) for key in ("user_id", "item_id"))
        if path:
            done = min(last_round(dataset.sparkSession, path), get("maxIter"))
            if done:
                users, items = round_factors(dataset.sparkSession, path, done)
        while done < get("maxIter"):
            users, items = bpr(triples, users, items, 1, get("stepSize"), get("decay"))
            done += 1
            if path:
                for side, rows in (("users", users), ("items", items)):
                    rows.write.mode("overwrite").parquet(f"{path}/round-{done}/{side}")
        return self._copyValues(FactorRankerModel(users, items, done))


class FactorRankerModel(Model, FactorParams, MLReadable, MLWritable):
    """users (user_id, v) and items (item_id, v). transform() adds scoreCol to pairs: the product of both vectors; 0 for those it doesn't know."""

    def __init__(self, users: DataFrame | None = None, items: DataFrame | None = None, rounds: int = 0):
        FactorParams.__init__(self)
        self.users, self.items, self.rounds = users, items, rounds

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        u, i = self.users.select(F.col("user_id").alias(get("userCol")), F.col("v").alias("__u")), self.items.select(F.col("item_id").alias(get("itemCol")), F.col("v").alias("__i"))
        rows = dataset.join(u, get("userCol"), "left").join(i, get("itemCol"), "left")
        return rows.withColumn(get("scoreCol"), F.coalesce(dot(F.col("__u"), F.col("__i")), F.lit(0.0))).select(*dataset.columns, get("scoreCol"))

    def write(self) -> MLWriter:
        return FactorWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return FactorReader()


class FactorWriter(MLWriter):
    def __init__(self, model: FactorRankerModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"rounds": self.model.rounds})
        self.model.users.write.parquet(f"{path}/users")
        self.model.items.write.parquet(f"{path}/items")


class FactorReader(MLReader):
    def load(self, path: str) -> FactorRankerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rounds = json.loads(metadata["metadataStr"]).get("rounds", 0) if isinstance(metadata.get("metadataStr"), str) else metadata.get("rounds", 0)
        model = FactorRankerModel(self.sparkSession.read.parquet(f"{path}/users"), self.sparkSession.read.parquet(f"{path}/items"), rounds)
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def start(pairs: DataFrame, key: str, rank: int, seed: int) -> DataFrame:
    """Hashed vectors at the level of 1 / rank."""
    numbers = F.transform(F.sequence(F.lit(1), F.lit(rank)), lambda d: (hash_unit(F.lit(key), F.col(key), d, F.lit(seed)) - 0.5) / rank**0.5)
    return pairs.select(key).distinct().select(key, numbers.alias("v"))


def last_round(spark: SparkSession, path: str) -> int:
    """The last round whose two tables are whole; 0 if none is."""
    done = 0
    while True:
        try:
            for side in ("users", "items"):
                first_found(spark, [f"{path}/round-{done + 1}/{side}/_SUCCESS"])
        except FileNotFoundError:
            return done
        done += 1


def round_factors(spark: SparkSession, path: str, done: int) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/round-{done}/users"), spark.read.parquet(f"{path}/round-{done}/items")
