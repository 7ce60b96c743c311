"""What a service calls: recommend, search, configuration, plot data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import expressions as X
from .operators import lexical as L
from .operators import ranking as R
from .operators import scoring as S
from .operators.ordering import top_per

#: How many candidates each side gives, and how much history counts.
CF_MOST, CONTENT_MOST, SEARCH_MOST, HISTORY = 200, 150, 100, 10


@dataclass
class Catalogue:
    """items: item_id, title, description, category, embedding. train: user_id, item_id, r. sims: a, b, sim of items."""

    items: DataFrame
    train: DataFrame
    sims: DataFrame


@dataclass
class Request:
    user_id: int | None = None
    history: list[int] = field(default_factory=list)
    alpha: float = 0.5
    k: int = 10
    filters: list[str] = field(default_factory=list)


def recommend(c: Catalogue, q: Request) -> DataFrame:
    """item_id, score, source, title, category, rk. A known user has CF candidates unless alpha is 0; a history has content candidates unless it is 1."""
    spark = c.items.sparkSession
    none = spark.createDataFrame([], "user_id long, item_id long, score double")
    me = F.lit(q.user_id if q.user_id is not None else -1).cast("long")
    cf = content = none
    if q.user_id is not None and q.alpha > 0:
        own = c.train.filter(F.col("user_id") == q.user_id)
        cf = R.scaled(R.masked_top(S.item_scores(own, c.sims), own, CF_MOST).drop("rk"))
    last = q.history[-HISTORY:]
    if last and q.alpha < 1:
        vectors = c.items.select("item_id", X.doubles("embedding").alias("e"))
        mean = vectors.filter(F.col("item_id").isin(last)).select(F.posexplode("e").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("x"))
        mean = mean.agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("p")).select(F.transform("p", lambda r: r["x"]).alias("p"))
        content = vectors.crossJoin(F.broadcast(mean)).select(me.alias("user_id"), "item_id", X.cosine(F.col("p"), F.col("e")).alias("score"))
    rows = R.blended(cf, content, q.alpha, CF_MOST, CONTENT_MOST)
    if q.history:
        rows = rows.filter(~F.col("item_id").isin(q.history))
    rows = rows.join(c.items.select("item_id", "title", "category"), "item_id")
    if q.filters:
        rows = rows.filter(F.col("category").isin(q.filters))
    return top_per(rows, ["user_id"], [F.desc("score"), F.col("item_id")], q.k).select("item_id", "score", "source", "title", "category", "rk")


def search(c: Catalogue, text: str, k: int = 20, filters: list[str] | None = None) -> DataFrame:
    """item_id, score, rk: BM25+ over title and description; the best 100 that match, filtered, first k."""
    docs = c.items.select(F.col("item_id").alias("doc_id"), F.concat_ws(" ", "title", "description").alias("text"))
    words = lambda x: F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")
    asked = c.items.sparkSession.createDataFrame([(text,)], "text string").select(F.lit(0).alias("query_id"), F.explode(words(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    rows = L.best_docs(L.bm25(L.postings(docs, words(F.col("text"))), asked, "plus", k=SEARCH_MOST), SEARCH_MOST)
    if filters:
        rows = rows.join(c.items.filter(F.col("category").isin(filters)).select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi")
    return top_per(rows.drop("rk"), ["query_id"], [F.desc("score"), F.col("doc_id")], k).select(F.col("doc_id").alias("item_id"), "score", "rk")


def configuration(c: Catalogue) -> dict:
    """The categories and the number of users with two rows or more."""
    return {"categories": sorted(r[0] for r in c.items.select("category").distinct().collect() if r[0] is not None), "users": c.train.groupBy("user_id").count().filter("count >= 2").count()}


def embedding_map(vectors: DataFrame) -> DataFrame:
    """EMB-20: vec_id, x, y on the first two principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("vec_id", array_to_vector(X.doubles("embedding")).alias("features"))
    found = PCA(k=2, inputCol="features", outputCol="at").fit(rows).transform(rows).select("vec_id", vector_to_array("at").alias("at"))
    return found.select("vec_id", F.get("at", F.lit(0)).alias("x"), F.get("at", F.lit(1)).alias("y"))


def word_cloud(c: Catalogue, history: list[int], most: int = 50) -> DataFrame:
    """TXT-25: term, n of the titles read."""
    words = F.explode(F.filter(F.split(F.lower("title"), r"\s+"), lambda w: F.length(w) > 2))
    return c.items.filter(F.col("item_id").isin(history)).select(words.alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(most)


def same_lists(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """RNK-16: user_id, shared: how many of two models' first k items are the same."""
    pick = lambda x: x.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("rk"))).filter(F.col("rn") <= k).select("user_id", "item_id")
    return pick(a).join(pick(b), ["user_id", "item_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("shared"))
