"""Collaborative and vector scorers over long tables (user_id, item_id, r) and vector columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.expressions import cosine, dot, doubles, hash_unit, unit
from ..sources.storage import written
from .neighbours import exact
from .ordering import paired, top_per
from .products import nearest_by_products


def overlaps(ratings: DataFrame, by: str, of: str) -> DataFrame:
    """a, b (a <> b), shared, dot: over the common values of `by` for pairs of `of`, by an equal self-join."""
    one, other, keys = paired(ratings.select(by, of, "r"), by, of)
    a = one.select(*keys, F.col(of).alias("a"), F.col("r").alias("ra"))
    b = other.select(*keys, F.col(of).alias("b"), F.col("r").alias("rb"))
    pairs = a.join(b, keys).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.sum(F.col("ra") * F.col("rb")).alias("dot"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared", "dot"))


def similarity(ratings: DataFrame, kind: str = "cosine", of: str = "item_id", by: str = "user_id", k: int | None = None) -> DataFrame:
    """CF-2 to CF-4: a, b, sim (and rk with k). kind: "cosine", "jaccard", or "centred" (ratings less their global mean)."""
    if kind == "centred":
        mean = ratings.agg(F.avg("r")).first()[0] or 0.0
        ratings = ratings.withColumn("r", F.col("r") - F.lit(mean))
    size = ratings.groupBy(of).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("len"))
    if k is not None and isinstance(ratings.schema[of].dataType, IntegralType):
        found = nearest_by_products(ratings, size.select(of, F.col("n" if kind == "jaccard" else "len").alias("__s")), of, by, k, kind == "jaccard")
        return top_per(found.withColumn("sim", F.round("sim", 6)), ["a"], [F.desc("sim"), F.col("b")], k)
    pairs = overlaps(ratings, by, of)
    a = size.select(F.col(of).alias("a"), F.col("n").alias("na"), F.col("len").alias("la"))
    b = size.select(F.col(of).alias("b"), F.col("n").alias("nb"), F.col("len").alias("lb"))
    value = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")) if kind == "jaccard" else F.when(F.col("la") * F.col("lb") > 0, F.col("dot") / (F.col("la") * F.col("lb"))).otherwise(0.0)
    sims = pairs.join(a, "a").join(b, "b").select("a", "b", F.round(value, 6).alias("sim"))
    return sims if k is None else top_per(sims, ["a"], [F.desc("sim"), F.col("b")], k)


def item_scores(ratings: DataFrame, sims: DataFrame) -> DataFrame:
    """CF-6: user_id, item_id, score: over what the user has, similarity times rating."""
    return ratings.join(sims.select(F.col("b").alias("item_id"), F.col("a").alias("other"), "sim"), "item_id").groupBy("user_id", F.col("other").alias("item_id")).agg(F.sum(F.col("sim") * F.col("r")).alias("score"))


def user_scores(ratings: DataFrame, sims: DataFrame) -> DataFrame:
    """CF-5: user_id, item_id, score: over similar users, similarity times their rating."""
    return sims.select(F.col("a").alias("target"), F.col("b").alias("user_id"), "sim").join(ratings, "user_id").groupBy(F.col("target").alias("user_id"), "item_id").agg(F.sum(F.col("sim") * F.col("r")).alias("score"))


def slope_one(ratings: DataFrame, users: DataFrame) -> DataFrame:
    """CF-7: user_id, item_id, score for the users asked for: mean of rating plus deviation, weighted by the co-raters."""
    own = ratings.join(users.select("user_id"), "user_id", "left_semi").select("user_id", F.col("item_id").alias("b"), "r")
    one, other, keys = paired(ratings.select("user_id", "item_id", "r"), "user_id", "item_id")
    a = one.select(*keys, F.col("item_id").alias("a"), F.col("r").alias("ra"))
    b = other.select(*keys, F.col("item_id").alias("b"), F.col("r").alias("rb")).join(own.select("b").distinct(), "b", "left_semi")  # others are never asked for
    dev = a.join(b, keys).filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.avg(F.col("ra") - F.col("rb")).alias("dev"))
    return own.join(dev, "b").groupBy("user_id", F.col("a").alias("item_id")).agg((F.sum((F.col("r") + F.col("dev")) * F.col("c")) / F.sum("c")).alias("score"))


def wide(rows: DataFrame, size: int) -> DataFrame:
    """node, v from node, dim, value: one array of `size` numbers a node, 0 where a dimension is missing."""
    return rows.groupBy("node").agg(F.array(*[F.sum(F.when(F.col("dim") == d, F.col("value")).otherwise(0.0)) for d in range(size)]).alias("v"))


def summed(rows: DataFrame, size: int, weight: Column | None = None) -> DataFrame:
    """node, v: the sums of the arrays of each node, weighted if asked, element by element in one aggregate."""
    part = lambda d: F.get("v", F.lit(d)) if weight is None else weight * F.get("v", F.lit(d))
    return rows.groupBy("node").agg(F.array(*[F.sum(part(d)) for d in range(size)]).alias("v"))


def propagate(edges: DataFrame, vectors: DataFrame, layers: int, combine: str = "mean") -> DataFrame:
    """CF-10, CF-13: node, dim, value: `layers` rounds of edges times vectors, averaged (or summed) with the start.

    edges: src, dst, w (normalised); vectors: node, dim, value. A round moves one array an edge; each layer is written.
    """
    size = (vectors.agg(F.max("dim")).first()[0] or 0) + 1
    every = now = written(wide(vectors, size), "layer")
    for _ in range(layers):
        along = edges.join(now.select(F.col("node").alias("src"), "v"), "src").select(F.col("dst").alias("node"), "w", "v")
        now = written(summed(along, size, F.col("w")), "layer")
        every = every.unionByName(now)
    rows = summed(every, size).select("node", F.posexplode("v").alias("dim", "value"))
    return rows if combine == "sum" else rows.withColumn("value", F.col("value") / (layers + 1))


def bpr_loss(triples: DataFrame, scores: DataFrame) -> DataFrame:
    """CF-20: mean of -ln(sigmoid(s(pos) - s(neg))). triples: user_id, pos, neg; scores: user_id, item_id, score."""
    p = scores.select("user_id", F.col("item_id").alias("pos"), F.col("score").alias("sp"))
    n = scores.select("user_id", F.col("item_id").alias("neg"), F.col("score").alias("sn"))
    rows = triples.join(p, ["user_id", "pos"], "left").join(n, ["user_id", "neg"], "left").na.fill(0.0, ["sp", "sn"])
    return rows.agg(F.round(F.avg(F.log1p(F.exp(F.col("sn") - F.col("sp")))), 6).alias("bpr_loss"), F.count(F.lit(1)).alias("n"))


def naive_bayes(post: DataFrame, classes: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """CF-24: class, term, logp of a multinomial model. classes: doc_id, class."""
    counts = post.join(classes, "doc_id").groupBy("class", "term").agg(F.sum("tf").alias("n"))
    vocabulary = counts.select("term").distinct().count()
    total = counts.groupBy("class").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), "class").select("class", "term", F.round(F.log((F.col("n") + smoothing) / (F.col("total") + smoothing * vocabulary)), 6).alias("logp"))


def similar_vectors(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """EMB-8: a, b, sim, rk: the k nearest others of each query row by cosine. A stated query set against all rows; neighbours.all_nearest() takes all rows."""
    return exact(vectors, queries, k)


def pair_cosines(pairs: DataFrame, clicked: DataFrame, vectors: DataFrame) -> DataFrame:
    """RNK-6: user_id, item_id, sim of given pairs: by cosine of the item with what the user clicked (user_id, clicked). No other pair is scored.

    The clicked item itself has none.
    """
    v = vectors.select("vec_id", doubles("embedding").alias("e"))
    own = clicked.join(v.select(F.col("vec_id").alias("clicked"), F.col("e").alias("c")), "clicked")
    rows = pairs.join(own, "user_id").filter("item_id <> clicked").join(v.select(F.col("vec_id").alias("item_id"), "e"), "item_id")
    return rows.select("user_id", "item_id", F.round(cosine(F.col("c"), F.col("e")), 6).alias("sim"))


def profiles(history: DataFrame, vectors: DataFrame, how: str = "mean", last: int | None = None) -> DataFrame:
    """EMB-6, EMB-7, EMB-19: user_id, v over the vectors of what the user has read, which are one row each until a user has their sums.

    how: "mean", "sum", "max", "last", "recency" (weights from 0.5 to 1 in order) or "session" (0.9 to the power of the age).
    history: user_id, item, ts, event_id.
    """
    rows = history
    if last is not None or how in ("last", "recency", "session"):  # only these need the order
        newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
        rows = rows.withColumn("age", F.row_number().over(newest) - 1)
    if last is not None or how == "last":
        rows = rows.filter(F.col("age") < (1 if how == "last" else last))
    if how == "recency":
        n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
        rows = rows.withColumn("weight", F.when(n > 1, 0.5 + 0.5 * (n - 1 - F.col("age")) / (n - 1)).otherwise(1.0))
    else:
        rows = rows.withColumn("weight", F.pow(F.lit(0.9), F.col("age").cast("double")) if how == "session" else F.lit(1.0))
    known = vectors.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("item"), F.col("embedding").alias("e"))
    size = known.agg(F.max(F.size("e"))).first()[0] or 1
    each = rows.select("user_id", "item", "weight").join(known, "item").groupBy("user_id")
    at = lambda d: F.get("e", F.lit(d)).cast("double")
    if how == "max":
        return each.agg(F.array(*[F.max(at(d)) for d in range(size)]).alias("v"))
    sums = each.agg(F.array(*[F.sum(at(d) * F.col("weight")) for d in range(size)]).alias("v"), F.sum("weight").alias("w"))
    return sums.select("user_id", "v" if how == "sum" else F.transform("v", lambda x: x / F.col("w")).alias("v"))


def profile(history: DataFrame, vectors: DataFrame, how: str = "mean", last: int | None = None) -> DataFrame:
    """profiles() as user_id, dim, value."""
    return profiles(history, vectors, how, last).select("user_id", F.posexplode("v").alias("dim", "value"))


def quantize(vectors: DataFrame, codebooks: int = 3, k: int = 32, seed: int = 42) -> DataFrame:
    """EMB-17: vec_id and codes, by k-means on what the codebooks before leave over."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("vec_id", doubles("embedding").alias("rest"), F.array().cast("array<int>").alias("codes"))
    for c in range(codebooks):
        rows = rows.withColumn("features", array_to_vector("rest"))
        model = KMeans(k=k, seed=seed + c, maxIter=10, featuresCol="features", predictionCol="code").fit(rows)
        centres = [[float(x) for x in v] for v in model.clusterCenters()]
        table = F.array(*[F.array(*[F.lit(x) for x in v]) for v in centres])
        rows = model.transform(rows).withColumn("rest", F.zip_with(vector_to_array("features"), F.get(table, F.col("code")), lambda x, y: x - y)).withColumn("codes", F.concat("codes", F.array("code"))).select("vec_id", "rest", "codes")
        rows = written(rows, "codes")
    return rows.select("vec_id", "codes", F.round(F.aggregate("rest", F.lit(0.0), lambda s, x: s + x * x), 6).alias("error"))


def similar_words(vectors: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """EMB-10: a, b, sim, rk: the k words nearest to each of `words` (word) by cosine. vectors: word, embedding."""
    rows = vectors.select(F.col("word").alias("vec_id"), "embedding")
    return similar_vectors(rows, rows.join(words.select(F.col("word").alias("vec_id")), "vec_id", "left_semi"), k)


def semantic_sum(codes: DataFrame, books: DataFrame) -> DataFrame:
    """EMB-18: vec_id, dim, value: the sum of the vectors that an item's codes name. codes: vec_id, codes; books: book, code, embedding."""
    each = codes.select("vec_id", F.posexplode("codes").alias("book", "code")).join(books, ["book", "code"])
    rows = each.select("vec_id", F.posexplode(doubles("embedding")).alias("dim", "x"))
    return rows.groupBy("vec_id", "dim").agg(F.sum("x").alias("value"))


def noisy_arrays(vectors: DataFrame, layer: int, size: float = 0.1, seed: int = 42) -> DataFrame:
    """noisy() on node, v, one array a node."""
    noise = F.transform("v", lambda x, d: hash_unit(F.col("node"), d, F.lit(layer), F.lit(seed)))
    rows = vectors.select("node", "v", noise.alias("__noise"))
    length = F.sqrt(dot(F.col("__noise"), F.col("__noise")))
    return rows.select("node", F.zip_with("v", "__noise", lambda x, h: x + F.signum(x) * F.when(length > 0, h / length).otherwise(0.0) * size).alias("v"))


def noisy(vectors: DataFrame, layer: int, size: float = 0.1, seed: int = 42) -> DataFrame:
    """CF-11: node, dim, value moved by a hashed noise of length `size` that has the signs of the vector."""
    noise = hash_unit("node", "dim", F.lit(layer), F.lit(seed))
    rows = vectors.withColumn("__noise", noise)
    length = F.sqrt(F.sum(F.col("__noise") * F.col("__noise")).over(Window.partitionBy("node")))
    moved = F.col("value") + F.signum("value") * F.when(length > 0, F.col("__noise") / length).otherwise(0.0) * size
    return rows.select("node", "dim", moved.alias("value"))


def propagate_noisy(edges: DataFrame, vectors: DataFrame, layers: int, size: float = 0.1, seed: int = 42) -> DataFrame:
    """CF-11, CF-12: the mean of `layers` rounds of edges times vectors, each with noise; the start doesn't count. A round moves one array an edge."""
    width = (vectors.agg(F.max("dim")).first()[0] or 0) + 1
    every, now = None, written(wide(vectors, width), "layer")
    for layer in range(layers):
        along = edges.join(now.select(F.col("node").alias("src"), "v"), "src").select(F.col("dst").alias("node"), "w", "v")
        now = written(noisy_arrays(summed(along, width, F.col("w")), layer, size, seed), "layer")
        every = now if every is None else every.unionByName(now)
    return summed(every, width).select("node", F.posexplode("v").alias("dim", "value")).withColumn("value", F.col("value") / layers)


def info_nce(one: DataFrame, other: DataFrame, temperature: float = 0.2, batch: Column | None = None) -> DataFrame:
    """CF-20: the contrastive loss of two views (id, v): each row against all rows of its batch.

    `batch` names the batch of a row, if there are several: rows meet those of their own batch alone, by an equal join, so the work grows with the rows
    times the size of a batch. The mean is over all rows.
    """
    key = F.lit(0) if batch is None else batch
    a = one.select("id", key.alias("batch"), unit(doubles("v")).alias("a"))
    b = other.withColumn("batch", key).select("batch", F.col("id").alias("__id"), unit(doubles("v")).alias("b"))
    s = cosine(F.col("a"), F.col("b")) / temperature
    rows = a.join(b, "batch").select("batch", "id", "__id", s.alias("s")).groupBy("batch", "id")
    loss = rows.agg((F.log(F.sum(F.exp("s"))) - F.max(F.when(F.col("id") == F.col("__id"), F.col("s")))).alias("loss"))
    return loss.agg(F.round(F.avg("loss"), 6).alias("info_nce"), F.count(F.lit(1)).alias("n"))


def bce_loss(edges: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """CF-21: mean cross-entropy of edges (user_id, item_id, label) by the dot product of their vectors (user_id or item_id, v)."""
    rows = edges.join(users.select("user_id", doubles("v").alias("a")), "user_id").join(items.select("item_id", doubles("v").alias("b")), "item_id")
    s = dot(F.col("a"), F.col("b"))
    loss = F.log1p(F.exp(-F.abs(s))) + F.greatest(s, F.lit(0.0)) - s * F.col("label")
    return rows.agg(F.round(F.avg(loss), 6).alias("bce_loss"), F.count(F.lit(1)).alias("n"))


def dominant_class(history: DataFrame, classes: DataFrame) -> DataFrame:
    """CF-24: user_id and the class that most of what they read has, the smallest of equals. history: user_id, item; classes: item, class."""
    n = history.join(classes, "item").groupBy("user_id", "class").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("user_id").agg(F.min_by("class", F.struct(-F.col("n"), "class")).alias("class"))


def class_odds(post: DataFrame, classes: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """CF-24: doc_id, class, p: the multinomial model's P(class | document) of all documents; words it doesn't know count nothing."""
    model = naive_bayes(post, classes, smoothing)
    vocabulary = model.select("term").distinct()
    names = classes.groupBy("class").agg(F.count(F.lit(1)).alias("docs"))
    prior = names.select("class", F.log(F.col("docs") / F.sum("docs").over(Window.partitionBy())).alias("prior"))  # one row a class
    total = post.join(classes, "doc_id").groupBy("class").agg(F.sum("tf").alias("total"))
    rest = F.round(F.log(F.lit(smoothing) / (F.col("total") + smoothing * vocabulary.count())), 6)
    each = post.join(vocabulary, "term").crossJoin(F.broadcast(prior.join(total, "class").select("class", "prior", rest.alias("rest"))))
    logs = each.join(model, ["class", "term"], "left").groupBy("doc_id", "class").agg((F.max("prior") + F.sum(F.col("tf") * F.coalesce("logp", "rest"))).alias("s"))
    top = F.max("s").over(Window.partitionBy("doc_id"))
    shifted = logs.withColumn("e", F.exp(F.col("s") - top))
    return shifted.select("doc_id", "class", (F.col("e") / F.sum("e").over(Window.partitionBy("doc_id"))).alias("p"))


def projected(vectors: DataFrame, k: int, scale: float = 0.1, seed: int = 42) -> DataFrame:
    """EMB-15: vec_id, dim, value: k hashed directions, at length 1, between -1 and 1, times `scale`."""
    rows = vectors.select("vec_id", F.size("embedding").alias("n"), F.posexplode(doubles("embedding")).alias("dim", "x")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    y = rows.groupBy("vec_id", "k").agg(F.sum(F.col("x") * (hash_unit("dim", "k", F.lit(seed)) - 0.5) / F.sqrt("n")).alias("y"))
    length = F.sqrt(F.sum(F.col("y") * F.col("y")).over(Window.partitionBy("vec_id")))
    value = F.when(length > 0, F.col("y") / length).otherwise(0.0)
    return y.select("vec_id", F.col("k").alias("dim"), (scale * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))).alias("value"))
