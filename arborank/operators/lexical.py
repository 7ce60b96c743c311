"""Text retrieval over long tables (doc_id, term, tf): TF-IDF and the BM25 family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written
from .ordering import spread_join, top_per
from .sparse import packed, products


def postings(docs: DataFrame, words) -> DataFrame:
    """doc_id, term, tf. words: an array column."""
    return docs.select("doc_id", F.explode(words).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def tf_idf(post: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0, sublinear: bool = False, fit_on: DataFrame | None = None, max_features: int | None = None) -> DataFrame:
    """TXT-9, TXT-10: doc_id, term, w; idf = ln((1 + n) / (1 + df)) + 1, rows at length 1.

    fit_on: the documents (doc_id) whose counts make the vocabulary; all are weighed. max_features: only so many terms, those that
    occur most often.
    """
    base = post if fit_on is None else post.join(fit_on.select("doc_id"), "doc_id", "left_semi")
    df = base.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features is not None:
        often = base.groupBy("term").agg(F.sum("tf").alias("n")).join(df.select("term"), "term", "left_semi")
        df = df.join(often.orderBy(F.desc("n"), "term").limit(max_features).select("term"), "term", "left_semi")
    df = written(df, "df")
    idf = df.select("term", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    tf = 1 + F.log(F.col("tf").cast("double")) if sublinear else F.col("tf").cast("double")
    weighed = spread_join(post.select("doc_id", "term", "tf"), idf, ["term"], F.xxhash64("doc_id"), sizes=df.select("term", F.col("df").alias("__n")))
    rows = weighed.select("doc_id", F.struct("term", (tf * F.col("idf")).alias("w")).alias("x"))
    docs = rows.groupBy("doc_id").agg(F.collect_list("x").alias("x"), F.sqrt(F.sum(F.col("x.w") * F.col("x.w"))).alias("len"))  # a document's terms, fewer than its words
    return docs.select("doc_id", F.explode("x").alias("x"), "len").select("doc_id", "x.term", (F.col("x.w") / F.col("len")).alias("w"))


def similar_docs(weights: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """EMB-8 on text: for each query document its k nearest others by cosine (a, b, sim, rk), of those that share a term."""
    docs = written(packed(weights, "doc_id"), "docs")
    asked = written(docs.join(queries.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi"), "asked")
    sims = products(asked, docs, k, itself=False).select("a", "b", F.round("x", 6).alias("sim"))
    return top_per(sims, ["a"], [F.desc("sim"), F.col("b")], k)


def similar_ensemble(weights: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, dense: float) -> DataFrame:
    """RNK-9: for each query document its k best others (a, b, score, rk) by `dense` times the cosine of the vectors plus the rest of the cosine of the weights.

    vectors: id, v, one length, of all documents that count; the weights (doc_id, term, w) may lack some of them.
    """
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    docs = written(vectors.join(packed(weights, "doc_id"), "id", "left").select("id", none("t", "string"), none("w", "double"), "v"), "docs")
    asked = written(docs.join(queries.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi"), "asked")
    found = products(asked, docs, k, itself=False, dense=dense).select("a", "b", F.round("x", 6).alias("score"))
    return top_per(found, ["a"], [F.desc("score"), F.col("b")], k)


def bm25(post: DataFrame, queries: DataFrame, kind: str = "okapi", k1: float = 1.5, b: float = 0.75, delta: float = 0.5, k: int | None = None, taken: DataFrame | None = None) -> DataFrame:
    """TXT-11 to TXT-16: query_id, doc_id, score of documents that share a term. queries: query_id, term, qtf.

    kind: "okapi", "plus" (delta for matched terms) or "l". Query terms count as often as they occur. With k, only scores that may be among a query's first k,
    rounded to six digits. Documents of `taken` (query_id, doc_id) don't count.
    """
    df = written(post.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    asked = df.join(queries.select("term").distinct(), "term", "left_semi")
    rows = spread_join(post.select("doc_id", "term", "tf"), asked, ["term"], F.xxhash64("doc_id"), "left", sizes=df.select("term", F.col("df").alias("__n")))
    # each document once, with its length and those of its terms that are asked for
    own = F.collect_list(F.when(F.col("df").isNotNull(), F.struct("term", "tf", "df")))
    docs = written(rows.groupBy("doc_id").agg(F.sum("tf").alias("dl"), own.alias("x")), "docs")
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    length = 1 - b + b * F.col("dl") / F.col("avgdl")

    def weight(r: Column) -> Column:
        idf = F.log((F.col("n") - r["df"] + 0.5) / (r["df"] + 0.5) + 1)
        if kind == "l":
            ctf = r["tf"] / length
            return idf * (k1 + 1) * (ctf + delta) / (k1 + ctf + delta)
        return idf * (r["tf"] * (k1 + 1) / (r["tf"] + k1 * length) + (delta if kind == "plus" else 0.0))

    entries = docs.filter(F.size("x") > 0).crossJoin(F.broadcast(total)).select(F.col("doc_id").alias("id"), F.col("x.term").alias("t"), F.transform("x", weight).alias("w"))  # total is one row
    asked = packed(queries, "query_id", "qtf")
    if taken is not None:
        own = taken.groupBy(F.col("query_id").alias("id")).agg(F.collect_set(F.col("doc_id").cast("long")).alias("taken"))
        asked = asked.join(own, "id", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<long>")))
    found = products(written(asked, "asked"), written(entries, "entries"), k)
    return found.select(F.col("a").alias("query_id"), F.col("b").alias("doc_id"), F.col("x").alias("score"))


def best_docs(scores: DataFrame, k: int, exclude: DataFrame | None = None) -> DataFrame:
    """TXT-13, RNK-11: query_id, doc_id, score, rk; scores are rounded before they are ranked, so that ties are ties."""
    if exclude is not None:
        scores = scores.join(exclude, ["query_id", "doc_id"], "left_anti")
    return top_per(scores.withColumn("score", F.round("score", 6)).filter("score > 0"), ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def profile_terms(history: DataFrame, post: DataFrame, cap: int = 100, repeats: int = 3, how: str = "tf") -> DataFrame:
    """TXT-17: the terms of what a user has read: query_id, term, qtf. history: user_id, doc_id.

    how: "tf", the most frequent, each at most `repeats` times; "concat", the most frequent, as often as they occur; "tfidf", those of largest count times
    idf, once each; "distinct", each once, by the alphabet. `cap` terms a user.
    """
    order, qtf = [F.desc("c"), F.col("term")], F.least("c", F.lit(repeats))
    if how == "concat":
        qtf = F.col("c")
    if how == "distinct":
        order, qtf = [F.col("term")], F.lit(1)
    rows, value = post.select("doc_id", "term", "tf"), F.sum("x.tf")
    if how == "tfidf":
        n = post.select("doc_id").distinct().count()
        df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        idf = df.select("term", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
        rows, value = spread_join(rows, written(idf, "idf"), ["term"], F.xxhash64("doc_id"), sizes=df.withColumnRenamed("df", "__n")), F.round(F.sum("x.tf") * F.max("x.idf"), 6)
        qtf = F.lit(1)
    terms = F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != "doc_id"])))
    # of each document, only terms that may be among the first
    docs = written(rows.groupBy("doc_id").agg((F.slice(terms, 1, cap) if how == "distinct" else terms).alias("terms")), "docs")
    # a document's terms go to its reader in one row, and are counted there
    own = history.select("user_id", "doc_id").join(docs, "doc_id").select("user_id", "terms").repartition("user_id")
    counts = own.select("user_id", F.explode("terms").alias("x")).groupBy("user_id", F.col("x.term").alias("term")).agg(value.alias("c"))
    best = top_per(counts, ["user_id"], order, cap)
    return best.select(F.col("user_id").alias("query_id"), "term", qtf.cast("bigint").alias("qtf"))


def top_terms(weights: DataFrame, k: int) -> DataFrame:
    """TXT-18: the k heaviest terms of each document."""
    rows = weights.withColumn("w", F.round("w", 6)).filter("w > 0")
    return top_per(rows, ["doc_id"], [F.desc("w"), F.col("term")], k)


def unknown_rate(post: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """TXT-26: share of word occurrences, and of words, outside the vocabulary (term)."""
    words = post.groupBy("term").agg(F.sum("tf").alias("n")).join(vocabulary.select("term").distinct().withColumn("known", F.lit(1)), "term", "left")
    out = F.col("known").isNull().cast("int")
    return words.agg(F.round(F.sum(out * F.col("n")) / F.sum("n"), 6).alias("token_oov"), F.round(F.avg(out.cast("double")), 6).alias("type_oov"))


def explained(history: DataFrame, shown: DataFrame, least: float = 0.1) -> DataFrame:
    """TXT-20: user_id, item_id, because, score, kind: for each item shown (item_id, title; a short list, which is sent to the tasks) the
    most similar title of a user's history (user_id, because, theirs) by Jaccard; up to `least` the category has to do as a reason."""
    union = F.size(F.array_union("title", "theirs"))
    score = F.coalesce(F.round(F.size(F.array_intersect("title", "theirs")) / F.nullif(union, F.lit(0)), 6), F.lit(0.0))
    best = history.crossJoin(F.broadcast(shown)).groupBy("user_id", "item_id").agg(F.max_by(F.struct("because", score.alias("score")), F.struct(score, -F.col("because"))).alias("x"))
    return best.select("user_id", "item_id", "x.because", "x.score", F.when(F.col("x.score") > least, "title").otherwise("category").alias("kind"))
