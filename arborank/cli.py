"""Command lines: graphs, neighbour models, trained models, texts, and any registered query.

    python -m arborank.cli graph   --data DIR --output DIR [--graph-type g1..g8|all]
    python -m arborank.cli knn     --data DIR --model user_knn|item_knn|slope_one|svd|nmf [--similarity ...] [--protocol full|loo] [--output FILE]
    python -m arborank.cli train   --data DIR --model lightgcn|simgcl|lightgcl|ngcf|bigcf|ma_hgn [--gnn-type ...] [--hidden-dim N] [--n-layers N] [--output DIR]
    python -m arborank.cli content --data DIR [--k N] [--output DIR]
    python -m arborank.cli texts   --data DIR --step tokens|segments|tfidf|bm25 --output DIR
    python -m arborank.cli query   --data DIR --name NAME --output DIR

DIR is any path of Spark's that holds the tables; results are Parquet, metrics one JSON object. Settings of the session come from spark-submit or, with
--settings FILE, from a TOML or YAML file.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expressions as X
from .operators import encoders as E
from .operators import graph as G
from .operators import interactions as I
from .operators import lexical as L
from .operators import models as M
from .operators import ranking as R
from .operators import scoring as S
from .operators import words as W
from .plans import catalogue
from .plans.encoder_queries import RELATIONS, hashed_vectors, typed_graph
from .plans.model_queries import NOW, categories, content_scores, first_days, ones, ratings, split
from .plans.text_queries import item_queries, posted, weighed, words
from .sources.bindings import Tables, interactions, purchases, reading_history
from .sources.files import settings
from .sources.storage import written

GRAPHS: dict[str, Callable[[Tables], DataFrame]] = {
    "g1": lambda t: G.bipartite(interactions(t)),
    "g2": lambda t: G.shared_interest(interactions(t), 2),
    "g3": lambda t: G.user_category(interactions(t), categories(t)),
    "g4": lambda t: G.author_of(purchases(t)),
    "g5": lambda t: G.same_days(first_days(t), 3, categories(t)),
    "g6": lambda t: G.bipartite(interactions(t), NOW, 0.01),
    "g7": lambda t: G.cross_category_classes(G.user_category(interactions(t), categories(t)), 6),
    "g8": lambda t: G.tenure(purchases(t), purchases(t).groupBy("user_id").agg(F.min("ts").cast("date").alias("join_date")), NOW),
}


def graphs(t: Tables, a: argparse.Namespace) -> None:
    for kind in GRAPHS if a.graph_type == "all" else [a.graph_type]:
        GRAPHS[kind](t).write.mode("overwrite").parquet(f"{a.output}/{kind}")


def neighbour_scores(train: DataFrame, users: DataFrame, model: str, similarity: str, factors: int) -> DataFrame:
    """user_id, item_id, score of the users asked for. similarity "pearson" is the centred one."""
    kind = {"pearson": "centred"}.get(similarity, similarity)
    rows = train.select("user_id", "item_id", F.col("reactions").cast("double").alias("r"))
    if model == "item_knn":
        return S.item_scores(rows.join(users, "user_id", "left_semi"), S.similarity(ones(train), kind))
    if model == "user_knn":
        return S.user_scores(rows, S.similarity(rows, kind, of="user_id", by="item_id").join(users.select(F.col("user_id").alias("a")), "a", "left_semi"))
    if model == "slope_one":
        return S.slope_one(rows, users)
    left, right = M.svd(rows, factors) if model == "svd" else M.nmf(rows, factors)[:2]
    return M.factor_scores(left.join(users, "user_id", "left_semi"), right)


def evaluated(scores: DataFrame, train: DataFrame, test: DataFrame, protocol: str, every: DataFrame) -> DataFrame:
    """EVL-11: metric, k, value over all items, or over the test items among 100 sampled others."""
    scores = scores.select("user_id", "item_id", F.round("score", 6).alias("score"))
    if protocol == "full":
        return R.list_metrics(R.masked_top(scores, train, 50), test, [10, 20, 50])
    candidates = I.negatives(every, every, test, 100).unionByName(test)
    rows = candidates.join(scores, ["user_id", "item_id"], "left").na.fill(0.0, ["score"])
    return R.list_metrics(R.masked_top(rows, train, 50), test, [10, 20, 50])


def said(metrics: DataFrame, output: str | None) -> str:
    found = {f"{r.metric}@{r.k}": r.value for r in metrics.orderBy("k", "metric").collect()}  # a metric a row
    if output:
        with open(output, "w") as f:
            json.dump(found, f, indent=1)
    return json.dumps(found)


def neighbours(t: Tables, a: argparse.Namespace) -> str:
    train, test = split(t)
    scores = written(neighbour_scores(train, test.select("user_id").distinct(), a.model, a.similarity, a.factors), "scores")
    return said(evaluated(scores, train, test, a.protocol, train.select("user_id", "item_id").unionByName(test)), a.output)


def encoded(t: Tables, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """(user_id, v) and (item_id, v) of a graph encoder over the training split, from hashed vectors of --hidden-dim numbers."""
    train, _ = split(t)
    reads = train.select(F.col("user_id").alias("src"), F.col("item_id").alias("dst"), F.lit(1.0).alias("w"))
    edges = written(G.normalised(G.as_nodes(reads)), "edges")
    numbers = F.transform(F.sequence(F.lit(0), F.lit(a.hidden_dim - 1)), lambda d: 0.1 * (X.hash_unit(F.col("node"), d) - 0.5))
    nodes = written(edges.select(F.col("src").alias("node")).distinct().select("node", numbers.alias("v")), "nodes")
    flat = nodes.select("node", F.posexplode("v").alias("dim", "value"))
    users, items = nodes.filter("node like 'u%'"), nodes.filter("node like 'i%'")

    def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        wide = rows if "v" in rows.columns else S.wide(rows, a.hidden_dim)
        one = lambda kind, key: wide.filter(f"node like '{kind}%'").select(F.substring("node", 2, 40).cast("long").alias(key), "v")
        return one("u", "user_id"), one("i", "item_id")

    if a.model == "lightgcn":
        return sides(S.propagate(edges, flat, a.n_layers))
    if a.model == "simgcl":
        return sides(S.propagate_noisy(edges, flat, a.n_layers))
    if a.model == "ngcf":
        return sides(E.ngcf(edges, nodes, a.n_layers))
    if a.model == "bigcf":
        return sides(E.intent_guided(edges, users, items, layers=a.n_layers))
    if a.model == "lightgcl":
        pairs = G.rectangular(reads).select(F.col("src").alias("user_id"), F.col("dst").alias("item_id"), "w")
        found = E.low_rank_view(pairs, *sides(nodes), factors=a.svd_q, layers=a.n_layers)
        return found["users"], found["items"]
    kind = {"gat": "attention", "transformer": "product", "sage": "mean", "gcn": "sum"}[a.gnn_type]
    typed, relations = typed_graph(t)
    typed = written(hashed_vectors(typed.select("kind", "node"), a.hidden_dim), "nodes")
    return sides(E.multi_aspect(typed, relations, RELATIONS, kind, a.n_layers).select("node", "v"))


def trained(t: Tables, a: argparse.Namespace) -> str:
    """Encoder, then steps of the ranking loss on its vectors, then the metrics; with --output the factors are kept."""
    train, test = split(t)
    users, items = (written(x, "factors") for x in encoded(t, a))
    pairs = written(train.select("user_id", F.col("item_id").alias("pos")), "pairs")
    most = pairs.agg(F.max("pos")).first()[0] or 1
    triples = pairs.withColumn("neg", F.floor(X.hash_unit("user_id", "pos", F.lit("neg")) * most).cast("long") + 1).join(pairs.withColumnRenamed("pos", "neg"), ["user_id", "neg"], "left_anti")
    if a.epochs:
        users, items = M.bpr(triples, users, items, a.epochs, a.lr, a.weight_decay)
    if a.output:
        users.write.mode("overwrite").parquet(f"{a.output}/users")
        items.write.mode("overwrite").parquet(f"{a.output}/items")
    asked = users.filter("user_id % 20 = 0")
    test = test.filter("user_id % 20 = 0")
    return said(evaluated(written(M.factor_scores(asked, items), "scores"), train, test, a.eval_protocol, train.select("user_id", "item_id").unionByName(test)), None)


def content(t: Tables, a: argparse.Namespace) -> None:
    read = reading_history(t, "embeddings").select("user_id", F.col("item").alias("item_id")).distinct()
    R.masked_top(content_scores(t), read, a.k).write.mode("overwrite").parquet(a.output)


def texts(t: Tables, a: argparse.Namespace) -> None:
    def segments() -> DataFrame:
        rows = written(t.documents.select("doc_id", words(t).alias("syllables")), "syllables")
        return L.postings(rows, W.segmented(F.col("syllables"), W.learnt_words(rows, F.col("syllables"))))

    steps = {"tokens": lambda: posted(t), "segments": segments, "tfidf": lambda: weighed(t), "bm25": lambda: L.best_docs(L.bm25(posted(t), item_queries(t), "okapi", k=20), 20)}
    steps[a.step]().write.mode("overwrite").parquet(a.output)


def asked(t: Tables, a: argparse.Namespace) -> None:
    catalogue.QUERIES[a.name](t.spark, t.dir).write.mode("overwrite").parquet(a.output)


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="arborank", description="Recommendation analytics on Spark")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, output: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("--data", required=True)
        p.add_argument("--output", required=output)
        p.add_argument("--settings")
        p.set_defaults(run=run)
        return p

    command("graph", graphs).add_argument("--graph-type", "-g", choices=[*GRAPHS, "all"], default="g2")
    p = command("knn", neighbours, False)
    p.add_argument("--model", choices=["user_knn", "item_knn", "slope_one", "svd", "nmf"], required=True)
    p.add_argument("--similarity", choices=["cosine", "pearson", "jaccard"], default="cosine")
    p.add_argument("--protocol", choices=["full", "loo"], default="full")
    p.add_argument("--factors", type=int, default=64)
    p = command("train", trained, False)
    p.add_argument("--model", "-m", choices=["lightgcn", "simgcl", "lightgcl", "ngcf", "bigcf", "ma_hgn"], default="simgcl")
    p.add_argument("--gnn-type", choices=["gat", "sage", "gcn", "transformer"], default="gat")
    p.add_argument("--eval-protocol", choices=["full", "loo"], default="full")
    for name, kind, default in (("--hidden-dim", int, 64), ("--n-layers", int, 3), ("--svd-q", int, 20), ("--epochs", int, 10), ("--lr", float, 0.05), ("--weight-decay", float, 1e-4)):
        p.add_argument(name, type=kind, default=default)
    command("content", content).add_argument("--k", type=int, default=10)
    command("texts", texts).add_argument("--step", choices=["tokens", "segments", "tfidf", "bm25"], required=True)
    command("query", asked).add_argument("--name", choices=sorted(catalogue.QUERIES), required=True, metavar="NAME")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str | None:
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("arborank").getOrCreate()
    if a.settings:
        settings(spark, a.settings)
    return a.run(Tables(spark, a.data.rstrip("/")), a)


if __name__ == "__main__":
    print(main() or "done")
