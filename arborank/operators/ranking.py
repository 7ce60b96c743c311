"""Candidates to final lists: masks, blends, boosts, greedy re-ranking, and the metrics of lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running, top_per


def masked_top(scores: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """RNK-1: user_id, item_id, score, rk of unseen items; ties go to the smaller item."""
    free = scores.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").withColumn("score", F.round("score", 6))
    return top_per(free.select("user_id", "item_id", "score"), ["user_id"], [F.desc("score"), F.col("item_id")], k)


def scaled(scores: DataFrame, how: str = "minmax") -> DataFrame:
    """RNK-3: scores of each user between 0 and 1; equal scores all become 1. Or by the sigmoid."""
    if how == "sigmoid":
        return scores.withColumn("score", 1 / (1 + F.exp(-F.col("score"))))
    w = Window.partitionBy("user_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))


def blended(cf: DataFrame, content: DataFrame, alpha: float, k_cf: int = 200, k_content: int = 150) -> DataFrame:
    """RNK-4: user_id, item_id, score, source: alpha times the CF score plus the rest of the content score over its maximum.

    An item from both keeps the label of the first, "CF".
    """
    a = top_per(cf, ["user_id"], [F.desc("score"), F.col("item_id")], k_cf).select("user_id", "item_id", (F.col("score") * alpha).alias("a"))
    b = top_per(content, ["user_id"], [F.desc("score"), F.col("item_id")], k_content)
    top = F.max("score").over(Window.partitionBy("user_id"))
    b = b.select("user_id", "item_id", (F.when(top > 0, F.col("score") / top).otherwise(0.0) * (1 - alpha)).alias("b"))
    both = a.join(b, ["user_id", "item_id"], "full_outer")
    return both.select("user_id", "item_id", (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("score"), F.when(F.col("a").isNotNull(), "CF").otherwise("Content").alias("source"))


def category_boost(scores: DataFrame, categories: DataFrame, liked: DataFrame, boost: float = 0.2) -> DataFrame:
    """RNK-10: adds `boost` where the item's category is one of the user's (user_id, category)."""
    own = liked.select("user_id", "category").distinct().withColumn("hit", F.lit(1))
    return scores.join(categories, "item_id", "left").join(own, ["user_id", "category"], "left").select("user_id", "item_id", (F.col("score") + F.when(F.col("hit").isNotNull(), boost).otherwise(0.0)).alias("score"))


def session_boost(scores: DataFrame, neighbours: DataFrame, most: float = 0.6, relabel: float = 0.3) -> DataFrame:
    """RNK-6: adds up to `most` by similarity to the last click, and renames the source above `relabel`. neighbours: user_id, item_id, sim."""
    add = F.least(F.greatest(F.coalesce("sim", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * most
    return scores.join(neighbours.select("user_id", "item_id", "sim"), ["user_id", "item_id"], "left").select("user_id", "item_id", (F.col("score") + add).alias("score"), F.when(add > relabel, "Session").otherwise(F.col("source")).alias("source"))


def fresh(day: Column, now: str, decay: float = 0.1) -> Column:
    """exp(-decay * days); a missing date counts as 0.5."""
    days = F.greatest(F.datediff(F.lit(now).cast("date"), day), F.lit(0))
    return F.when(day.isNull(), 0.5).otherwise(F.exp(-decay * days))


def freshness(scores: DataFrame, dates: DataFrame, now: str, decay: float = 0.1, weight: float = 0.3) -> DataFrame:
    """RNK-12: blends each user's scores with exp(-decay * days) over its maximum; a missing date counts as 0.5."""
    rows = scores.join(dates, "item_id", "left").withColumn("f", fresh(F.col("day"), now, decay))
    w = Window.partitionBy("user_id")
    f = F.when(F.max("f").over(w) > 0, F.col("f") / F.max("f").over(w)).otherwise(F.col("f"))
    return rows.select("user_id", "item_id", ((1 - weight) * F.col("score") + weight * f * F.max("score").over(w)).alias("score"))


def mmr(candidates: DataFrame, vectors: DataFrame, k: int, balance: float = 0.5, most: int = 100) -> DataFrame:
    """RNK-14: user_id, item_id, rk: greedy choice by balance * score - (1 - balance) * similarity to what is chosen.

    One group a user of at most `most` candidates, which is the operator's own limit. An item without a vector is similar to nothing.
    """
    best = top_per(candidates, ["user_id"], [F.desc("score"), F.col("item_id")], most, "__c").join(vectors.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id", "left")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "item_id"], ascending=[False, True])
        width = max((len(x) for x in pdf["embedding"] if x is not None), default=1)
        v = np.array([np.zeros(width) if x is None else np.asarray(x, float) for x in pdf["embedding"]])
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        near, score, left, chosen = v @ v.T, pdf["score"].to_numpy(), np.ones(len(pdf), bool), []
        worst = np.full(len(pdf), -np.inf)
        for _ in range(min(k, len(pdf))):
            value = np.round(balance * score - (1 - balance) * worst, 9) if chosen else score
            i = int(np.argmax(np.where(left, value, -np.inf)))
            chosen.append(i)
            left[i] = False
            worst = np.maximum(worst, near[i])
        ids = pdf["item_id"].to_numpy()[chosen]
        return pd.DataFrame({"user_id": pdf["user_id"].iloc[0], "item_id": ids, "rk": range(1, len(ids) + 1)})

    return best.select("user_id", "item_id", "score", "embedding").groupBy("user_id").applyInPandas(greedy, "user_id long, item_id long, rk long")


def calibrated(candidates: DataFrame, categories: DataFrame, history: DataFrame, k: int, alpha: float = 0.5, most: int = 100) -> DataFrame:
    """RNK-13: user_id, item_id, rk: greedy choice by (1 - alpha) * score - alpha * KL(chosen categories || the user's own).

    categories: item_id, category. history: user_id, category, p (its shares). At most `most` candidates a user. Items without a category share one of
    their own, and a user without a history has a target of nothing: such a list goes by score and by how many categories it has.
    """
    name = F.coalesce(F.col("category").cast("string"), F.lit(""))
    best = top_per(candidates, ["user_id"], [F.desc("score"), F.col("item_id")], most, "__c").join(categories.select("item_id", name.alias("category")), "item_id", "left").na.fill("", ["category"])
    target = history.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(name, "p"))).alias("target"))
    tiny = 1e-9

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "item_id"], ascending=[False, True])
        goal = dict(pdf["target"].iloc[0] or {})
        names = sorted({*pdf["category"], *goal})
        place = {c: i for i, c in enumerate(names)}
        p = np.array([goal.get(c, 0.0) for c in names])
        own, score = pdf["category"].map(place).to_numpy(), pdf["score"].to_numpy()
        counts, left, chosen = np.zeros(len(names)), np.ones(len(pdf), bool), []
        for n in range(1, min(k, len(pdf)) + 1):
            new = (counts + np.eye(len(names))) / (n + tiny)
            kl = (new * np.log((new + tiny) / (p + tiny))).sum(axis=1)
            value = np.round((1 - alpha) * score - alpha * kl[own], 9)
            i = int(np.argmax(np.where(left, value, -np.inf)))
            chosen.append(i)
            left[i] = False
            counts[own[i]] += 1
        ids = pdf["item_id"].to_numpy()[chosen]
        return pd.DataFrame({"user_id": pdf["user_id"].iloc[0], "item_id": ids, "rk": range(1, len(ids) + 1)})

    rows = best.join(target, "user_id", "left").select("user_id", "item_id", "score", "category", "target")
    return rows.groupBy("user_id").applyInPandas(greedy, "user_id long, item_id long, rk long")


def reranked(scores: DataFrame, vectors: DataFrame, categories: DataFrame, history: DataFrame, k: int, chosen: int = 20) -> DataFrame:
    """RNK-15 after freshness(): user_id, item_id, rk: diversity among the `chosen` items of calibration; a user without a history has no calibration."""
    known = history.select("user_id").distinct()
    kept = calibrated(scores.join(known, "user_id", "left_semi"), categories, history, chosen).select("user_id", "item_id")
    rows = scores.join(kept, ["user_id", "item_id"]).unionByName(scores.join(known, "user_id", "left_anti"))
    return mmr(rows, vectors, k)


def mapped_users(profiles: DataFrame, history: DataFrame, shown: DataFrame, vectors: DataFrame) -> DataFrame:
    """EMB-20: user_id, kind ("User", "History" or "Recommendation"), item_id, x, y: each user's points on their own two principal axes.

    profiles: user_id, v; history, shown: user_id, item_id, which the caller bounds (one group a user). An axis points to where its largest part is; a user with
    fewer than two points has no map, one with two lies on one axis. Items without a vector are left out.
    """
    v = vectors.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("v"))
    kinds = [rows.select("user_id", F.lit(kind).alias("kind"), "item_id").join(v, "item_id") for kind, rows in (("History", history), ("Recommendation", shown))]
    points = profiles.select("user_id", F.lit("User").alias("kind"), F.lit(None).cast("long").alias("item_id"), F.col("v").cast("array<double>").alias("v"))
    for rows in kinds:
        points = points.unionByName(rows.select("user_id", "kind", F.col("item_id").cast("long").alias("item_id"), "v"))

    def placed(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pd.DataFrame({"user_id": pd.Series(dtype="int64"), "kind": pd.Series(dtype="str"), "item_id": pd.Series(dtype="Int64"), "x": pd.Series(dtype="float64"), "y": pd.Series(dtype="float64")})
        pdf = pdf.sort_values(["kind", "item_id"], na_position="first")
        m = np.array([np.asarray(x, float) for x in pdf["v"]])
        _, _, axes = np.linalg.svd(m - m.mean(0), full_matrices=False)
        axes = axes[: 2 if len(m) > 2 else 1]
        axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
        at = (m - m.mean(0)) @ axes.T
        return pd.DataFrame({"user_id": pdf["user_id"], "kind": pdf["kind"], "item_id": pdf["item_id"].astype("Int64"), "x": at[:, 0], "y": at[:, 1] if at.shape[1] > 1 else 0.0})

    return points.groupBy("user_id").applyInPandas(placed, "user_id long, kind string, item_id long, x double, y double")


def list_metrics(ranked: DataFrame, test: DataFrame, ks: list[int]) -> DataFrame:
    """EVL-1 to EVL-7: metric, k, value: means over the users with test items. ranked: user_id, item_id, rk; test: user_id, item_id."""
    size = test.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    hits = ranked.join(test.select("user_id", "item_id"), ["user_id", "item_id"]).select("user_id", "rk", F.row_number().over(Window.partitionBy("user_id").orderBy("rk")).alias("nth"))
    parts = None
    for k in ks:
        at = F.col("rk") <= k
        each = size.join(hits.groupBy("user_id").agg(F.count(F.when(at, 1)).alias("h"), F.sum(F.when(at, 1 / F.log2(F.col("rk") + 1.0))).alias("dcg"), F.min(F.when(at, F.col("rk"))).alias("first"), F.sum(F.when(at, F.col("nth") / F.col("rk"))).alias("ap")), "user_id", "left")
        h = F.coalesce("h", F.lit(0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
        recall, precision = h / F.col("n"), h / F.lit(float(k))
        values = {
            "recall": recall,
            "precision": precision,
            "ndcg": F.coalesce("dcg", F.lit(0.0)) / ideal,
            "hit": (h > 0).cast("double"),
            "mrr": F.coalesce(1 / F.col("first"), F.lit(0.0)),
            "map": F.coalesce("ap", F.lit(0.0)) / F.least(F.col("n"), F.lit(k)),
            "f1": F.when(h > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0),
        }
        means = each.agg(*[F.round(F.avg(v), 6).alias(m) for m, v in values.items()])
        part = means.select(F.explode(F.create_map(*[x for m in values for x in (F.lit(m), F.col(m))])).alias("metric", "value")).select("metric", F.lit(k).cast("bigint").alias("k"), "value")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def with_positives(scores: DataFrame, positives: DataFrame) -> DataFrame:
    """scores with pos, 1 for the pairs (user_id, item_id) of positives and 0 for others."""
    return scores.join(positives.select("user_id", "item_id").withColumn("pos", F.lit(1)), ["user_id", "item_id"], "left").na.fill(0, ["pos"])


def auc(scores: DataFrame, positives: DataFrame | None = None) -> DataFrame:
    """EVL-8: user_id, auc by the rank sum with average ranks on ties. Users need both kinds. Scores have pos, if positives are not given.

    Equal scores of a user are counted first, so a row is a score and not a pair.
    """
    rows = scores if positives is None else with_positives(scores, positives)
    rows = rows.groupBy("user_id", "score").agg(F.sum("pos").alias("pos"), F.count(F.lit(1)).alias("same"))
    upto = F.sum("same").over(Window.partitionBy("user_id").orderBy("score"))
    rows = rows.withColumn("rank", upto - (F.col("same") - 1) / 2.0)
    u = rows.groupBy("user_id").agg(F.sum(F.col("rank") * F.col("pos")).alias("s"), F.sum("pos").alias("p"), F.sum("same").alias("n")).filter("p > 0 and n > p")
    return u.select("user_id", F.round((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p"))), 6).alias("auc"))


def auc_all(scores: DataFrame, positives: DataFrame | None = None) -> DataFrame:
    """EVL-8 over all pairs: auc, positives, negatives, by the counts of each score; equal scores share their ranks.

    Scores are counted first and their running sums made by ranges, so no task sees all pairs. Null without both kinds. Scores have pos, if
    positives are not given.
    """
    rows = scores if positives is None else with_positives(scores, positives)
    counts = rows.groupBy("score").agg(F.sum("pos").cast("bigint").alias("p"), F.count(F.lit(1)).alias("n"))
    below = running(counts, ["score"], F.col("n") - F.col("p"), "upto")  # negatives up to this score
    won = F.col("p") * (F.col("upto") - (F.col("n") - F.col("p")) / 2.0)
    sums = below.agg(F.sum(won).alias("won"), F.sum("p").alias("positives"), F.sum(F.col("n") - F.col("p")).alias("negatives"))
    return sums.select(F.round(F.col("won") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0)), 6).alias("auc"), "positives", "negatives")


def list_entropy(ranked: DataFrame, categories: DataFrame) -> DataFrame:
    """EVL-9: user_id, entropy of the list's categories in bits."""
    c = ranked.join(categories, "item_id").groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy("user_id"))
    return c.withColumn("p", p).groupBy("user_id").agg(F.round(-F.sum(F.col("p") * F.log2(F.col("p") + 1e-9)), 6).alias("entropy"))


def popularity_bias(ranked: DataFrame, train: DataFrame) -> DataFrame:
    """EVL-10: mean popularity of what is recommended and of the catalogue, their ratio, and the share of the catalogue that is shown."""
    pop = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    shown = ranked.join(pop, "item_id", "left").agg(F.avg(F.coalesce("n", F.lit(0))).alias("arp"), F.countDistinct("item_id").alias("shown"))
    every = pop.agg(F.avg("n").alias("mean"), F.count(F.lit(1)).alias("items"))
    return shown.crossJoin(every).select(F.round("arp", 6).alias("arp"), F.round("mean", 6).alias("catalogue_mean"), F.round(F.col("arp") / F.col("mean"), 6).alias("ratio"), F.round(F.col("shown") / F.col("items"), 6).alias("coverage"))


def weighted(cf: DataFrame, content: DataFrame, alpha: float) -> DataFrame:
    """RNK-8, RNK-9: user_id, item_id, score: alpha times one model's score plus the rest of the other's; 0 where a model has none."""
    a, b = cf.select("user_id", "item_id", F.col("score").alias("a")), content.select("user_id", "item_id", F.col("score").alias("b"))
    none = F.lit(0.0)
    return a.join(b, ["user_id", "item_id"], "full_outer").select("user_id", "item_id", (alpha * F.coalesce("a", none) + (1 - alpha) * F.coalesce("b", none)).alias("score"))


def bias_flags(bias: DataFrame) -> DataFrame:
    """EVL-10: popularity_bias() and whether what is shown is over twice, or five times, as popular as the catalogue."""
    return bias.withColumn("over_2", F.col("ratio") > 2).withColumn("over_5", F.col("ratio") > 5)
