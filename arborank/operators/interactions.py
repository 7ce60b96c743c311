"""From raw interactions to clean ones: roles, k-core, ids, histories, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import hash_unit
from ..sources.storage import written
from .ordering import numbered, running, top_per

#: Draws of a user in one round of negatives().
MOST_DRAWS = 1 << 18


def role_union(replies: DataFrame) -> DataFrame:
    """INT-1: parent and reply roles of a reply table as one interaction table; roles without a user go."""
    parent = replies.select(F.col("parent_user_id").alias("user_id"), "item_id", F.col("parent_ts").alias("ts"), F.col("parent_reactions").alias("reactions"))
    reply = replies.select(F.col("reply_user_id").alias("user_id"), "item_id", F.col("reply_ts").alias("ts"), F.col("reply_reactions").alias("reactions"))
    return parent.unionByName(reply).filter("user_id is not null and item_id is not null")


def social_edges(replies: DataFrame) -> DataFrame:
    """INT-3: who answers whom, and how often; nobody answers themselves."""
    known = replies.filter("reply_user_id is not null and parent_user_id is not null and reply_user_id <> parent_user_id")
    return known.groupBy(F.col("reply_user_id").alias("src"), F.col("parent_user_id").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Distinct edges in both directions."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def k_core(pairs: DataFrame, user_least: int, item_least: int, most_rounds: int = 100) -> DataFrame:
    """INT-5: (user_id, item_id) until every user has `user_least` and every item `item_least` rows.

    Each round drops users and items together and is written, so its lineage is cut.
    """
    now = written(pairs.select("user_id", "item_id"), "kcore")
    n = now.count()
    for _ in range(most_rounds):
        users = now.groupBy("user_id").count().filter(F.col("count") >= user_least).select("user_id")
        items = now.groupBy("item_id").count().filter(F.col("count") >= item_least).select("item_id")
        now = written(now.join(users, "user_id", "left_semi").join(items, "item_id", "left_semi").select("user_id", "item_id"), "kcore")
        left = now.count()
        if left == n:
            return now
        n = left
    raise RuntimeError(f"no fixpoint in {most_rounds} rounds")


def dense_ids(values: DataFrame, column: str) -> DataFrame:
    """INT-6, INT-7: raw_id and idx from 0 in the order of the ids."""
    ids = values.select(F.col(column).alias("raw_id")).filter("raw_id is not null").distinct()
    return numbered(ids, ["raw_id"]).select("raw_id", (F.col("rn") - 1).alias("idx"))


def last_reads(history: DataFrame, n: int) -> DataFrame:
    """INT-8, WIN-4: the last n items of each user; rank 1 is the latest."""
    return top_per(history, ["user_id"], [F.desc("ts"), F.desc("event_id")], n, "rank").select("user_id", "rank", "item")


def with_count(df: DataFrame, key: str, least: int = 0, most: int | None = None) -> DataFrame:
    """INT-10, INT-11: the keys that have from `least` to `most` rows, with their numbers."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return n if most is None else n.filter(F.col("n") <= most)


def split_hash(pairs: DataFrame, seed: int = 42, share: float = 0.8) -> DataFrame:
    """SPL-1: a reproducible random split by hash."""
    return pairs.withColumn("split", F.when(hash_unit("user_id", "item_id", F.lit(seed)) < share, "train").otherwise("test"))


def split_time(pairs: DataFrame, share: float = 0.8) -> DataFrame:
    """SPL-2: the first share of all rows by time is for training."""
    rows = numbered(pairs, ["ts", "user_id", "item_id"])
    return rows.withColumn("split", F.when(F.col("rn") <= F.floor(F.lit(share) * rows.count()), "train").otherwise("test")).drop("rn")


def split_per_user(pairs: DataFrame, seed: int = 42, share: float = 0.2) -> DataFrame:
    """SPL-3, SPL-5: of each user with two rows or more, max(1, share) rows by hash order are for testing."""
    w = Window.partitionBy("user_id")
    rank = F.row_number().over(w.orderBy(hash_unit("user_id", "item_id", F.lit(seed)), "item_id"))
    n = F.count(F.lit(1)).over(w)
    test = (n >= 2) & (rank <= F.greatest(F.lit(1), F.floor(n * share)))
    return pairs.withColumn("split", F.when(test, "test").otherwise("train"))


def split_fifths(pairs: DataFrame, least: int = 2, seed: int = 42) -> DataFrame:
    """SPL-5: of each user with `least` rows or more, the first four fifths by hash order (rounded down) are for training; where that leaves none for testing, the last one is."""
    w = Window.partitionBy("user_id")
    rank = F.row_number().over(w.orderBy(hash_unit("user_id", "item_id", F.lit(seed)), "item_id"))
    rows = pairs.withColumn("__rank", rank).withColumn("__n", F.count(F.lit(1)).over(w)).filter(F.col("__n") >= least)
    train = F.floor(F.col("__n") * 0.8)
    test = (F.col("__rank") > train) | ((train == F.col("__n")) & (F.col("__n") > 1) & (F.col("__rank") == F.col("__n")))
    return rows.withColumn("split", F.when(test, "test").otherwise("train")).drop("__rank", "__n")


def split_last_out(pairs: DataFrame) -> DataFrame:
    """SPL-4: the last row of each user with two rows or more is for testing."""
    w = Window.partitionBy("user_id")
    test = (F.row_number().over(w.orderBy(F.desc("ts"), F.desc("item_id"))) == 1) & (F.count(F.lit(1)).over(w) >= 2)
    return pairs.withColumn("split", F.when(test, "test").otherwise("train"))


def negatives(pairs: DataFrame, items: DataFrame, users: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """SMP-1, SMP-3: for each of the users n items that it has no row with: user_id, item_id.

    The d-th draw of a user is an item number by the hash of user and d; draws of own or earlier items are rejected, and the first n of
    the others count. A user is one row with the numbers of its own items and of those found so far; its draws are made, rejected and cut within the row, so only what is
    found becomes rows. Users who lack some draw on, twice as many as before (MOST_DRAWS at most in a round), until they have n or all that are free.
    """
    pairs = written(pairs.select("user_id", "item_id").distinct(), "negatives")
    numbers = written(dense_ids(items, "item_id").withColumnRenamed("raw_id", "item_id"), "negatives")
    total, first, draws, done = numbers.count(), 1, 2 * n, None
    # items that can't be drawn count as own rows all the same
    own = pairs.join(numbers, "item_id", "left").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list("idx").alias("own"))
    none = F.array().cast("array<bigint>")
    wanting = users.select("user_id").distinct().join(own, "user_id", "left")
    wanting = wanting.select("user_id", F.least(F.lit(n), total - F.coalesce("n", F.lit(0))).cast("int").alias("want"), F.coalesce("own", none).alias("own"), none.alias("found"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, but much work each
    wanting = written(wanting.filter("want > 0").repartition(parts, "user_id"), "negatives")
    while not wanting.isEmpty():
        drawn = F.transform(F.sequence(F.lit(first), F.lit(first + draws - 1)), lambda d: F.floor(hash_unit(F.col("user_id"), d, F.lit(seed)) * total).cast("bigint"))
        found = F.slice(F.concat("found", F.array_except(F.array_except(drawn, "own"), "found")), F.lit(1), F.col("want"))  # array_except keeps the order and each number once
        got = written(wanting.withColumn("found", found), "negatives")
        whole = got.filter(F.size("found") == F.col("want")).select("user_id", F.explode("found").alias("idx"))
        done = whole if done is None else done.unionByName(whole)
        wanting = written(got.filter(F.size("found") < F.col("want")), "negatives")
        first, draws = first + draws, min(2 * draws, MOST_DRAWS)
    return pairs.limit(0) if done is None else done.join(numbers, "idx").select("user_id", "item_id")


def popular_negatives(pairs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """SMP-2: n draws for each user in proportion to popularity: draw, item_id; draws of own items go.

    Each item has as many slots as rows. A draw finds its item by the block of slots that it falls in, of about one item a block.
    """
    pop = written(pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("c")), "popular")
    sums = pop.agg(F.sum("c"), F.count(F.lit(1))).first()
    total, wide = sums[0] or 0, max(1, (sums[0] or 0) // max(1, sums[1]))
    top = running(pop, ["item_id"], F.col("c"), "high").withColumn("low", F.col("high") - F.col("c"))
    block = lambda c: F.floor(F.col(c) / wide) if isinstance(c, str) else F.floor(c / wide)
    held = top.select("item_id", "low", "high", F.explode(F.sequence(block("low"), block(F.col("high") - 1))).alias("block"))
    draws = pairs.select("user_id").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("slot", F.floor(hash_unit("user_id", "draw", F.lit(seed)) * total).cast("bigint"))
    found = draws.withColumn("block", block("slot")).join(held, "block").filter("slot >= low and slot < high")
    return found.select("user_id", "draw", "item_id").join(pairs.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def first_seen_ids(rows: DataFrame, column: str, by: str) -> DataFrame:
    """INT-6: raw_id and idx from 0 in the order in which the ids first occur by `by`, smaller ids first among equals."""
    ids = rows.select(F.col(column).alias("raw_id"), F.col(by).alias("at")).filter("raw_id is not null").groupBy("raw_id").agg(F.min("at").alias("at"))
    return numbered(ids, ["at", "raw_id"]).select("raw_id", (F.col("rn") - 1).alias("idx"))


def proxy_time(url):
    """INT-9: the number before ".html" that news sites count up, 0 where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(\d+)\.html", 1).try_cast("bigint"), F.lit(0))


def user_sample(rows: DataFrame, n: int = 500, seed: int = 42) -> DataFrame:
    """SMP-4: n users by hash."""
    users = rows.select("user_id").distinct()
    return users.orderBy(hash_unit("user_id", F.lit(seed)), "user_id").limit(n)


def mini_batches(pairs: DataFrame, size: int, epoch: int = 0, seed: int = 42) -> DataFrame:
    """SMP-6: pairs with their batch: all pairs once, in an order that each epoch draws anew."""
    rows = numbered(pairs.withColumn("__h", hash_unit("user_id", "item_id", F.lit(epoch), F.lit(seed))), ["__h", "user_id", "item_id"])
    return rows.withColumn("batch", F.floor((F.col("rn") - 1) / size)).drop("__h", "rn")


def known_social(replies: DataFrame, users: DataFrame, train: DataFrame) -> DataFrame:
    """Who answers whom under training items; users without an id go. users: user_id."""
    known = replies.join(train.select("item_id").distinct(), "item_id", "left_semi")
    for side in ("reply_user_id", "parent_user_id"):
        known = known.join(users.select(F.col("user_id").alias(side)).distinct(), side, "left_semi")
    return social_edges(known)
