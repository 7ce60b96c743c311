"""Edge tables from interactions. Edges are (src, dst, w) rows; nothing is ever held as a dense matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written
from .ordering import met, paired, spread_join


def reaction_weight(reactions, decay=None):
    """1 + ln(1 + reactions), times a decay if given."""
    w = 1 + F.log1p(F.greatest(reactions.cast("double"), F.lit(0.0)))
    return w if decay is None else w * decay


def bipartite(train: DataFrame, now: str | None = None, decay_lambda: float = 0.0) -> DataFrame:
    """User to item edges by reactions; with `now` they fade by exp(-lambda * days)."""
    decay = F.exp(-F.lit(decay_lambda) * F.datediff(F.lit(now).cast("date"), F.col("ts"))) if now and decay_lambda else None
    return train.select(F.col("user_id").alias("src"), F.col("item_id").alias("dst"), reaction_weight(F.col("reactions"), decay).alias("w"))


def shared_interest(train: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of users with `least` items or more in common, once a pair (src < dst), by an equal self-join on the item."""
    one, other, keys = paired(train.select("item_id", "user_id"), "item_id", "user_id")
    a, b = one.select(*keys, F.col("user_id").alias("src")), other.select(*keys, F.col("user_id").alias("dst"))
    return a.join(b, keys).filter("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def user_category(train: DataFrame, categories: DataFrame) -> DataFrame:
    """How often a user meets a category. categories: item_id, category."""
    return train.join(categories, "item_id").groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"))


def author_of(lines: DataFrame) -> DataFrame:
    """Item to author, the lowest supplier seen."""
    return lines.groupBy("item_id").agg(F.min("l_suppkey").alias("author"))


#: Items of a class in one list, and pairs that a task makes of lists.
LIST_ITEMS, TASK_PAIRS = 1024, 50_000_000


def listed(members: DataFrame) -> DataFrame:
    """class, items: the members (class, item_id) in sorted lists, LIST_ITEMS long at most."""
    size = members.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / LIST_ITEMS).alias("__n"))
    number = F.pmod(F.xxhash64("item_id"), F.col("__n"))
    lists = members.join(size, "class").groupBy("class", number.alias("__list")).agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    return written(lists.select("class", "items"), "lists")


def crossed(links: DataFrame, one: DataFrame, other: DataFrame, kept: str = "true") -> DataFrame:
    """The pairs (src, dst, and what else the links have) of linked classes' lists (class, items) where `kept` holds of the lists. links: src, dst, ...

    What is joined and dealt over tasks are lists, and not the items or pairs. A pair comes into being in the task that gives it back, next to the others of its src, so a
    Parquet file of them stays small.
    """
    one, other = (lists.select(F.col("class").alias(c), F.col("items").alias(f"__{c}")) for c, lists in (("src", one), ("dst", other)))
    both = written(links.join(one, "src").join(other, "dst").drop("src", "dst").filter(kept), "lists")
    pairs = both.agg(F.sum(F.size("__src").cast("bigint") * F.size("__dst"))).first()[0] or 0
    tasks = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))
    more = [c for c in both.columns if c not in ("__src", "__dst")]
    rows = both.repartition(tasks, F.xxhash64("__src", "__dst")).select(F.explode("__src").alias("src"), "__dst", *more)
    return rows.select("src", F.explode("__dst").alias("dst"), *more)


def expanded(links: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs of items (src < dst, and what else the links have) whose classes are linked. links: src, dst, ...; members: class, item_id. Links count in one direction."""
    lists = listed(members)
    return crossed(links, lists, lists, "element_at(__src, 1) < element_at(__dst, -1)").filter("src < dst")


def near_days(published: DataFrame, day_window: int = 0, categories: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The links and members of expanded() for G5: a class is a day (with categories, a day and one of them), linked with those at most `day_window` days off."""
    rows = published if categories is None else published.join(categories, "item_id")
    keys = ["day"] if categories is None else ["day", "category"]
    members = written(rows.dropna(subset=keys).select("item_id", *keys), "members")
    class_of = lambda day: F.struct(day.alias("day"), *keys[1:]) if categories is not None else day
    days = F.explode(F.sequence(F.date_sub("day", day_window), F.date_add("day", day_window)))
    links = members.select(*keys).distinct().select(class_of(F.col("day")).alias("src"), days.alias("day"), *keys[1:]).select("src", class_of(F.col("day")).alias("dst"))
    return links, members.select(class_of(F.col("day")).alias("class"), "item_id")


def same_days(published: DataFrame, day_window: int = 0, categories: DataFrame | None = None) -> DataFrame:
    """Pairs of items (src < dst) whose days are at most `day_window` apart. With categories, only equal ones pair."""
    return expanded(*near_days(published, day_window, categories))


def same_day_stars(published: DataFrame) -> DataFrame:
    """G5 for components: each item of a day with several joined to the day's least item (src < dst), which reaches what the pairs of same_days() reach."""
    first = published.groupBy("day").agg(F.min("item_id").alias("src"))
    return spread_join(published.select("day", F.col("item_id").alias("dst")), first, ["day"], F.xxhash64("dst")).filter("src < dst").select("src", "dst")


def cross_category(user_categories: DataFrame, least: int) -> DataFrame:
    """Pairs of users (src < dst) with `least` categories or more in common."""
    one, other, keys = paired(user_categories.select("user_id", "category").distinct(), "category", "user_id")
    a, b = one.select(*keys, F.col("user_id").alias("src")), other.select(*keys, F.col("user_id").alias("dst"))
    return a.join(b, keys).filter("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def asked_cross_category(user_categories: DataFrame, asked: DataFrame, least: int) -> DataFrame:
    """G7 for the users asked for (user_id), each against all users: src (asked), dst, n."""
    sets = user_categories.filter("category is not null").groupBy("user_id").agg(F.sort_array(F.collect_set("category")).alias("class"))
    every = written(sets.select("class", F.col("user_id").alias("item_id")), "classes")
    own = every.join(asked.select(F.col("user_id").alias("item_id")).distinct(), "item_id", "left_semi")
    # users of equal categories are one class; the classes' pairs are counted, and the users' are made where they are given back
    a, b = (rows.select("class").distinct().select(F.col("class").alias(c), F.explode("class").alias("category")) for rows, c in ((own, "src"), (every, "dst")))
    links = met(a, b, ["category"], "src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return crossed(links, listed(own), listed(every)).filter("src <> dst").select("src", "dst", "n")


def cross_category_classes(user_categories: DataFrame, least: int) -> DataFrame:
    """G7 without writing out its pairs: user_id, class, linked, links, one row for each user.

    Users with equal categories are one class, named by its smallest user. linked: the classes (its own too) whose users share
    `least` categories or more with this one; links: how many other users that is.
    """
    sets = user_categories.groupBy("user_id").agg(F.sort_array(F.collect_set("category")).alias("categories"))
    classes = written(sets.groupBy("categories").agg(F.min("user_id").alias("class"), F.count(F.lit(1)).alias("members")), "classes")
    each = classes.select("class", F.explode("categories").alias("category"))
    a, b = each.select(F.col("class").alias("src"), "category"), each.select(F.col("class").alias("class"), "category")
    near = met(a, b, ["category"], "src").groupBy("src", "class").count().filter(F.col("count") >= least).join(classes.select("class", "members"), "class")
    own = F.sum(F.when(F.col("src") == F.col("class"), 1).otherwise(0))
    near = near.groupBy("src").agg(F.sort_array(F.collect_list("class")).alias("linked"), (F.sum("members") - own).alias("links"))
    named = classes.join(near, F.col("class") == F.col("src"), "left").select("categories", "class", "linked", "links")
    return sets.join(named, "categories").select("user_id", "class", F.coalesce("linked", F.array().cast("array<long>")).alias("linked"), F.coalesce("links", F.lit(0)).alias("links"))


def tenure(interactions: DataFrame, joined: DataFrame, now: str) -> DataFrame:
    """Features of a user's age in months (30 days) and activity. joined: user_id, join_date."""
    n = interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    age = F.greatest(F.datediff(F.lit(now).cast("date"), F.col("join_date")) / 30.0, F.lit(0.0))
    rows = joined.join(n, "user_id", "left").select("user_id", age.alias("age"), F.coalesce("n", F.lit(0)).alias("n"))
    return rows.select("user_id", (F.col("age") / 120).alias("f_age"), (F.col("age") > 60).cast("int").alias("f_old"), (F.col("age") < 6).cast("int").alias("f_new"), (F.log1p("age") / 5).alias("f_log_age"), (F.log1p(F.col("n").cast("double")) / 5).alias("f_log_n"))


def normalised(edges: DataFrame) -> DataFrame:
    """W / sqrt(degree(src) * degree(dst)) of weighted degrees over symmetric edges; 0 where a degree is 0."""
    degree = edges.groupBy("src").agg(F.sum("w").alias("d"))
    rows = edges.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
    return rows.select("src", "dst", F.when(F.col("d") * F.col("d2") > 0, F.col("w") / F.sqrt(F.col("d") * F.col("d2"))).otherwise(0.0).alias("w"))


def block_adjacency(reads: DataFrame, items: DataFrame, users: DataFrame, social_weight: float = 1.0) -> DataFrame:
    """One normalised adjacency of reads (user src, item dst, w), item-item edges (weight 1) and user-user edges (social_weight).

    An edge that occurs in several rows or directions is one edge.
    """

    def block(edges: DataFrame, kind: str, weight: float) -> DataFrame:
        a, b = (F.concat(F.lit(kind), F.col(c).cast("string")).alias(c) for c in ("src", "dst"))
        one = edges.select(a, b)
        return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("w", F.lit(float(weight)))

    return normalised(as_nodes(reads).unionByName(block(items, "i", 1.0)).unionByName(block(users, "u", social_weight)))


def day_adjacency(reads: DataFrame, days: DataFrame, users: DataFrame, social_weight: float = 1.0) -> DataFrame:
    """block_adjacency() where the item-item edges are those of same_days(): an item's degree is known from its day's size, so its edges are weighed in the task that gives them back.

    reads: src (user), dst (item), w, a table; days: item_id, day; users: src, dst, in any direction.
    """
    days = written(days.dropna(), "days")
    sizes = days.groupBy("day").agg((F.count(F.lit(1)) - 1).cast("double").alias("w"))
    near = spread_join(days, sizes, ["day"], F.xxhash64("item_id"))
    social = written(users.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "social")
    weight = F.lit(float(social_weight)).alias("w")
    of_users = reads.select(F.col("src").alias("id"), "w").unionByName(social.select(F.col("src").alias("id"), weight)).unionByName(social.select(F.col("dst").alias("id"), weight))
    of_items = reads.select(F.col("dst").alias("id"), "w").unionByName(near.select(F.col("item_id").alias("id"), "w"))
    user, item = (written(rows.groupBy("id").agg(F.sum("w").alias("d")), "degrees") for rows in (of_users, of_items))
    side = lambda rows, c: rows.select(F.col("id").alias(c), F.col("d").alias(f"__{c}"))

    def both_ways(rows: DataFrame, src: str, dst: str) -> DataFrame:
        """Edges of one direction with their degrees as normalised edges between nodes of both."""
        d = F.col("__src") * F.col("__dst")
        a, b = F.concat(F.lit(src), F.col("src").cast("string")), F.concat(F.lit(dst), F.col("dst").cast("string"))
        w = F.when(d > 0, F.col("w") / F.sqrt(d)).otherwise(0.0)
        ends = F.array(F.struct(a.alias("src"), b.alias("dst"), w.alias("w")), F.struct(b.alias("src"), a.alias("dst"), w.alias("w")))
        return rows.select(F.explode(ends).alias("e")).select("e.src", "e.dst", "e.w")

    read = reads.join(side(user, "src"), "src").join(side(item, "dst"), "dst")
    met_users = social.withColumn("w", weight).join(side(user, "src"), "src").join(side(user, "dst"), "dst")
    members = days.join(item.select(F.col("id").alias("item_id"), "d"), "item_id").select(F.col("day").alias("class"), F.struct("item_id", "d").alias("item_id"))
    pairs = expanded(days.select(F.col("day").alias("src"), F.col("day").alias("dst")).distinct(), members)
    same = pairs.select(F.col("src.item_id").alias("src"), F.col("dst.item_id").alias("dst"), F.col("src.d").alias("__src"), F.col("dst.d").alias("__dst"), F.lit(1.0).alias("w"))
    return both_ways(read, "u", "i").unionByName(both_ways(same, "i", "i")).unionByName(both_ways(met_users, "u", "u"))


def augmented(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges (src, dst, w) and those of another source that aren't among them."""
    return edges.unionByName(more.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "w"))


def rectangular(edges: DataFrame) -> DataFrame:
    """W / sqrt(row degree * column degree) of user to item edges; a degree of 0 counts as 1."""
    rows = edges.groupBy("src").agg(F.sum("w").alias("dr"))
    columns = edges.groupBy("dst").agg(F.sum("w").alias("dc"))
    one = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    return edges.join(rows, "src").join(columns, "dst").select("src", "dst", (F.col("w") / F.sqrt(one("dr") * one("dc"))).alias("w"))


def with_self_loops(edges: DataFrame) -> DataFrame:
    """Each node of the edges also points to itself with weight 1."""
    nodes = edges.select(F.col("src").alias("n")).unionByName(edges.select(F.col("dst").alias("n"))).distinct()
    return edges.unionByName(nodes.select(F.col("n").alias("src"), F.col("n").alias("dst"), F.lit(1.0).alias("w")))


def as_nodes(edges: DataFrame) -> DataFrame:
    """User to item edges as symmetric edges between nodes "u<id>" and "i<id>"."""
    u, i = F.concat(F.lit("u"), F.col("src").cast("string")), F.concat(F.lit("i"), F.col("dst").cast("string"))
    one = edges.select(u.alias("src"), i.alias("dst"), F.col("w").cast("double").alias("w"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def leaked(graph: DataFrame, train: DataFrame) -> DataFrame:
    """Edges of the graph that are no training pairs; must be empty."""
    return graph.join(train.select(F.col("user_id").alias("src"), F.col("item_id").alias("dst")), ["src", "dst"], "left_anti")


def minima(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, m), the least b of each a, and (a, __n), its number of edges."""
    rows = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("__n")), "minima")
    return rows.select("a", "m"), rows.select("a", "__n")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """AGG-18: node and label (the least node it reaches), by large-star and small-star rounds over written tables. A hub's edges are dealt over several tasks."""
    now = written(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "components")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, sizes = minima(both)
        up = written(spread_join(both, least.select("a", F.least("a", "m").alias("m")), ["a"], F.xxhash64("b"), sizes=sizes).filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "components")
        least, sizes = minima(up)
        down = spread_join(up, least, ["a"], F.xxhash64("b"), sizes=sizes).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = written(down.filter("a <> b").distinct(), "components")
        if now.groupBy("a").count().filter("count > 1").isEmpty() and now.select("b").join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
            return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
