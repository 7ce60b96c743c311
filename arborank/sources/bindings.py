"""Logical views of a recommendation data set over the order, event and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A total order of purchases.
ORDER = ["ts", "o_orderkey", "l_linenumber", "item_id", "l_suppkey", "l_extendedprice"]


class Tables:
    """Reads tables of one folder on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def purchases(t: Tables) -> DataFrame:
    """One row an order line: user_id, item_id, ts, reactions, and what makes their order total."""
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("reactions"), "l_linenumber", "l_suppkey", "l_extendedprice")
    return lines.join(orders, "o_orderkey")


def interactions(t: Tables) -> DataFrame:
    """First purchase of each (user, item): user_id, item_id, ts, reactions."""
    return first_by(purchases(t), ["user_id", "item_id"], [F.col(c) for c in ORDER]).select("user_id", "item_id", "ts", "reactions")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order. Written as an aggregate, so rows are reduced before the shuffle.

    Nulls in the order come last.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[x for c in order for x in (c.isNull(), c)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in rest])


def replies(t: Tables) -> DataFrame:
    """item_id, parent and reply columns side by side: each buyer of an item answers the buyer before; the first has no reply side."""
    w = Window.partitionBy("item_id").orderBy(*[c for c in ORDER if c != "item_id"])
    rows = purchases(t)
    return rows.select(
        "item_id",
        F.coalesce(F.lag("user_id").over(w), F.col("user_id")).alias("parent_user_id"),
        F.coalesce(F.lag("ts").over(w), F.col("ts")).alias("parent_ts"),
        F.coalesce(F.lag("reactions").over(w), F.col("reactions")).alias("parent_reactions"),
        F.when(F.lag("user_id").over(w).isNotNull(), F.col("user_id")).alias("reply_user_id"),
        F.when(F.lag("user_id").over(w).isNotNull(), F.col("ts")).alias("reply_ts"),
        F.when(F.lag("user_id").over(w).isNotNull(), F.col("reactions")).alias("reply_reactions"),
    )


def reading_history(t: Tables, items: str = "documents") -> DataFrame:
    """user_id, item, ts, event_id: the events as reads of documents or vectors."""
    n = getattr(t, items).count()
    return t.events.select("user_id", (F.col("event_id") % n).alias("item"), "ts", "event_id")


#: The same views in DuckDB SQL, for the twins.
SQL = {
    "purchases": "select o_custkey as user_id, l_partkey as item_id, o_orderdate as ts, l_quantity as reactions, o_orderkey, l_linenumber, l_suppkey, l_extendedprice from lineitem join orders on l_orderkey = o_orderkey",
    "inter": "select user_id, item_id, ts, reactions from (select *, row_number() over (partition by user_id, item_id order by ts, o_orderkey, l_linenumber, l_suppkey, l_extendedprice) as rn from purchases) where rn = 1",
    "replies": """select item_id, coalesce(lag(user_id) over w, user_id) as parent_user_id, coalesce(lag(ts) over w, ts) as parent_ts, coalesce(lag(reactions) over w, reactions) as parent_reactions,
        case when lag(user_id) over w is not null then user_id end as reply_user_id, case when lag(user_id) over w is not null then ts end as reply_ts, case when lag(user_id) over w is not null then reactions end as reply_reactions
        from purchases window w as (partition by item_id order by ts, o_orderkey, l_linenumber, l_suppkey, l_extendedprice)""",
    "docread": "select user_id, event_id % (select count(*) from documents) as item, ts, event_id from events",
    "vecread": "select user_id, event_id % (select count(*) from embeddings) as item, ts, event_id from events",
}
SQL_NEEDS = {"inter": ["purchases"], "replies": ["purchases"]}


def with_views(sql: str, *views: str) -> str:
    """The SQL with the named views before it."""
    names: list[str] = []
    for v in views:
        names += [x for x in (*SQL_NEEDS.get(v, []), v) if x not in names]
    head = ", ".join(f"{v} as ({SQL[v]})" for v in names)
    sql = sql.strip()
    if sql.lower().startswith("with recursive "):
        return f"with recursive {head}, {sql[15:]}"
    if sql.lower().startswith("with "):
        return f"with {head}, {sql[5:]}"
    return f"with {head} {sql}"
