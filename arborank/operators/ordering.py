"""Global row numbers without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written


#: Rows of a query set that are sent to the tasks at once.
BLOCK = 4096
#: Rows of a key up to which a self-join pairs them in one task.
WIDE_KEY = 1000


def ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df as a written table, sorted into ranges of the order, with the range's number as __part."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "numbered")


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the running sum of `value` in the order, which must be total.

    Rows are sorted by ranges, summed within each range, and shifted by the ranges before; only the ranges' sums meet, one row a range.
    """
    parts = ranges(df.withColumn("__value", value), order)
    sums = parts.groupBy("__part").agg(F.sum("__value").alias("__n"))
    before = sums.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    own = F.sum("__value").over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__own", "__before", "__value")


def numbered(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """df with its 1-based place in the order, which must be total; no task sees all rows."""
    return running(df, order, F.lit(1).cast("bigint"), name)


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """by and q0, q1 and so on: the exact quantiles of a number, between neighbours by their distance; nulls don't count.

    Equal values are counted first. The distinct values are sorted by ranges and their counts summed up (running()), so each quantile is the value whose ranks
    hold the wanted place; no task sees all values, nor all of a group.
    """
    by = by or []
    group = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(by)], F.lit(0).alias("all"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(group.alias("__by"), F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__count"))
    rows = written(running(counts, ["__by", "__v"], F.col("__count"), "__upto"), "ranked")
    groups = rows.groupBy("__by").agg(F.min(F.col("__upto") - F.col("__count")).alias("__base"), F.sum("__count").alias("__total"))
    rows = spread_join(rows, groups, ["__by"], F.xxhash64("__v"))
    first, after = F.col("__upto") - F.col("__count") - F.col("__base"), F.col("__upto") - F.col("__base")
    found = []
    for k, share in enumerate(shares):
        place = F.lit(float(share)) * (F.col("__total") - 1)
        at = lambda p: F.max(F.when((first <= p) & (p < after), F.col("__v").cast("double")))
        found += [at(F.floor(place)).alias(f"low{k}"), at(F.ceil(place)).alias(f"high{k}"), F.max(place).alias(f"place{k}")]
    ends = rows.groupBy("__by").agg(*found)
    part = lambda k: F.col(f"place{k}") - F.floor(f"place{k}")
    values = [(F.col(f"low{k}") * (1 - part(k)) + F.col(f"high{k}") * part(k)).alias(f"q{k}") for k in range(len(shares))]
    return ends.select(*[F.col(f"__by.c{k}").alias(c) for k, c in enumerate(by)], *values)


def by_block(queries: DataFrame, key: str, scored: Callable[[DataFrame], DataFrame], size: int = BLOCK) -> DataFrame:
    """What `scored` makes of the query rows, in blocks of about `size` rows by hash, so that what it broadcasts is bounded."""
    n = max(1, -(-queries.count() // size))
    found = [scored(queries if n == 1 else queries.filter(F.pmod(F.xxhash64(key), F.lit(n)) == k)) for k in range(n)]
    return reduce(DataFrame.unionByName, found)


def paired(rows: DataFrame, by: str, of: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a self-join of rows on `by`, and its keys.

    A value of `by` with over WIDE_KEY rows is cut in parts by the hash of `of` on the first side and repeated for each part on the second, so that
    its pairs are made in several tasks.
    """
    wide = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / WIDE_KEY).cast("int").alias("__parts")).filter("__parts > 1")
    rows = rows.join(wide, by, "left")
    parts = F.coalesce("__parts", F.lit(1))
    first = rows.withColumn("__part", F.pmod(F.xxhash64(of), parts).cast("int")).drop("__parts")
    return first, rows.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts"), [by, "__part"]


#: A join key with more than this share of the rows, and this many rows, is hot; there are at most 1 / share of them.
HOT_SHARE, HOT_ROWS, HOT_PARTS = 0.001, 20_000, 32


def spread_join(rows: DataFrame, lookup: DataFrame, key: list[str], by: Column, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """rows joined (inner or left) with lookup, which has one row a key at most and shares no other column.

    The rows of a hot key are dealt over HOT_PARTS parts by the hash `by`, and its lookup row goes to each, so none must fit one task. rows are read twice
    and should be a table, or cheap, unless the sizes (key, __n) are given.
    """
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")) if sizes is None else sizes
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    if total <= HOT_ROWS:
        return rows.join(lookup, key, how)
    hot = written(sizes.filter(F.col("__n") > max(HOT_ROWS, HOT_SHARE * total)).select(*key, F.lit(True).alias("__hot")), "hot")
    if hot.isEmpty():
        return rows.join(lookup, key, how)
    hot = F.broadcast(hot)  # 1 / HOT_SHARE rows at most
    part = F.when(F.col("__hot"), F.pmod(by, F.lit(HOT_PARTS))).otherwise(F.lit(0)).cast("int")
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, key, "left").withColumn("__part", part).drop("__hot")
    right = lookup.join(hot, key, "left").withColumn("__part", F.explode(parts)).drop("__hot")
    return left.join(right, [*key, "__part"], how).drop("__part")


def met(one: DataFrame, other: DataFrame, keys: list[str], by: str) -> DataFrame:
    """one joined with other on the keys, where both may have many rows of a key; they share no other column.

    A key with over WIDE_KEY rows of `one` has those cut in parts by the hash of `by`, and the rows of `other` repeated for each part, so that its pairs are
    made in several tasks. Where no key is that wide, it is a plain join.
    """
    wide = written(one.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / WIDE_KEY).cast("int").alias("__parts")).filter("__parts > 1"), "wide")
    if wide.isEmpty():
        return one.join(other, keys)
    parts = F.coalesce("__parts", F.lit(1))
    left = one.join(wide, keys, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    right = other.join(wide, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [*keys, "__part"]).drop("__part")


def top_salted(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rk", salt: str = "id", parts: int = 32) -> DataFrame:
    """top_per() in two steps: within parts of each key by the hash of `salt` first, so that a key with very many rows fills several tasks."""
    part = F.pmod(F.xxhash64(salt), F.lit(parts)).cast("int")
    best = top_per(df.withColumn("__part", part), [*keys, "__part"], order, k, name).drop("__part", name)
    return top_per(best, keys, order, k, name)


def top_per(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rk") -> DataFrame:
    """The first k rows of each key, with their rank."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")).filter(F.col(name) <= k)
