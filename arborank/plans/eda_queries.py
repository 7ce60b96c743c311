"""Aggregations, windows, sets and the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators.ordering import numbered, quantiles, running, top_per
from ..sources.bindings import Tables, interactions, purchases, replies
from .registry import query


@query("""select count(*)::bigint as pairs, count(distinct user_id)::bigint as users, count(distinct item_id)::bigint as items, round(count(*) / (count(distinct user_id) * count(distinct item_id))::double, 6) as density, round(count(*) / count(distinct user_id)::double, 6) as per_user, round(count(*) / count(distinct item_id)::double, 6) as per_item from inter""", ("inter",))
def eda_density(t: Tables):
    n, u, i = F.count(F.lit(1)), F.countDistinct("user_id"), F.countDistinct("item_id")
    return interactions(t).agg(n.alias("pairs"), u.alias("users"), i.alias("items"), X.r6(n / (u * i)).alias("density"), X.r6(n / u).alias("per_user"), X.r6(n / i).alias("per_item"))


@query("""with d as (select user_id, count(*) as d from inter group by 1) select min(d)::bigint as least, max(d)::bigint as most, round(median(d), 6) as middle, round(avg(d), 6) as mean, round(stddev_samp(d), 6) as sd, round(avg((d < 30)::int), 6) as few from d""", ("inter",))
def eda_activity(t: Tables):
    d = interactions(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("d"))
    middle = quantiles(d, "d", [0.5]).first()
    return d.agg(F.min("d").alias("least"), F.max("d").alias("most"), X.r6(F.lit(middle and middle[0])).alias("middle"), X.r6(F.avg("d")).alias("mean"), X.r6(F.stddev_samp("d")).alias("sd"), X.r6(F.avg((F.col("d") < 30).cast("int"))).alias("few"))


@query("""with d as (select p_partkey as item_id, coalesce(n, 0) as degree from part left join (select item_id, count(*) as n from inter group by 1) on item_id = p_partkey) select degree::bigint as degree, count(*)::bigint as items from d group by 1""", ("inter",))
def eda_degree(t: Tables):
    """AGG-15: with the items that nobody bought."""
    n = interactions(t).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return t.part.select(F.col("p_partkey").alias("item_id")).join(n, "item_id", "left").select(F.coalesce("n", F.lit(0)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("items"))


@query("""with d as (select item_id, count(*) as n from inter group by 1),
    c as (select item_id, n::bigint as n, row_number() over (order by n desc, item_id) as rank, round(sum(n) over (order by n desc, item_id) / (sum(n) over ())::double, 6) as share from d) select * from c""", ("inter",))
def eda_pareto(t: Tables):
    """WIN-2, WIN-3: rank and cumulative share of items."""
    d = interactions(t).groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).withColumn("less", -F.col("n"))
    rows = running(numbered(d, ["less", "item_id"], "rank").drop("less"), ["rank"], F.col("n"), "sum")
    total = rows.agg(F.sum("n")).first()[0] or 0
    return rows.select("item_id", "n", "rank", X.r6(F.col("sum") / F.lit(total)).alias("share"))


@query("""select source, count(*)::bigint as n, round(avg(length(text)), 6) as mean, round(median(length(text)), 6) as middle, max(length(text))::bigint as most, round(stddev_samp(length(text)), 6) as sd from documents group by 1""")
def eda_lengths(t: Tables):
    rows = t.documents.select("source", F.length("text").alias("chars"))
    n = F.col("chars")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), X.r6(F.avg(n)).alias("mean"), F.max(n).cast("bigint").alias("most"), X.r6(F.stddev_samp(n)).alias("sd"))
    middles = quantiles(rows, "chars", [0.5], ["source"]).select(F.col("source").alias("s"), X.r6(F.col("q0")).alias("middle"))
    return sizes.join(middles, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


@query("with a as (select item_id, min(l_suppkey) as author from purchases group by 1) select author, count(*)::bigint as n from a group by 1 order by n desc, author limit 20", ("purchases",))
def eda_authors(t: Tables):
    """AGG-8; the limit is the report's."""
    a = purchases(t).groupBy("item_id").agg(F.min("l_suppkey").alias("author"))
    return a.groupBy("author").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "author").limit(20)


@query("""select p_type as category, count(item_id)::bigint as n, count(distinct item_id)::bigint as items, round(coalesce(avg(reactions), 0), 6) as mean, coalesce(sum(reactions), 0)::double as total from part left join inter on item_id = p_partkey group by 1""", ("inter",))
def eda_category(t: Tables):
    rows = t.part.select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("category")).join(interactions(t).withColumn("hit", F.col("item_id")), "item_id", "left")
    return rows.groupBy("category").agg(F.count("hit").alias("n"), F.countDistinct("hit").alias("items"), X.r6(F.coalesce(F.avg("reactions"), F.lit(0.0))).alias("mean"), F.coalesce(F.sum("reactions"), F.lit(0)).cast("double").alias("total"))


@query("""with b as (select p_brand, count(*) as n from part group by 1),
    r as (select *, row_number() over (order by n desc, p_brand) as rk from b) select case when rk <= 10 then p_brand else 'Others' end as brand, sum(n)::bigint as n from r group by 1""")
def eda_others(t: Tables):
    """AGG-11: the ten largest and the rest. The window is over categories, not rows."""
    b = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    r = b.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("n"), "p_brand")))
    return r.groupBy(F.when(F.col("rk") <= 10, F.col("p_brand")).otherwise("Others").alias("brand")).agg(F.sum("n").alias("n"))


@query("""with p as (select quantile_cont(l_extendedprice, 0.99) as p from lineitem) select round(any_value(p), 6) as p99, count(*)::bigint as n, round(avg(l_extendedprice), 6) as mean from lineitem, p where l_extendedprice <= p""")
def eda_p99(t: Tables):
    p = quantiles(t.lineitem, "l_extendedprice", [0.99]).first()
    p = p and p[0]
    return t.lineitem.filter(F.col("l_extendedprice") <= F.lit(p)).agg(X.r6(F.lit(p)).alias("p99"), F.count(F.lit(1)).alias("n"), X.r6(F.avg("l_extendedprice")).alias("mean"))


@query("select least(floor(w * 5), 24)::int as bucket, count(*)::bigint as n from (select 1 + ln(1 + reactions::double) as w from inter) group by 1", ("inter",))
def eda_edge_weights(t: Tables):
    w = 1 + F.log1p(F.col("reactions").cast("double"))
    return interactions(t).groupBy(F.least(F.floor(w * 5), F.lit(24)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""select 'interacts' as relation, count(*)::bigint as edges, count(distinct user_id)::bigint as sources, round(count(*) / count(distinct user_id)::double, 6) as degree from inter union all select 'answers', count(*)::bigint, count(distinct src)::bigint, round(count(*) / count(distinct src)::double, 6) from (select distinct reply_user_id as src, parent_user_id as dst from replies where reply_user_id <> parent_user_id)""", ("inter", "replies"))
def eda_tiers(t: Tables):
    a = interactions(t).select(F.lit("interacts").alias("relation"), F.col("user_id").alias("src"))
    b = replies(t).filter("reply_user_id <> parent_user_id").select("reply_user_id", "parent_user_id").distinct().select(F.lit("answers").alias("relation"), F.col("reply_user_id").alias("src"))
    n, s = F.count(F.lit(1)), F.countDistinct("src")
    return a.unionByName(b).groupBy("relation").agg(n.alias("edges"), s.alias("sources"), X.r6(n / s).alias("degree"))


@query("""select count(*)::bigint as n, count(*) filter (where reply_user_id is null)::bigint as no_reply, count(distinct parent_user_id)::bigint as parents, round(avg((reply_user_id is not null)::int), 6) as answered from replies""", ("replies",))
def eda_nulls(t: Tables):
    r = F.col("reply_user_id")
    return replies(t).agg(F.count(F.lit(1)).alias("n"), F.count_if(r.isNull()).alias("no_reply"), F.countDistinct("parent_user_id").alias("parents"), X.r6(F.avg(r.isNotNull().cast("int"))).alias("answered"))


@query("select item_id, parent_user_id, count(*)::bigint as n, count(reply_user_id)::bigint as answers from replies group by 1, 2", ("replies",))
def eda_reply_depth(t: Tables):
    return replies(t).groupBy("item_id", "parent_user_id").agg(F.count(F.lit(1)).alias("n"), F.count("reply_user_id").alias("answers"))


@query("""select year(o_orderdate)::int as year, o_orderstatus as status, count(*)::bigint as n, grouping_id(o_orderstatus)::int as total from orders group by rollup (year(o_orderdate), o_orderstatus) having year(o_orderdate) is not null""")
def eda_years(t: Tables):
    """AGG-13, AGG-14: a row for each year and status, and for each year in all."""
    rows = t.orders.select(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"))
    return rows.rollup("year", "status").agg(F.count(F.lit(1)).alias("n"), F.grouping("status").cast("int").alias("total")).filter("year is not null")


@query("""select label, count(*)::bigint as n, round(avg(nn), 6) as mean, round(min(nn), 6) as least, round(max(nn), 6) as most from (select label, sqrt(list_dot_product(embedding::double[], embedding::double[])) as nn from embeddings) group by 1""")
def eda_feature_norms(t: Tables):
    n = X.norm(X.doubles("embedding"))
    return t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n"), X.r6(F.avg(n)).alias("mean"), X.r6(F.min(n)).alias("least"), X.r6(F.max(n)).alias("most"))


@query("select item_id, n, total from (select item_id, count(*)::bigint as n, sum(reactions)::double as total from inter group by 1) order by total desc, item_id limit 20", ("inter",))
def eda_engagement(t: Tables):
    """AGG-5, AGG-10; the limit is the report's."""
    return interactions(t).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("reactions").cast("double").alias("total")).orderBy(F.desc("total"), "item_id").limit(20)


@query("""with top as (select user_id from inter group by 1 order by count(*) desc, user_id limit 15) select user_id, item_id from (select user_id, item_id, row_number() over (partition by user_id order by reactions desc, item_id) as rk from inter where user_id in (select user_id from top)) where rk <= 20""", ("inter",))
def ego_subgraph(t: Tables):
    """SRT-3: the 15 busiest users with 20 items each; the limits are the picture's."""
    rows = interactions(t)
    busiest = rows.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").limit(15).select("user_id")
    return top_per(rows.join(F.broadcast(busiest), "user_id", "left_semi"), ["user_id"], [F.desc("reactions"), F.col("item_id")], 20).select("user_id", "item_id")


@query("""with a as (select item_id from inter where user_id % 2 = 0),
    b as (select item_id from inter where user_id % 2 = 1) select 'both' as kind, item_id from (select * from a intersect select * from b) union all select 'only even', item_id from (select * from a except select * from b) union all select 'only odd', item_id from (select * from b except select * from a)""", ("inter",))
def set_operations(t: Tables):
    """SET-1 to SET-4."""
    rows = interactions(t)
    a, b = (rows.filter(f"user_id % 2 = {k}").select("item_id") for k in (0, 1))
    kinds = [("both", a.intersect(b)), ("only even", a.subtract(b)), ("only odd", b.subtract(a))]
    out = None
    for kind, df in kinds:
        part = df.select(F.lit(kind).alias("kind"), "item_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("""select user_id, count(*)::bigint as n, min(ts) as start, max(ts) as stop from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as fresh from events)) group by user_id, s""")
def stream_sessions(t: Tables):
    """STR-1 as a batch: a session ends when 30 minutes pass without an event."""
    from ..streaming.streams import sessions

    return sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp"))).select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"))


@query("select time_bucket(interval 15 minute, ts) - to_minutes(k::int * 15) as start, event_type, count(*)::bigint as n, round(sum(value), 4) as value from events, range(0, 4) r(k) group by 1, 2")
def stream_trending(t: Tables):
    """STR-2 as a batch: an hour's window every 15 minutes."""
    from ..streaming.streams import trending

    return trending(t.events.withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("select date_trunc('hour', ts) as start, event_type, count(*)::bigint as n from events group by 1, 2")
def stream_hourly(t: Tables):
    """STR-3 as a batch."""
    from ..streaming.streams import hourly

    return hourly(t.events.withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("select user_id, event_type, min(event_id) as event_id, min(ts) as ts from events group by 1, 2")
def stream_first_seen(t: Tables):
    """STR-4 as a batch: what comes first of each key."""
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.min("ts").alias("ts"))
