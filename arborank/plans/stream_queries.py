"""Streams over the event table: each query runs its stream to the end and reads what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import scoring as S
from ..sources import sinks
from ..sources.bindings import Tables, reading_history
from ..sources.storage import shared_dir
from ..streaming import streams
from .registry import query


def event_stream(t: Tables) -> DataFrame:
    rows = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(rows: DataFrame, mode: str, what: str) -> DataFrame:
    """All batches of a stream, with their number as `batch`, written to the shared folder and read from there."""
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession, what)

    def keep(batch: DataFrame, number: int) -> None:
        sinks.append(batch.withColumn("batch", F.lit(number)), path)

    stream = rows.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", shared_dir(spark, f"{what}-state")).trigger(availableNow=True)
    stream.start().awaitTermination()
    return spark.read.parquet(path)


@query("""select user_id, string_agg(event_id::varchar, ',' order by ts desc, event_id desc) as items from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rk from events) where rk <= 10 group by 1""")
def stream_last_items(t: Tables):
    """STR-5: the last ten events of each user, held as state; the last update of each user counts."""
    found = finished(streams.last_items(event_stream(t).select("user_id", F.col("event_id").alias("item"), "ts"), 10), "update", "last-items")
    last = found.groupBy("user_id").agg(F.max_by("items", "batch").alias("items"))
    return last.select("user_id", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("select distinct event_id from events")
def stream_dedup(t: Tables):
    """STR-4: each event twice in the stream, once in what comes out."""
    rows = event_stream(t).select("event_id", "ts")
    return finished(streams.first_of_each(rows.unionByName(rows), ["event_id"]).select("event_id"), "append", "dedup").select("event_id")


#: What a stream in append mode has given back at its end: windows that ended an hour before the last event.
CLOSED = "(select date_trunc('milliseconds', max(ts)) - interval 1 hour from events)"


@query(
    f"""with g as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as fresh from events),
    s as (select user_id, count(*)::bigint as n, min(ts) as start, max(ts) as stop from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from g) group by user_id, s)
    select * from s where stop + interval 30 minute <= {CLOSED}"""
)
def stream_sessions_closed(t: Tables):
    """STR-1 as a stream: each session once it has ended."""
    found = finished(streams.sessions(event_stream(t)), "append", "sessions")
    return found.select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"))


@query(
    f"""select start, event_type, n, value from (select time_bucket(interval 15 minute, ts) - to_minutes(k::int * 15) as start, event_type, count(*)::bigint as n, round(sum(value), 4) as value from events, range(0, 4) r(k) group by 1, 2)
    where start + interval 1 hour <= {CLOSED}"""
)
def stream_trending_closed(t: Tables):
    """STR-2 as a stream: each hour's window every 15 minutes, once it has ended."""
    found = finished(streams.trending(event_stream(t)), "append", "trending")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query(f"select start, event_type, n from (select date_trunc('hour', ts) as start, event_type, count(*)::bigint as n from events group by 1, 2) where start + interval 1 hour <= {CLOSED}")
def stream_hourly_closed(t: Tables):
    """STR-3 as a stream."""
    found = finished(streams.hourly(event_stream(t)), "append", "hourly")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


SESSIONS = "g as (select user_id, item, ts, event_id, case when lag(ts) over (partition by user_id order by ts) is null or ts - lag(ts) over (partition by user_id order by ts) > interval 30 minute then 1 else 0 end as fresh from vecread), s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as k from g), a as (select *, row_number() over (partition by user_id, k order by ts desc, event_id desc) - 1 as age, min(ts) over (partition by user_id, k) as start from s)"


@query(f"""with {SESSIONS},
    x as (select user_id, start, pow(0.9, age) as wt, unnest(embedding::double[]) as x, unnest(range(0, 64)) as dim from a join embeddings on vec_id = item where age < 10) select user_id, start, dim::int as dim, round(sum(x * wt) / sum(wt), 6) as value from x group by 1, 2, 3""", ("vecread",))
def session_profiles(t: Tables):
    """STR-1 with EMB-7: of each session the mean of its last ten vectors, each older one by 0.9 lighter."""
    rows = reading_history(t, "embeddings").withColumn("ts", F.col("ts").cast("timestamp"))
    found = streams.session_items(rows).select("user_id", "start", F.posexplode(F.slice("items", 1, 10)).alias("age", "item"))
    vectors = t.embeddings.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("item"), X.doubles("embedding").alias("v"))
    size = (vectors.select(F.size("v")).first() or [1])[0]
    weight = F.pow(F.lit(0.9), F.col("age").cast("double"))
    each = found.join(vectors, "item").groupBy("user_id", "start")  # a vector is one row until its session has its mean
    mean = each.agg(F.array(*[F.sum(F.get("v", F.lit(d)) * weight) for d in range(size)]).alias("v"), F.sum(weight).alias("w"))
    rows = mean.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.posexplode(F.transform("v", lambda x: x / F.col("w"))).alias("dim", "value"))
    return rows.withColumn("value", X.r6(F.col("value")))


@query("""with n as (select event_type, count(*) as n from events group by 1),
    r as (select event_type, n, row_number() over (order by n desc, event_type) as k from n) select 0::bigint as place, '## Events' as line union all select 1, '' union all select 2, '| event_type | n |' union all select 3, '|---|---|' union all select 3 + k, '| ' || event_type || ' | ' || n || ' |' from r""")
def markdown_report(t: Tables):
    """SNK-8: a small table as the lines of a report."""
    counts = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type")
    lines = sinks.markdown(counts, "Events").split("\n")
    return t.spark.createDataFrame(list(enumerate(lines)), "place bigint, line string")


@query("""with p as (select sqrt(sum(y * y) over (partition by vec_id)) as l, vec_id, k, y from (select vec_id, k, sum(x * (('0x' || substr(md5(dim || ':' || k || ':42'), 1, 8))::bigint / 4294967296.0 - 0.5) / 8) as y from (select vec_id, unnest(embedding::double[]) as x, unnest(range(0, len(embedding))) as dim from embeddings), range(0, 8) r(k) group by 1, 2))
    select vec_id, k::int as dim, round(0.1 * greatest(-1, least(1, case when l > 0 then y / l else 0 end)), 6) as value from p""")
def projected_vectors(t: Tables):
    """EMB-15: all steps; hashed directions over the root of the dimension, length 1, between -1 and 1, a tenth."""
    return S.projected(t.embeddings, 8).withColumn("value", X.r6(F.col("value")))
