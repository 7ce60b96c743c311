"""Interactions, ids, splits, samples and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import interactions as I
from ..sources.bindings import Tables, interactions, purchases, reading_history, replies
from .registry import query

HASH = "('0x' || substr(md5({}), 1, 8))::bigint / 4294967296.0"


@query("select user_id, item_id, ts, reactions from inter", ("inter",))
def interactions_dedup(t: Tables):
    return interactions(t)


def _rounds(n: int) -> str:
    parts = ["k0 as (select distinct user_id, item_id from purchases)"]
    for i in range(n):
        parts.append(f"k{i + 1} as (select k.* from k{i} k where user_id in (select user_id from k{i} group by 1 having count(*) >= 20) and item_id in (select item_id from k{i} group by 1 having count(*) >= 20))")
    return f"with {', '.join(parts)} select user_id, item_id from k{n}"


@query(_rounds(8), ("purchases",))
def kcore_20_20(t: Tables):
    return I.k_core(purchases(t).select("user_id", "item_id").distinct(), 20, 20)


@query("select user_id as raw_id, row_number() over (order by user_id) - 1 as idx from (select distinct user_id from purchases)", ("purchases",))
def id_map_users(t: Tables):
    return I.dense_ids(purchases(t), "user_id")


@query("select item_id as raw_id, row_number() over (order by item_id) - 1 as idx from (select distinct item_id from purchases)", ("purchases",))
def id_map_items(t: Tables):
    return I.dense_ids(purchases(t), "item_id")


@query("select user_id, rank, item from (select user_id, item, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from docread) where rank <= 10", ("docread",))
def user_history_last10(t: Tables):
    return I.last_reads(reading_history(t), 10)


@query("select user_id, count(*)::bigint as n, string_agg(item::varchar, ',' order by ts, event_id) as items from docread group by user_id", ("docread",))
def user_history_lists(t: Tables):
    rows = reading_history(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "item"))).alias("x"))
    return rows.select("user_id", "n", F.concat_ws(",", F.transform("x", lambda r: r["item"].cast("string"))).alias("items"))


@query("""select user_id, item_id, count(*)::bigint as n, sum(reactions)::double as reactions from (select parent_user_id as user_id, item_id, parent_reactions as reactions from replies union all select reply_user_id, item_id, reply_reactions from replies) where user_id is not null group by 1, 2""", ("replies",))
def role_union(t: Tables):
    return I.role_union(replies(t)).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("reactions").cast("double").alias("reactions"))


@query("select distinct user_id from (select parent_user_id as user_id from replies union all select reply_user_id from replies) where user_id is not null", ("replies",))
def role_users(t: Tables):
    return I.role_union(replies(t)).select("user_id").distinct()


@query("select reply_user_id as src, parent_user_id as dst, count(*)::bigint as n from replies where reply_user_id is not null and reply_user_id <> parent_user_id group by 1, 2", ("replies",))
def social_edges(t: Tables):
    return I.social_edges(replies(t))


@query("""with e as (select reply_user_id as src, parent_user_id as dst from replies where reply_user_id is not null and reply_user_id <> parent_user_id) select src, dst from e union select dst, src from e""", ("replies",))
def social_symmetric(t: Tables):
    return I.symmetric(I.social_edges(replies(t)))


@query("""select user_id, item_id, case when rn <= floor(0.8 * n) then 'train' else 'test' end as split from (select *, row_number() over (order by ts, user_id, item_id) as rn, count(*) over () as n from inter)""", ("inter",))
def split_time(t: Tables):
    return I.split_time(interactions(t)).select("user_id", "item_id", "split")


@query(f"select user_id, item_id, case when {HASH.format('''user_id || ':' || item_id || ':42' ''')} < 0.8 then 'train' else 'test' end as split from inter", ("inter",))
def split_hash(t: Tables):
    return I.split_hash(interactions(t)).select("user_id", "item_id", "split")


@query(f"""select user_id, item_id, case when n >= 2 and rn <= greatest(1, floor(n * 0.2)) then 'test' else 'train' end as split from (select *, row_number() over (partition by user_id order by {HASH.format('''user_id || ':' || item_id || ':42' ''')}, item_id) as rn, count(*) over (partition by user_id) as n from inter)""", ("inter",))
def split_per_user(t: Tables):
    return I.split_per_user(interactions(t)).select("user_id", "item_id", "split")


@query(f"""with r as (select user_id, item_id, row_number() over (partition by user_id order by {HASH.format("user_id || ':' || item_id || ':42' ")}, item_id) as rn, count(*) over (partition by user_id) as n from inter)
    select user_id, item_id, case when rn > floor(n * 0.8) then 'test' else 'train' end as split from r where n >= 2""", ("inter",))
def split_fifths(t: Tables):
    """SPL-5."""
    return I.split_fifths(interactions(t)).select("user_id", "item_id", "split")


@query("""select user_id, item_id, case when n >= 2 and rn = 1 then 'test' else 'train' end as split from (select *, row_number() over (partition by user_id order by ts desc, item_id desc) as rn, count(*) over (partition by user_id) as n from inter)""", ("inter",))
def split_last_out(t: Tables):
    return I.split_last_out(interactions(t)).select("user_id", "item_id", "split")


@query(f"""select user_id, item_id, case when h < 0.1 then 'val' when h < 0.2 then 'test' else 'train' end as split from (select *, {HASH.format('''user_id || ':' || item_id || ':7' ''')} as h from inter)""", ("inter",))
def split_link(t: Tables):
    """SPL-6: tenths by hash."""
    h = X.hash_unit("user_id", "item_id", F.lit(7))
    return interactions(t).select("user_id", "item_id", F.when(h < 0.1, "val").when(h < 0.2, "test").otherwise("train").alias("split"))


def drawn(users: str, pairs: str, n: int = 100, draws: int = 1600) -> str:
    """CTEs of negatives(): ng (user_id, item_id) for `users`, a table of user_id; `draws` is far beyond what any user needs."""
    return f"""nb as (select item_id, row_number() over (order by item_id) - 1 as idx, count(*) over () as tot from (select distinct item_id from {pairs})),
    dr as (select user_id, idx, min(draw) as draw from (select user_id, draw, floor({HASH.format("user_id || ':' || draw || ':42'")} * (select max(tot) from nb))::bigint as idx from {users}, range(1, {draws + 1}) r(draw)) group by 1, 2),
    ng as (select user_id, item_id from (select dr.user_id, nb.item_id, row_number() over (partition by dr.user_id order by dr.draw) as k from dr join nb using (idx) where not exists (select 1 from {pairs} x where x.user_id = dr.user_id and x.item_id = nb.item_id)) where k <= {n})"""


@query(f"with u as (select distinct user_id from inter), {drawn('u', 'inter')} select user_id, item_id from ng", ("inter",))
def negatives_100(t: Tables):
    """SMP-1, SMP-3 for all users."""
    pairs = interactions(t)
    return I.negatives(pairs, pairs, pairs, 100)


@query(f"""with p as (select item_id, count(*) as c from inter group by 1), s as (select item_id, sum(c) over (order by item_id) - c as low, sum(c) over (order by item_id) as high from p), tot as (select sum(c) as n from p),
    d as (select user_id, draw, floor({HASH.format('''user_id || ':' || draw || ':42' ''')} * (select n from tot))::bigint as slot from (select distinct user_id from inter), range(1, 6) r(draw))
    select user_id, draw::int as draw, item_id from d join s on slot >= low and slot < high where not exists (select 1 from inter x where x.user_id = d.user_id and x.item_id = s.item_id)""", ("inter",))
def negatives_popular(t: Tables):
    return I.popular_negatives(interactions(t), 5)


@query("select user_id, count(*)::bigint as n from inter group by 1 having count(*) >= 45", ("inter",))
def active_users(t: Tables):
    return I.with_count(interactions(t), "user_id", 45)


@query("select user_id, count(*)::bigint as n from inter group by 1 having count(*) <= 30", ("inter",))
def cold_users(t: Tables):
    return I.with_count(interactions(t), "user_id", 0, 30)


@query("select item_id, count(*)::bigint as n from inter group by 1", ("inter",))
def popularity(t: Tables):
    return I.with_count(interactions(t), "item_id")


@query("""select page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') as url, sha1(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')) as article_id from pages""")
def norm_url(t: Tables):
    """CLN-11, SRC-17."""
    return t.pages.select("page_id", X.plain_url(F.col("url")).alias("url"), F.sha1(X.plain_url(F.col("url"))).alias("article_id"))


RAW_IDS = "select event_id, case event_id % 8 when 0 then user_id || '.0' when 1 then user_id::varchar when 2 then 'N/A' when 3 then 'user' || user_id when 4 then 'nan' when 5 then 'NaN' when 6 then 'NO_COMMENT' else '' end as raw from events"


def raw_ids(t: Tables):
    """Ids as the logs spell them."""
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 8
    raw = F.when(k == 0, F.concat(u, F.lit(".0"))).when(k == 1, u).when(k == 2, "N/A").when(k == 3, F.concat(F.lit("user"), u)).when(k == 4, "nan").when(k == 5, "NaN").when(k == 6, "NO_COMMENT").otherwise("")
    return t.events.select("event_id", raw.alias("raw"))


@query(f"""select event_id, case when raw in ('', 'nan', 'NaN', 'N/A', 'NO_COMMENT') then null when try_cast(raw as double) is not null then cast(cast(trunc(try_cast(raw as double)) as bigint) as varchar) else raw end as id from ({RAW_IDS})""")
def clean_ids(t: Tables):
    """CLN-1 to CLN-3."""
    return raw_ids(t).select("event_id", X.real_id(F.col("raw")).alias("id"))


@query(f"select event_id, case when lower(raw) in ('', 'nan') then null when regexp_full_match(raw, '[0-9]+(\\.0)?') then split_part(raw, '.', 1) else raw end as id from ({RAW_IDS})")
def plain_ids(t: Tables):
    """CLN-1 alone: other texts than numbers stay, "N/A" among them."""
    return raw_ids(t).select("event_id", X.clean_id(F.col("raw")).alias("id"))


@query("select event_id, user_id from events where hour(ts) >= 12")
def valid_dates(t: Tables):
    """CLN-14: rows whose text holds a date."""
    text = F.when(F.hour("ts") >= 12, F.date_format("ts", "'on 'dd/MM/yyyy")).otherwise(F.date_format("ts", "'in 'MMMM"))
    return t.events.filter(X.day_in_text(text).isNotNull()).select("event_id", "user_id")


NOON = "timestamp '2024-03-01 12:00:00'"


@query(f"""with r as (select event_id, event_id % 8 as k, month(ts) as m, day(ts) as d, hour(ts) as h, minute(ts) as mi from events) select event_id, case k when 0 then {NOON} - to_hours((event_id % 48)::int) when 1 then {NOON} - to_minutes((event_id % 60)::int)
    when 2 then {NOON} - to_hours((event_id % 48)::int) when 3 then {NOON} - to_hours(7) when 4 then null when 5 then null
    else case when make_timestamp(2024, m, d, h, mi, 0) > {NOON} then make_timestamp(2023, m, d, h, mi, 0) else make_timestamp(2024, m, d, h, mi, 0) end end as at from r""")
def parse_dates(t: Tables):
    """TXT-21 on dates as the site spells them: alone and inside other text, with single-digit minutes and several spaces, and none at all."""
    k = F.col("event_id") % 8
    hours, minutes = (F.concat((F.col("event_id") % n).cast("string"), F.lit(s)) for n, s in ((48, "h trước"), (60, "p trước")))
    clock = F.concat(F.date_format("ts", "H:"), F.minute("ts").cast("string"), F.lit("  "), F.dayofmonth("ts").cast("string"), F.lit("/"), F.month("ts").cast("string"))
    raw = F.when(k == 0, hours).when(k == 1, minutes).when(k == 2, F.concat(F.lit("Tin: "), hours, F.lit(" - site"))).when(k == 3, "3p trước, 7h trước").when(k == 4, "30/2").when(k == 5, "nan").when(k == 6, F.concat(F.lit("Lúc "), clock, F.lit(" GMT+7"))).otherwise(clock)
    return t.events.select("event_id", X.relative_date(raw, F.lit("2024-03-01 12:00:00").cast("timestamp_ntz").cast("timestamp")).cast("timestamp_ntz").alias("at"))


@query("select event_id, cast(ts as date) as day, date_trunc('month', ts)::date as month, floor(date_diff('day', ts::date, date '2025-01-01') / 30.0)::int as months from events")
def join_months(t: Tables):
    """TXT-22, TXT-23: dd/mm/yyyy out of free text, its month and its age in months of 30 days."""
    text = F.concat(F.lit("Published on "), F.date_format("ts", "dd/MM/yyyy"), F.lit(" at noon"))
    day = X.day_in_text(text)
    return t.events.select("event_id", day.alias("day"), F.trunc(day, "month").alias("month"), F.floor(F.datediff(F.lit("2025-01-01").cast("date"), day) / 30.0).cast("int").alias("months"))


@query("""select json_extract_string(props, '$.k') as k, count(*)::bigint as n, sum(greatest(coalesce(try_cast(json_extract_string(props, '$.k') as double), 0), 0))::double as total from events group by 1""")
def props_count(t: Tables):
    """TXT-24, CLN-8: values out of JSON text."""
    k = F.get_json_object("props", "$.k")
    return t.events.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(X.non_negative(k)).alias("total"))


@query("select doc_id, text, source from (select doc_id, text, source, count(*) over (partition by source) as n from documents) where n >= 10 and doc_id in (select doc_id from labels)")
def known_and_frequent(t: Tables):
    """CLN-4, CLN-7: rows with a known key whose category has ten rows or more."""
    often = t.documents.groupBy("source").count().filter("count >= 10").select("source")
    return t.documents.join(often, "source", "left_semi").join(t.labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text", "source")


@query("""select doc_id, case lang when 'en' then 'English' when 'fr' then 'French' else lang end as lang, case source when 'src0' then 0 when 'src1' then 1 end::int as category_id, coalesce(nullif(text, ''), 'Untitled') as title from documents""")
def renamed(t: Tables):
    """CLN-6, CLN-9, CLN-12: names by lookup, ids with null for unknown ones, filled titles."""
    names = F.create_map(*[F.lit(x) for x in ("en", "English", "fr", "French")])
    ids = F.create_map(F.lit("src0"), F.lit(0), F.lit("src1"), F.lit(1))
    return t.documents.select("doc_id", F.coalesce(names[F.col("lang")], F.col("lang")).alias("lang"), ids[F.col("source")].alias("category_id"), F.coalesce(F.nullif("text", F.lit("")), F.lit("Untitled")).alias("title"))


@query("select text, min(doc_id) as doc_id from documents group by text")
def dedup_first(t: Tables):
    """CLN-5: of equal texts the first document."""
    return t.documents.groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@query("""select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, len(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1))::bigint as n_links, coalesce(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)[1], '') as first_link, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) as lang from pages""")
def html_title_links(t: Tables):
    """SRC-10, SRC-11."""
    links = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).cast("bigint").alias("n_links"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"))


@query("""select conv_id, turn, role, coalesce(lag(text) over (partition by conv_id order by turn), 'NO_COMMENT') as parent, text from (select conv_id, turn, role, min(text) as text from conversations group by 1, 2, 3)""")
def threaded_comments(t: Tables):
    """SRC-12: each turn beside the one it answers."""
    from pyspark.sql import Window

    rows = t.conversations.groupBy("conv_id", "turn", "role").agg(F.min("text").alias("text"))
    return rows.select("conv_id", "turn", "role", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("NO_COMMENT")).alias("parent"), "text")


@query("select page_id, url from pages where page_id not in (select doc_id from labels)")
def unseen_pages(t: Tables):
    """SRC-16: what has not been processed yet."""
    return t.pages.join(t.labels.select(F.col("doc_id").alias("page_id")), "page_id", "left_anti").select("page_id", "url")


@query("""select user_id, k::int as k, (first + to_years(k::int))::date as start, least((first + to_years((k + 1)::int))::date, last) as stop from (select user_id, min(ts)::date as first, max(ts)::date as last from purchases group by 1) p, range(0, 10) r(k) where (first + to_years(k::int))::date <= last""", ("purchases",))
def date_chunks(t: Tables):
    """SRC-18: each user's span in parts of a year."""
    span = purchases(t).groupBy("user_id").agg(F.min("ts").cast("date").alias("first"), F.max("ts").cast("date").alias("last"))
    parts = span.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.months_between("last", "first") / 12).cast("int"))))
    return parts.select("user_id", "k", F.add_months("first", F.col("k") * 12).alias("start"), F.least(F.add_months("first", (F.col("k") + 1) * 12), F.col("last")).alias("stop")).filter("start <= stop")


# ids, samples and edges of further kinds


@query("select item_id as raw_id, row_number() over (order by seen_at, item_id) - 1 as idx from (select item_id, min(ts) as seen_at from purchases group by 1)", ("purchases",))
def id_map_first_seen(t: Tables):
    """INT-6: in the order of first sight."""
    return I.first_seen_ids(purchases(t), "item_id", "ts")


@query("select user_id as raw_id, row_number() over (order by user_id) - 1 as idx from (select user_id from inter group by 1 having count(*) >= 40)", ("inter",))
def id_map_frequent(t: Tables):
    """INT-7: of users with enough rows (the reference asks for two, which all have here), by their ids."""
    return I.dense_ids(I.with_count(interactions(t), "user_id", 40), "user_id")


@query("select page_id, coalesce(try_cast(nullif(regexp_extract(url, '(\\d+)\\.html', 1), '') as bigint), 0) as proxy_time from pages")
def proxy_times(t: Tables):
    """INT-9."""
    return t.pages.select("page_id", I.proxy_time(F.col("url")).alias("proxy_time"))


@query(f"select user_id from (select distinct user_id from inter) order by {HASH.format("user_id || ':42'")}, user_id limit 500", ("inter",))
def user_sample(t: Tables):
    """SMP-4; the limit is the sample's."""
    return I.user_sample(interactions(t))


@query(f"select user_id, item_id, ((row_number() over (order by {HASH.format("user_id || ':' || item_id || ':1:42'")}, user_id, item_id) - 1) // 256)::bigint as batch from inter", ("inter",))
def mini_batches(t: Tables):
    """SMP-6: the second epoch's batches of 256 pairs."""
    return I.mini_batches(interactions(t).select("user_id", "item_id"), 256, epoch=1).select("user_id", "item_id", F.col("batch").cast("bigint").alias("batch"))


@query("""with tr as (select distinct item_id from inter where user_id % 3 = 0),
    u as (select user_id from inter group by 1 having count(*) >= 40) select reply_user_id as src, parent_user_id as dst, count(*)::bigint as n from replies where reply_user_id <> parent_user_id and item_id in (select item_id from tr) and reply_user_id in (select user_id from u) and parent_user_id in (select user_id from u) group by 1, 2""", ("inter", "replies"))
def g2a_social_train(t: Tables):
    """Replies under training items (those that every third user bought) between users that have an id (40 rows or more)."""
    pairs = interactions(t)
    return I.known_social(replies(t), I.with_count(pairs, "user_id", 40), pairs.filter("user_id % 3 = 0"))
