"""Tokens, TF-IDF, BM25 and text similarity over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import lexical as L
from ..operators.ordering import top_per
from ..sources.bindings import Tables, purchases, reading_history
from ..sources.storage import written
from .registry import query

STOP = ["the", "of", "and", "de", "la", "le", "der", "und", "el", "en"]
def _without(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', ' ', 'g')"


CLEAN = "text"
for _pattern in (X.TAGS, X.URLS, X.PUNCTUATION):
    CLEAN = _without(CLEAN, _pattern)
CLEAN = f"lower({CLEAN})"
STOPS = ", ".join(f"'{w}'" for w in STOP)
WORDS = f"words as (select doc_id, list_filter(string_split_regex({CLEAN}, '[ \\t\\n\\r\\f\\x0b]+'), lambda w: length(w) between 1 and 50 and w not in ({STOPS})) as ws from documents), post as (select doc_id, term, count(*)::bigint as tf from (select doc_id, unnest(ws) as term from words) group by 1, 2)"
TFIDF = f"{WORDS}, n as (select count(*) as n from documents), idf as (select term, ln((1.0 + n) / (1.0 + count(*))) + 1.0 as idf from post, n group by term, n having count(*) >= 2), raw as (select doc_id, term, tf * idf as w from post join idf using (term)), len as (select doc_id, sqrt(sum(w * w)) as len from raw group by 1), weights as (select doc_id, term, w / len as w from raw join len using (doc_id))"


def words(t: Tables):
    return X.tokens(X.cleaned(F.col("text")), STOP)


def posted(t: Tables):
    """Written, as most queries read it several times."""
    return written(L.postings(t.documents, words(t)), "postings")


def weighed(t: Tables):
    return L.tf_idf(posted(t), t.documents.count(), min_df=2)


@query(f"with {WORDS} select doc_id, term, tf from post")
def tokens_clean(t: Tables):
    return posted(t)


@query(f"""with {WORDS},
    b as (select doc_id, unnest(case when len(ws) >= 2 then list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) else [] end) as term from words) select doc_id, term, count(*)::bigint as tf from (select doc_id, unnest(ws) as term from words union all select doc_id, term from b) group by 1, 2""")
def ngrams_12(t: Tables):
    rows = t.documents.select("doc_id", words(t).alias("ws"))
    return L.postings(rows, F.concat("ws", X.ngrams(F.col("ws"), 2)))


@query(f"with {TFIDF} select doc_id, term, round(w, 6) as w from weights")
def tfidf_weights(t: Tables):
    return weighed(t).select("doc_id", "term", X.r6(F.col("w")).alias("w"))


@query(f"""with {WORDS}, n as (select count(*) as n from documents), idf as (select term, ln((1.0 + n) / (1.0 + count(*))) + 1.0 as idf from post, n where doc_id in (select doc_id from labels) group by term, n having count(*) >= 2 and count(*) <= 0.5 * n),
    raw as (select doc_id, term, (1 + ln(tf)) * idf as w from post join idf using (term)), len as (select doc_id, sqrt(sum(w * w)) as len from raw group by 1) select doc_id, term, round(w / len, 6) as w from raw join len using (doc_id)""")
def tfidf_fit_on_train(t: Tables):
    """TXT-10: vocabulary from the labelled documents, sublinear counts, frequent terms out."""
    w = L.tf_idf(posted(t), t.documents.count(), min_df=2, max_df=0.5, sublinear=True, fit_on=t.labels)
    return w.select("doc_id", "term", X.r6(F.col("w")).alias("w"))


@query(f"""with {TFIDF} select doc_id, term, w, rk from (select doc_id, term, w, row_number() over (partition by doc_id order by w desc, term) as rk from (select doc_id, term, round(w, 6) as w from weights) where w > 0) where rk <= 5""")
def top_terms(t: Tables):
    return L.top_terms(weighed(t), 5)


@query(f"""with {TFIDF},
    s as (select x.doc_id as a, y.doc_id as b, round(sum(x.w * y.w), 6) as sim from weights x join weights y using (term) where x.doc_id % 20 = 0 and x.doc_id <> y.doc_id group by 1, 2) select a, b, sim, rk from (select *, row_number() over (partition by a order by sim desc, b) as rk from s) where rk <= 5""")
def tfidf_similar_top5(t: Tables):
    """The query documents are those whose id 20 divides."""
    return L.similar_docs(weighed(t), t.documents.filter("doc_id % 20 = 0"), 5)


def _bm25(weight: str, queries: str, k: int = 20) -> str:
    return f"""with {WORDS}, size as (select doc_id, sum(tf) as dl from post group by 1), tot as (select count(*) as n, avg(dl) as avgdl from size), df as (select term, count(*) as df from post group by 1), {queries},
    s as (select query_id, doc_id, round(sum({weight} * qtf), 6) as score from q join post using (term) join df using (term) join size using (doc_id) cross join tot group by 1, 2)
    select query_id, doc_id, score, rk from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rk from s where score > 0) where rk <= {k}"""


IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"
LENGTH = "(1 - 0.75 + 0.75 * dl / avgdl)"
OKAPI = f"{IDF} * (tf * 2.5 / (tf + 1.5 * {LENGTH}))"
BY_ITEM = f"q as (select item_id as query_id, term, count(*) as qtf from (select item_id, unnest(list_filter(string_split_regex({CLEAN}, '[ \\t\\n\\r\\f\\x0b]+'), lambda w: length(w) between 1 and 50 and w not in ({STOPS}))) as term from benchmark) group by 1, 2)"


def item_queries(t: Tables):
    rows = t.benchmark.select(F.col("item_id").alias("query_id"), F.explode(X.tokens(X.cleaned(F.col("text")), STOP)).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


@query(_bm25(OKAPI, BY_ITEM))
def bm25_okapi(t: Tables):
    """The benchmark items as queries."""
    return L.best_docs(L.bm25(posted(t), item_queries(t), "okapi", k=20), 20)


@query(_bm25(f"{IDF} * (tf * 2.5 / (tf + 1.5 * {LENGTH}) + 0.5)", BY_ITEM))
def bm25_plus(t: Tables):
    return L.best_docs(L.bm25(posted(t), item_queries(t), "plus", k=20), 20)


@query(_bm25(f"{IDF} * 2.5 * (tf / {LENGTH} + 0.5) / (1.5 + tf / {LENGTH} + 0.5)", BY_ITEM))
def bm25l(t: Tables):
    return L.best_docs(L.bm25(posted(t), item_queries(t), "l", k=20), 20)


PROFILE = "h as (select distinct user_id, item as doc_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rk from (select user_id, event_id % (select count(*) from documents) as item, ts, event_id from events)) where rk <= 10), c as (select user_id, term, sum(tf) as c from h join post using (doc_id) group by 1, 2), q as (select user_id as query_id, term, least(c, 3) as qtf from (select *, row_number() over (partition by user_id order by c desc, term) as rk from c) where rk <= 100)"


def read_lately(t: Tables):
    return top_per(reading_history(t), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", F.col("item").alias("doc_id")).distinct()


@query(_bm25(OKAPI, PROFILE, 10))
def bm25_profile(t: Tables):
    """TXT-17: what a user has read lately as the query."""
    post = posted(t)
    return L.best_docs(L.bm25(post, L.profile_terms(read_lately(t), post), "okapi", k=10), 10)


@query(f"with {WORDS} select term, sum(tf)::bigint as n from post group by 1 order by n desc, term limit 50")
def word_cloud_top50(t: Tables):
    """TXT-25; the limit is the report's."""
    return posted(t).groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(50)


@query(f"""with {WORDS},
    v as (select distinct term from post where doc_id in (select doc_id from labels)),
    x as (select term, sum(tf) as n, max(case when term in (select term from v) then 0 else 1 end) as out from post group by 1) select round(sum(out * n) / sum(n)::double, 6) as token_oov, round(avg(out::double), 6) as type_oov from x""")
def oov_rate(t: Tables):
    post = posted(t)
    return L.unknown_rate(post, post.join(t.labels.select("doc_id"), "doc_id", "left_semi"))


TITLES = "titles as (select p_partkey as item_id, list_distinct(string_split(lower(p_name), ' ')) as title from part)"


@query(f"""with {TITLES}, h as (select distinct user_id, item_id from (select *, row_number() over (partition by user_id order by ts desc, o_orderkey desc, l_linenumber desc, item_id, l_suppkey, l_extendedprice) as rk from purchases) where rk <= 20), best as (select item_id from purchases group by 1 order by count(*) desc, item_id limit 10),
    j as (select user_id, x.item_id, y.item_id as because, round(len(list_intersect(x.title, y.title))::double / len(list_distinct(list_concat(x.title, y.title))), 6) as score from (select * from titles join best using (item_id)) x, h join titles y on h.item_id = y.item_id)
    select user_id, item_id, because, score, case when score > 0.1 then 'title' else 'category' end as kind from (select *, row_number() over (partition by user_id, item_id order by score desc, because) as rn from j) where rn = 1""", ("purchases",))
def jaccard_explain(t: Tables):
    """TXT-20: why each of the ten best sellers is shown to each user: the most similar title of the last 20 that the user bought."""
    titles = t.part.select(F.col("p_partkey").alias("item_id"), F.array_distinct(F.split(F.lower("p_name"), " ")).alias("title"))
    rows = purchases(t)
    order = [F.desc("ts"), F.desc("o_orderkey"), F.desc("l_linenumber"), F.col("item_id"), F.col("l_suppkey"), F.col("l_extendedprice")]
    lately = top_per(rows, ["user_id"], order, 20).select("user_id", F.col("item_id").alias("because")).distinct()
    own = lately.join(titles.select(F.col("item_id").alias("because"), F.col("title").alias("theirs")), "because")
    best = rows.groupBy("item_id").count().orderBy(F.desc("count"), "item_id").limit(10).select("item_id")
    return L.explained(own, titles.join(F.broadcast(best), "item_id", "left_semi"))


@query(f"with {WORDS} select doc_id, array_to_string(list_filter(ws, lambda w: length(w) > 3)[1:3], ',') as tags from words")
def keyword_tags(t: Tables):
    """TXT-19."""
    return t.documents.select("doc_id", F.concat_ws(",", F.slice(F.filter(words(t), lambda w: F.length(w) > 3), 1, 3)).alias("tags"))


@query("select d.doc_id, concat_ws(' ', d.source, d.lang, d.text) as text from documents d")
def text_assembly(t: Tables):
    """CLN-10."""
    return t.documents.select("doc_id", F.concat_ws(" ", "source", "lang", "text").alias("text"))


@query("""select page_id, case when page_id % 3 > 0 and (trim(title) <> '' or trim(lang) <> '') then concat_ws(' ', nullif(trim(title), ''), nullif(trim(lang), '')) else trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', ''), '\\.html?$', ''), '[-_]+', ' ', 'g'), ' ') end as text
    from (select page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, '<html lang="([^"]*)"', 1) as lang from pages)""")
def text_or_address(t: Tables):
    """CLN-10: title and language of a page, or where it has neither (every third one here) the words of its address."""
    none = F.col("page_id") % 3 == 0
    title, lang = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.regexp_extract("html", '<html lang="([^"]*)"', 1)
    return t.pages.select("page_id", X.assembled(F.col("url"), F.when(~none, title), F.when(~none, lang)).alias("text"))


FULL = "nfc_normalize(text)"
for _pattern in (X.TAGS, X.URLS, X.PUNCTUATION, X.NUMBERS):
    FULL = _without(FULL, _pattern)


@query(f"""select doc_id, term, count(*)::bigint as tf from (select doc_id, unnest(list_filter(string_split_regex(lower({FULL}), '[ \\t\\n\\r\\f\\x0b]+'), lambda w: length(w) between 1 and 50 and w not in ({STOPS}))) as term from documents) group by 1, 2""")
def tokens_full(t: Tables):
    """TXT-1: all steps, from composed Unicode and numbers to the length of words. There is no segmenter here."""
    text = X.cleaned(X.composed(F.col("text")), numbers=True)
    return L.postings(t.documents, X.tokens(text, STOP))


@query("select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '<[^>]+>', ' ', 'g'), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'), ' ') as text from documents")
def simple_clean(t: Tables):
    """TXT-4."""
    return t.documents.select("doc_id", X.simple_clean(F.col("text")).alias("text"))


@query(f"""with {TFIDF.replace(' having count(*) >= 2', ' having term in (select term from (select term, sum(tf) as s from post group by 1 having count(*) >= 2 order by s desc, term limit 200))')} select doc_id, term, round(w, 6) as w from weights""")
def tfidf_max_features(t: Tables):
    """TXT-9 with the 200 most frequent terms; the limit is the feature."""
    w = L.tf_idf(posted(t), t.documents.count(), min_df=2, max_features=200)
    return w.select("doc_id", "term", X.r6(F.col("w")).alias("w"))


READ = "r as (select distinct user_id, event_id % (select count(*) from documents) as doc_id from events), "


@query(_bm25(OKAPI, PROFILE, 10).replace("where score > 0)", "where score > 0 and not exists (select 1 from r where r.user_id = s.query_id and r.doc_id = s.doc_id))").replace("with words", f"with {READ}words"))
def bm25_excluding_read(t: Tables):
    """TXT-13: the profile's best documents without those that the user has read."""
    post = posted(t)
    read = reading_history(t).select(F.col("user_id").alias("query_id"), F.col("item").alias("doc_id")).distinct()
    return L.best_docs(L.bm25(post, L.profile_terms(read_lately(t), post), "okapi", k=10, taken=read), 10)


BY_IDF = PROFILE.replace("c as (select user_id, term, sum(tf) as c from h join post using (doc_id) group by 1, 2)", "c as (select user_id, term, round(sum(tf) * ln((n - df + 0.5) / (df + 0.5) + 1), 6) as c from h join post using (doc_id) join df using (term) cross join tot group by user_id, term, n, df)").replace("least(c, 3) as qtf", "1 as qtf")
DISTINCT = PROFILE.replace("order by c desc, term", "order by term").replace("least(c, 3) as qtf", "1 as qtf")


@query(_bm25(OKAPI, BY_IDF, 10))
def bm25_profile_tfidf(t: Tables):
    """TXT-17 by TF-IDF."""
    post = posted(t)
    return L.best_docs(L.bm25(post, L.profile_terms(read_lately(t), post, how="tfidf"), "okapi", k=10), 10)


@query(_bm25(OKAPI, DISTINCT, 10))
def bm25_profile_distinct(t: Tables):
    """TXT-17 with each term once."""
    post = posted(t)
    return L.best_docs(L.bm25(post, L.profile_terms(read_lately(t), post, how="distinct"), "okapi", k=10), 10)
