"""DuckDB twins of the numbered queries that SQL can express.

The others rest on trained models (2, 4, 9), XXH64 (3), weighted windows (6) or a tokenizer (10); tests/llm compares them with plain Python.
"""

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
KEY = LOW.format("regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')")

OP1 = f"""
with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
keyed as (select doc_id, i, line, {KEY} as key from lines),
hot as (select key, max(doc_id) as last_doc from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (select k.*, h.key is not null and doc_id <> last_doc as gone from keyed k left join hot h on k.key = h.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from marked group by doc_id"""

OP5 = f"""
with p as (select page_id, coalesce(url, '') as url from pages),
h as (select page_id, {LOW.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")} as host, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from p),
lab as (select doc_id as page_id, max(quality) as good from labels where doc_id is not null group by 1),
o as (select host, count(good)::double as n, coalesce(sum(good), 0)::double as k, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as bare from h left join lab using (page_id) where host <> '' group by host),
ol as (select *, string_split(bare, '.') as parts, regexp_matches(bare, '^[0-9.]+$|^\\[') as numeric from o),
ot as (select *, case when length(parts[-1]) = 2 and len(parts) > 1 and parts[-2] in ('co', 'com', 'org', 'net', 'edu', 'gov', 'ac', 'or', 'ne', 'go') then 2 else 1 end as labels from ol),
hosts as (select host, n, k, case when numeric then bare else array_to_string(parts[-labels:], '.') end as suffix, case when numeric then bare else array_to_string(parts[-(labels + 1):], '.') end as domain from ot),
domains as (select domain, suffix, sum(n) as n, sum(k) as k from hosts group by 1, 2),
suffixes as (select suffix, sum(n) as n, sum(k) as k from domains group by 1),
lv as (select 'h' as lv, n, k from hosts where n > 0 union all select 'd', n, k from domains where n > 0 union all select 's', n, k from suffixes where n > 0),
mo as (select lv, count(*) as m, sum(n) as n, sum(k) as k, sum(n * n) as nn, sum(k * k / n) as kp, sum(k * (1 - k / n)) as wi from lv group by 1),
va as (select *, (kp - n * (k / n) * (k / n)) / nullif(m - 1, 0) as b, wi / nullif(n - m, 0) as w, (n - nn / n) / nullif(m - 1, 0) as size from mo),
rh as (select *, case when b + (size - 1) * w > 0 then (b - w) / (b + (size - 1) * w) else 0 end as share from va),
st as (select lv, case when m < 2 or n <= m then 10.0 when share > 0 then least(1000.0, greatest(1.0, (1 - share) / share)) else 1000.0 end as s from rh),
pri as (select case when sum(n) > 0 then (sum(k) + 1) / (sum(n) + 2) else 1.0 end as mean, coalesce((select s from st where lv = 's'), 10.0) as ss, coalesce((select s from st where lv = 'd'), 10.0) as sd, coalesce((select s from st where lv = 'h'), 10.0) as sh from suffixes),
g1 as (select suffix, (k + ss * mean) / (n + ss) as g from suffixes, pri),
g2 as (select domain, suffix, (d.k + sd * g) / (d.n + sd) as g from domains d join g1 using (suffix), pri),
g3 as (select host, (k + sh * g) / (n + sh) as p_good, n + sh + 1 as t from hosts join g2 using (domain, suffix), pri),
j as (select page_id, host, path, p_good, greatest(0, p_good - 1.645 * sqrt(p_good * (1 - p_good) / t)) as good_from from h left join g3 using (host)),
r as (select *, case
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/7') then 'example.com/en/7'
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/de/8') then 'example.net/de/8'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/en/') then 'com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/de/') then 'net/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/es/') then 'org/es/' end as rule from j)
select page_id, host, path, rule, case when rule in ('example.com/en/7', 'net/de/') then 'allow' when rule is not null then 'block' when good_from < 0.5 then 'block' else 'allow' end as verdict, round(p_good, 6) as p_good, round(good_from, 6) as good_from from r"""

OP7 = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
l as (select *, max(page_id) over (partition by payload_digest) as last from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id < last then 'revisit' else 'response' end as record_type, case when payload_bytes >= 1000 and page_id < last then last end as refers_to from l"""

OP8 = """
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as ws from documents),
w as (select doc_id, i, ws[i:i + 49] as x from d, unnest(range(1, len(ws) - 48)) u(i) where len(ws) >= 50),
f as (select x, min(doc_id) as first from w group by x having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as i from w join f using (x) where doc_id > first),
kept as (select doc_id, i, ws[i] as word from d, unnest(range(1, len(ws) + 1)) u(i)),
k as (select kept.doc_id, count(gone.i) as n_removed, string_agg(word, ' ' order by kept.i) filter (where gone.i is null) as text from kept left join gone on gone.doc_id = kept.doc_id and gone.i = kept.i group by 1)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256 from d left join k using (doc_id)"""

OP13 = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as digest from documents),
u as (select *, case when text = '' then []::varchar[] else regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') end as units,
    cast('0x' || substr(digest, 1, 8) as bigint) as h1, cast('0x' || substr(digest, 9, 8) as bigint) as h2, cast('0x' || substr(digest, 17, 8) as bigint) as h3, cast('0x' || substr(digest, 25, 8) as bigint) as h4 from d),
r as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix from r)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256 from p"""

OP11 = f"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({LOW.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
p as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') as ws from pieces),
f1 as (select lang, w, count(*) as f from (select lang, unnest(ws) as w from p) group by 1, 2),
f2 as (select lang, g, count(*) as f from (select lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i:i + 1])) as g from p) group by 1, 2),
f3 as (select lang, g, count(*) as f from (select lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2])) as g from p) group by 1, 2 having count(*) >= 10),
s as (select lang, sum(f)::bigint as n from f1 group by 1),
c2 as (select f2.lang, g, f2.f as a, x.f as l, y.f as r, 1000000 * f2.f::hugeint * f2.f // (x.f::hugeint * y.f) as score from f2 join f1 x on x.lang = f2.lang and x.w = g[1] join f1 y on y.lang = f2.lang and y.w = g[2] where f2.f >= 10),
k3 as (select f3.lang, f3.g as g, f3.f as a, x.f as l1, q.f as r1, o.f as l2, y.f as r2, 1000000 * f3.f::hugeint * f3.f // (x.f::hugeint * q.f) as s1, 1000000 * f3.f::hugeint * f3.f // (o.f::hugeint * y.f) as s2
    from f3 join f1 x on x.lang = f3.lang and x.w = f3.g[1] join f2 q on q.lang = f3.lang and q.g = f3.g[2:3] join f2 o on o.lang = f3.lang and o.g = f3.g[1:2] join f1 y on y.lang = f3.lang and y.w = f3.g[3]),
c3 as (select lang, g, a, case when s1 <= s2 then l1 else l2 end as l, case when s1 <= s2 then r1 else r2 end as r, least(s1, s2) as score from k3),
longer as (select lang, g, max(f) as f from (select lang, g[1:2] as g, f from f3 union all select lang, g[2:3], f from f3) group by 1, 2),
kept as (select c2.* from c2 left join longer using (lang, g) where longer.f is null or 100 * longer.f < 50 * c2.a union all select * from c3),
t as (select lang, array_to_string(g, ' ') as phrase, a, l, r, score from kept),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from t)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join s using (lang) where rank <= 2000"""

SQL = {"op1_line_dedup": OP1, "op5_url_filter": OP5, "op7_warc": OP7, "op8_substring": OP8, "op11_collocations": OP11, "op13_infilling": OP13}
