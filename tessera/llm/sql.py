"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NORMAL = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
with d as (select doc_id, {WORDS} as w from documents),
win as (select doc_id, unnest(range(1, len(w) - 48)) as i, w from d where len(w) >= 50),
h as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as s from win),
rep as (select doc_id, i, min(doc_id) over (partition by s) as first from h),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as i from rep where first < doc_id),
lost as (select doc_id, list(i) as l, count(*) as n from gone group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed,
  sha256(array_to_string(case when l is null then w else [x[1] for x in list_zip(w, range(1, len(w) + 1)) if not list_contains(l, x[2])] end, ' ')) as kept_sha256
from d left join lost on d.doc_id = lost.doc_id
"""

#: Add-one unigrams over one vocabulary, bigrams with two pseudo-counts, a document's own words taken out.
OP2 = f"""
with q as (select doc_id, max(quality) as quality from labels group by doc_id),
d as (select documents.doc_id, coalesce(quality = 1, false) as t, {WORDS} as w from documents left join q on documents.doc_id = q.doc_id),
tok as (select doc_id, t, i, w[i] as x, case when i > 1 then w[i - 1] end as v from (select *, unnest(range(1, len(w) + 1)) as i from d)),
u as (select x, count(*) filter (t) as ct, count(*) filter (not t) as cb from tok group by x),
b as (select v, x, count(*) filter (t) as ct, count(*) filter (not t) as cb from tok where v is not null group by v, x),
ou as (select doc_id, x, count(*) as c from tok group by doc_id, x),
ob as (select doc_id, v, x, count(*) as c from tok where v is not null group by doc_id, v, x),
n as (select count(*) filter (t) as nt, count(*) filter (not t) as nb, count(distinct x) as k from tok),
own as (select doc_id, count(*) as c from tok group by doc_id),
p as (
  select tok.doc_id, tok.v,
    (u.ct - case when t then ou.c else 0 end + 1) / cast(nt - case when t then own.c else 0 end + k as double) as pt,
    (u.cb - case when t then 0 else ou.c end + 1) / cast(nb - case when t then 0 else own.c end + k as double) as pb,
    b.ct - case when t then ob.c else 0 end as bt, b.cb - case when t then 0 else ob.c end as bb,
    uv.ct - case when t then ov.c else 0 end as vt, uv.cb - case when t then 0 else ov.c end as vb
  from tok join u on u.x = tok.x join ou on ou.doc_id = tok.doc_id and ou.x = tok.x join own on own.doc_id = tok.doc_id
    left join b on b.v = tok.v and b.x = tok.x left join ob on ob.doc_id = tok.doc_id and ob.v = tok.v and ob.x = tok.x
    left join u uv on uv.x = tok.v left join ou ov on ov.doc_id = tok.doc_id and ov.x = tok.v, n),
s as (
  select doc_id, avg(-ln(case when v is null then pt else (bt + 2 * pt) / (vt + 2) end)) as lt,
    avg(-ln(case when v is null then pb else (bb + 2 * pb) / (vb + 2) end)) as lb from p group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_tokens, round(coalesce(lt, 0), 6) as target_loss, round(coalesce(lb, 0), 6) as background_loss,
  round(coalesce(lt - lb, 0), 6) as score from d left join s on d.doc_id = s.doc_id
"""

OP6 = f"""
with recursive d as (select doc_id, {WORDS} as w from documents where doc_id is not null),
sh as (
  select doc_id, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)
  union select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4),
st as (select doc_id, list(s order by s) as l, count(*) as n from sh group by doc_id),
cl as (select doc_id, n, min(doc_id) over (partition by l) as c, count(*) over (partition by l) as copies from st),
r as (select c, any_value(n) as n, any_value(copies) as copies from cl group by c),
rs as (select sh.doc_id as c, s from sh join r on sh.doc_id = r.c),
cm as (select a.c as x, b.c as y, count(*) as k from rs a join rs b on a.s = b.s and a.c <> b.c group by 1, 2),
lk as (select x, y, rb.copies from cm join r ra on ra.c = x join r rb on rb.c = y where 9 * k >= 4 * (ra.n + rb.n)),
reach(c, y) as (select c, c from r union select reach.c, lk.y from reach join lk on lk.x = reach.y),
comp as (select c, min(y) as class_id from reach group by c),
tot as (select x as c, count(*) as n_text, sum(copies) as n_docs from lk group by x)
select documents.doc_id, coalesce(class_id, documents.doc_id) as class_id, coalesce(cl.c, documents.doc_id) as text_class,
  cast(coalesce(copies - 1 + coalesce(n_docs, 0), 0) as bigint) as n_links, cast(coalesce(n_text, 0) as bigint) as n_text_links
from documents left join cl on cl.doc_id = documents.doc_id left join comp on comp.c = cl.c left join tot on tot.c = cl.c
"""

BITS = "".join(f"{k:04b}" for k in range(16))
OP7 = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, octet_length(encode(html)) as n, sha1(html) as x, max(page_id) over (partition by html) as newest from p),
b as (select *, array_to_string([substr('{BITS}', 4 * strpos('0123456789abcdef', substr(x, k, 1)) - 3, 4) for k in range(1, 41)], '') as bits from h)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * cast(substr(bits, k, 1) as int) + 8 * cast(substr(bits, k + 1, 1) as int) + 4 * cast(substr(bits, k + 2, 1) as int)
    + 2 * cast(substr(bits, k + 3, 1) as int) + cast(substr(bits, k + 4, 1) as int), 1) for k in range(1, 161, 5)], '') as payload_digest,
  case when newest = page_id then 'response' else 'revisit' end as record_type, case when newest <> page_id then newest end as refers_to
from b
"""

OP8 = f"""
with d as (select doc_id, {NORMAL} as w from documents),
b as (select cast(item_id as varchar) as item, {NORMAL} as w from benchmark),
bw as (
  select distinct item, array_to_string(w[i:i + 9], ' ') as s, 10 as n from (select item, w, unnest(range(1, len(w) - 8)) as i from b where len(w) >= 10)
  union select item, array_to_string(w, ' '), len(w) from b where len(w) between 1 and 9),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hit as (select doc_id, i, bw.n, item from dw join bw on dw.s = bw.s and dw.n = bw.n),
cover as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hit) group by doc_id),
items as (select doc_id, string_agg(item, ',' order by item) as l, count(*) as n from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n, 0) as n_items, sha256(coalesce(l, '')) as items_sha256, n_hit is not null as contaminated
from d left join cover on cover.doc_id = d.doc_id left join items on items.doc_id = d.doc_id
"""

OP10 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
win as (select doc_id, i, substr(x, 2 * i + 1, 200) as s from (select doc_id, x, unnest(range(0, length(x) // 2 - 99)) as i from d where length(x) >= 200)),
num as (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from win),
gone as (select doc_id, i as a, i + 100 as b from num where k > 1),
lim as (select *, max(b) over (partition by doc_id order by a rows between unbounded preceding and 1 preceding) as reach from gone),
isl as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by doc_id order by a) as g from lim),
run as (select doc_id, min(a) as a, max(b) as b from isl group by doc_id, g),
kept as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as p from run),
part as (select kept.doc_id, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' order by a) || substr(any_value(x), 2 * max(b) + 1) as rest, count(*) as n, sum(b - a) as m from kept join d on d.doc_id = kept.doc_id group by kept.doc_id)
select d.doc_id, cast(length(x) // 2 as bigint) as n_bytes, cast(coalesce(m, 0) as bigint) as n_removed, cast(coalesce(n, 0) as bigint) as n_spans, sha256(unhex(coalesce(rest, x))) as kept_sha256
from d left join part on part.doc_id = d.doc_id
"""

ORACLES = {
    "op1_substring_dedup": OP1,
    "op2_lm_scoring": OP2,
    "op6_jaccard_join": OP6,
    "op7_warc": OP7,
    "op8_decontamination": OP8,
    "op10_suffix_dedup": OP10,
}
