"""SQL of the same results, where SQL can say it."""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"

OP7 = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as w from documents),
s as (select doc_id, unnest(range(1, len(w) - 18)) as i, w from d where len(w) >= 20),
x as (select doc_id, i, row_number() over (partition by array_to_string(w[i : i + 19], ' ') order by doc_id, i) as nth from s),
c as (select distinct doc_id, unnest(range(i, i + 20)) as j from x where nth > 1),
r as (select doc_id, list(j) as gone from c group by doc_id),
k as (select d.doc_id, w, coalesce(gone, []) as gone from d left join r using (doc_id))
select doc_id, len(w)::bigint as n_words, len(gone)::bigint as n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda v, p: not list_contains(gone, p)), ' '), '')) as kept_sha256 from k
"""

OP8 = rf"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ' ' || coalesce(text, '')), 1, 15))::bigint >> 24 as bucket from documents),
s as (select source, sum(size)::bigint as source_size, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as weight
  from d group by source),
r as (select *, 2.0 * source_size as lim, 2.0 * source_size / weight as ratio from s),
l as (select *, (1.5 * sum(source_size) over () - coalesce(sum(lim) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level from r),
t as (select source, source_size, least(lim, coalesce((select arg_min(level, ratio) from l where level <= ratio) * weight, lim))::double as target from l),
p as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as copies from t),
h as (select d.source, bucket, sum(size) as words from d group by d.source, bucket),
u as (select h.source, bucket, words, target - copies * source_size as budget, sum(words) over (partition by h.source order by bucket) as upto
  from h join p on h.source is not distinct from p.source),
e as (select source, min(struct_pack(bucket := bucket, inside := 2 * (budget - (upto - words)) >= words)) as last from u where upto > budget group by source)
select doc_id, size, source_size, target, (size * (copies + case when last is null or bucket < last.bucket or (bucket = last.bucket and last.inside)
  then 1 else 0 end))::bigint as taken
from d join p on d.source is not distinct from p.source left join e on d.source is not distinct from e.source
"""

OP10 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as a from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, v.vec_id, list_inner_product(q.a, v.a)::bigint as score from v q join v on q.vec_id % 20 = 0 and q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""

OP12 = r"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
t as (select k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from t group by all having count(distinct k) >= 30),
n as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by all),
v as (select lang, count(*) as v from kept group by lang),
g as (select lang, source, coalesce(v, 0) as v, coalesce((select sum(n.n) from n where n.lang = d.lang and n.source = d.source), 0) as total
  from (select distinct lang, source from d) d left join v using (lang)),
p as (select g.lang, g.source, kept.term, coalesce(n.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n.n, 0) + 5)) // (total + 5 * v)::hugeint as p
  from g join kept using (lang) left join n on n.lang = g.lang and n.source = g.source and n.term = kept.term),
l as (select lang, sum(total) as total, any_value(v) as v from g group by lang),
q as (select n.lang, n.term, 1 + (1000000000::hugeint * (sum(n.n) + 5)) // (any_value(l.total) + 5 * any_value(v))::hugeint as q
  from n join l on n.lang = l.lang group by n.lang, n.term),
pairs as (select a.lang, a.source, b.source as item, coalesce((select sum(abs(x.p - y.p)) from p x join p y
    on x.lang = y.lang and x.term = y.term where x.lang = a.lang and x.source = a.source and y.source = b.source), 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source),
terms as (select p.lang, source, p.term as item, (p.p - q)::bigint as value from p join q on p.lang = q.lang and p.term = q.term where n > 0 and p.p > q)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select * from (select lang, source, 'term' as part, item, value,
  row_number() over (partition by lang, source order by value desc, item)::int as rank from terms) where rank <= 50
"""

OP13 = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents),
h as (select doc_id, t, length(t)::bigint as n, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(x, k, 8))::bigint) as h from d),
c as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 90 then 'plain'
    when h[4] % 100 < 20 then 'spm' else 'psm' end as form from h),
s as (select *, substring(t, 1, a) as pre, substring(t, a + 1, b - a) as mid, substring(t, b + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
    else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from s
"""

SQL = {"op12_source_divergence": OP12, "op13_fill_in_middle": OP13, "op7_substring_dedup": OP7, "op8_source_mix": OP8, "op10_top_k": OP10}
