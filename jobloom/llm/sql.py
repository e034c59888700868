"""DuckDB statements that say what the queries return, where SQL can say it."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATE = rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
iw as (
  select distinct item_id, m, array_to_string(w[p : p + m - 1], ' ') as g
  from (select item_id, w, m, unnest(range(1, len(w) - m + 2)) as p
        from (select *, least(13, len(w)) as m from i where len(w) > 0) a) b),
dw as (
  select doc_id, p, m, array_to_string(w[p : p + m - 1], ' ') as g
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as p
        from d cross join (select distinct m from iw) ms where len(w) >= m) a),
hits as (select doc_id, item_id, p, m from dw join iw using (m, g)),
covered as (
  select doc_id, count(distinct q) as n_hit
  from (select doc_id, unnest(range(p, p + m)) as q from (select distinct doc_id, p, m from hits) a) b
  group by doc_id),
named as (
  select doc_id, count(distinct item_id) as n_items,
         string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
  from hits group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
       coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join covered using (doc_id) left join named using (doc_id)"""

JACCARD = rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, array_to_string(w[p : p + m - 1], ' ') as g
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as p
        from (select *, least(5, len(w)) as m from d where len(w) > 0) a) b),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id < y.doc_id
                    group by 1, 2) p
  join n na on na.doc_id = a join n nb on nb.doc_id = b
  where 100 * c >= 75 * (na.n + nb.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (
  select doc_id, doc_id from n
  union
  select r.doc_id, e.b from reach r join both_ways e on e.a = r.other)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id
from d left join n using (doc_id)
left join (select doc_id, min(other) as component_id from reach group by doc_id) c using (doc_id)"""


MINHASH = rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, array_to_string(w[p : p + m - 1], ' ') as g
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as p
        from (select *, least(4, len(w)) as m from d where len(w) > 0) a) b),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id < y.doc_id
                    group by 1, 2) p
  join n na on na.doc_id = a join n nb on nb.doc_id = b
  where 100 * c >= 80 * (na.n + nb.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (
  select doc_id, doc_id from n
  union
  select r.doc_id, e.b from reach r join both_ways e on e.a = r.other)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id,
       d.doc_id = coalesce(c.component_id, d.doc_id) as kept
from d left join n using (doc_id)
left join (select doc_id, min(other) as component_id from reach group by doc_id) c using (doc_id)"""


SUFFIX_DEDUP = """
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as h, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n
  from documents),
w as (
  select doc_id, p, substr(h, 2 * p + 1, 200) as s
  from (select doc_id, h, unnest(range(0, n - 99)) as p from d where n >= 100) a),
again as (
  select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) as rn from w) a where rn > 1),
gone as (
  select doc_id, min(p) as a, max(p) + 100 as b
  from (select *, sum(case when p <= before + 100 then 0 else 1 end) over (partition by doc_id order by p) as g
        from (select *, lag(p) over (partition by doc_id order by p) as before from again) x) y
  group by doc_id, g),
sizes as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed from gone group by doc_id),
pieces as (
  select doc_id, lag(b, 1, 0) over (partition by doc_id order by a) as s, a as e from gone
  union all select doc_id, max(b), null from gone group by doc_id),
kept as (
  select p.doc_id, string_agg(substr(h, cast(2 * s + 1 as bigint), cast(2 * (coalesce(e, n) - s) as bigint)), '' order by s) as h
  from pieces p join d using (doc_id) group by p.doc_id)
select d.doc_id, d.n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join sizes using (doc_id) left join kept using (doc_id)"""


def _fill(name: str, nodes: str, level: str, parent: str) -> str:
    """A level of the budget tree: `nodes` has parent columns, level, cap, weight and budget."""
    over = f"partition by {parent}" if parent else ""
    return rf"""
{name}_rate as (
  select *, (budget - coalesce(sum(cap) over ahead, 0)) / (sum(weight) over ({over}) - coalesce(sum(weight) over ahead, 0)) as r
  from {nodes}
  window ahead as ({over} order by cap / weight, {level} nulls first rows between unbounded preceding and 1 preceding)),
{name} as (
  select * exclude (r, budget, weight, cap), least(cap, cast(floor(weight * max(r) over ({over})) as bigint)) as share
  from {name}_rate)"""


MIX = rf"""
with rows0 as (
  select doc_id, lang, source,
         case when regexp_matches(source, '[0-9]+$')
              then 'd' || cast(cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 4 as varchar) end as domain,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as n_tokens
  from documents),
leaves as (
  select domain, lang, source, cast(sum(n_tokens) as bigint) as tokens, count(*) as n, cast(3 * sum(n_tokens) as bigint) as cap
  from rows0 group by all),
d0 as (
  select domain, cast(sum(cap) as bigint) as cap, (select cast(sum(tokens) as bigint) * 50 // 100 from leaves) as budget,
         coalesce(case domain when 'd0' then 4 when 'd1' then 3 when 'd2' then 2 end, 1) as weight
  from leaves group by domain), {_fill("d1", "d0", "domain", "")},
l0 as (
  select l.domain, l.lang, cast(sum(cap) as bigint) as cap, any_value(d1.share) as budget,
         coalesce(case l.lang when 'en' then 5 when 'de' then 2 when 'fr' then 2 end, 1) as weight
  from leaves l join d1 on d1.domain is not distinct from l.domain group by l.domain, l.lang), {_fill("l1", "l0", "lang", "domain")},
s0 as (
  select l.domain, l.lang, l.source, l.cap, l1.share as budget, 1 as weight
  from leaves l join l1 on l1.domain is not distinct from l.domain and l1.lang is not distinct from l.lang),
{_fill("s1", "s0", "source", "domain, lang")},
plan as (
  select l.*, case when tokens > 0 then share // tokens else 0 end as epochs, share
  from leaves l join s1 on s1.domain is not distinct from l.domain and s1.lang is not distinct from l.lang
                       and s1.source is not distinct from l.source),
placed as (
  select r.*, p.epochs, p.share - p.epochs * p.tokens as rest,
         md5('17:' || cast(p.epochs as varchar) || ':' || coalesce(cast(r.doc_id as varchar), '')) as place
  from rows0 r join plan p on p.domain is not distinct from r.domain and p.lang is not distinct from r.lang
                          and p.source is not distinct from r.source)
select doc_id, domain, lang, source, n_tokens,
       cast(epochs + case when sum(n_tokens) over (partition by domain, lang, source order by place, doc_id, n_tokens
                                                   rows between unbounded preceding and current row) <= rest
                          then 1 else 0 end as bigint) as copies
from placed"""
