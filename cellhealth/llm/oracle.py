"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP3 = r"""
with sized as (
  select doc_id, text, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
sums as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighed as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
    source_size * 3.0::double as most
  from sums),
ranked as (
  select *, row_number() over (order by most / weight, source nulls last) as place,
    coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as used,
    coalesce(sum(weight) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as gone,
    sum(cast(source_size as double)) over () as total, sum(weight) over () as weights
  from weighed),
levels as (select *, (total - used) / (weights - gone) as level from ranked),
open as (select arg_min(level, place) as level from levels where most > level * weight),
targets as (
  select l.source, l.source_size, case when l.most <= l.level * l.weight then l.most else (select level from open) * l.weight end as target from levels l),
drawn as (
  select s.doc_id, s.size, t.source_size, t.target, case when t.source_size = 0 then 0.0 else t.target / t.source_size end as rate,
    cast('0x' || substr(md5('mix:' || coalesce(cast(s.doc_id as varchar), '-') || ':' || md5(coalesce(s.text, ''))), 1, 13) as bigint) / 4503599627370496.0::double as u
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) as bigint) as taken from drawn
"""

OP6 = r"""
with texts as (select distinct doc_id, text from documents where text is not null),
numbered as (select doc_id, text, l, unnest(generate_series(1, len(l))) as i from (select doc_id, text, string_split(text, chr(10)) as l from texts)),
fields as (
  select doc_id, text, i, trim(regexp_replace(regexp_replace(l[i], '[\x20\x09\x0B\x0C\x0D]+', ' ', 'g'), '[^ ]*[0-9][^ ]*', '<*>', 'g')) as line
  from numbered),
filled as (select *, string_split(line, ' ') as w from fields where line <> ''),
blocked as (
  select *, len(w) as n, array_to_string(w[1:2], ' ') as lead, greatest(len(w) - 2, 0) as r from filled),
masked as (
  select *, [array_to_string(w[3:2 + r // 4], ' '), array_to_string(w[3 + r // 4:2 + r * 2 // 4], ' '),
    array_to_string(w[3 + r * 2 // 4:2 + r * 3 // 4], ' '), array_to_string(w[3 + r * 3 // 4:n], ' ')] as b,
    unnest(case when n >= 10 then [0, 1, 2, 3, 4] else [0] end) as field from blocked),
templates as (
  select *, n || chr(2) || lead || chr(2) || field || chr(2)
    || array_to_string([case when k = field then '' else b[k] end for k in [1, 2, 3, 4]], chr(2)) as template
  from masked),
shared as (select template from templates group by template having count(distinct text) >= 5),
marks as (select distinct text, i from templates where template in (select template from shared)),
own as (
  select f.text, f.i, m.i is not null as marked, case when m.i is null then array_to_string(f.w[1:3], ' ') end as head
  from (select distinct text, i, w from filled) f left join marks m on f.text = m.text and f.i = m.i),
around as (
  select text, i, coalesce(last_value(head ignore nulls) over (partition by text order by i rows between unbounded preceding and 1 preceding), chr(1) || 'start') as before,
    coalesce(first_value(head ignore nulls) over (partition by text order by i rows between 1 following and unbounded following), chr(1) || 'end') as after, marked
  from own),
recurring as (
  select t.template from (select distinct template, text, i from templates where template in (select template from shared)) t
  join around a on t.text = a.text and t.i = a.i group by t.template
  having greatest(count(distinct before), count(distinct after)) >= 5),
dropped as (select distinct doc_id, text, i from templates where n >= 3 and template in (select template from recurring)),
rest as (
  select x.doc_id, x.text, count(*) as n_lines, count(d.i) as n_dropped, coalesce(string_agg(x.l[x.i], chr(10) order by x.i) filter (where d.i is null), '') as kept
  from numbered x left join dropped d on x.doc_id is not distinct from d.doc_id and x.text = d.text and x.i = d.i group by x.doc_id, x.text)
select o.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped, sha256(coalesce(kept, '')) as kept_sha256
from documents o left join rest on o.doc_id is not distinct from rest.doc_id and o.text = rest.text
"""


OP12 = r"""
with digests as (
  select doc_id, length(coalesce(text, '')) as chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over best as keep_id, count(*) over (partition by text_sha256) as group_size,
  row_number() over best = 1 as kept, text_sha256
from digests window best as (partition by text_sha256 order by chars desc, doc_id nulls last)
"""

OP13 = r"""
with texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    min(doc_id) over (partition by coalesce(text, '')) as least
  from documents),
marks as (
  select doc_id, part, case when len(w) < 50 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 65 * len(w) then 2 else 0 end
    + case when 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) then 4 else 0 end
    + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
    + case when least < doc_id or (doc_id is null and least is not null) then 16 else 0 end as mask
  from texts),
flags as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
cells as (
  select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
  from marks left join flags using (doc_id) group by part, mask),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (
  select filter_order, s as step, 1 << (instr('ABCDE', filter_order[s]) - 1) as bit,
    coalesce(list_sum(list_transform(range(1, s), lambda i: 1 << (instr('ABCDE', filter_order[i]) - 1))), 0)::bigint as prefix
  from orders, generate_series(1, 5) as g(s)),
counted as (
  select part, filter_order, step, bit,
    sum(case when mask & (prefix + bit) = 0 then n else 0 end) as kept,
    sum(case when mask & bit <> 0 and mask & prefix = 0 then n else 0 end) as removed,
    sum(case when mask & bit <> 0 and mask & prefix <> 0 then n else 0 end) as redundant,
    sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & bit <> 0 and mask & prefix = 0 then good else 0 end) as good_lost,
    sum(case when mask & bit <> 0 and mask & prefix = 0 then toxic else 0 end) as toxic_lost
  from cells, steps group by part, filter_order, step, bit)
select part, filter_order, cast(step as int) as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
  unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, bit))::bigint as shapley
from counted
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3, "op6_line_templates": OP6, "op12_exact_dedup": OP12, "op13_filter_audit": OP13}
