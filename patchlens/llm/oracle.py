"""DuckDB SQL for the queries that SQL can express, by query name."""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

op4_host_quality_rules = rf"""
with t as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text, {_WORDS} as w from documents),
win as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select rid, w, unnest(range(1, len(w) - 1)) as i from t)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from win) where c > 1),
rep as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from twice) group by rid),
s as (
  select doc_id, source, len(w)::bigint as n_words, length(list_aggregate(list_concat([''], w), 'string_agg', ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
  from (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t) left join rep using (rid)
),
f as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from s),
g as (select *, (base_failed or 100 * n_symbols > 25 * word_chars or 100 * n_dup_lines > 50 * n_lines) as suspect, coalesce('=' || source, 'null') as hk from f),
h as (select hk, count(*)::double as n, sum(suspect::int)::double as bad from g group by hk),
m as (select sum(n) as n, sum(bad) / sum(n) as m, count(*) as hosts, sum(bad * bad / n) as sq from h),
k as (select m, sq / n - m * m - m * (1 - m) * hosts / n as v from m),
p as (select m, case when v > 0 then least(10000.0, greatest(1.0, m * (1 - m) / v - 1)) else 10000.0 end as k from k),
z as (select hk, case when p.m > 0 then round(least(4.0::double, greatest(0.5::double, p.m / ((bad + p.m * p.k) / (n + p.k)))), 9) else 1.0::double end as factor from h, p)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and not (100 * n_symbols > 25 * factor * word_chars or 100 * n_dup_lines > 50 * factor * n_lines)) as kept
from g join z using (hk)
"""

op8_source_mix = rf"""
with d as (select doc_id, source, len({_WORDS})::bigint as size, md5('mix-1:' || coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, '')))) as key, coalesce('=' || source, 'null') as src from documents),
s as (select src, min(source) as source, sum(size)::bigint as source_size from d group by src),
w as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w, 2.0::double * source_size as cap from s),
r as (
  select *, (1.5::double * (sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as lv
  from w
),
t as (select src, source_size, least(cap, coalesce((select arg_min(lv, cap / w) from r where lv < cap / w) * w, cap)) as target from r),
o as (
  select doc_id, size, source_size, target, floor(target + 1e-6) as budget,
    coalesce(sum(size) over (partition by src order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as start
  from d join t using (src)
)
select doc_id, size, source_size, target,
  (greatest(0, least(size, budget - start)) + greatest(0, least(size, budget - source_size - start)))::bigint as taken
from o
"""


def _components(width: int, percent: int) -> str:
    """Links by brute force over shared shingles, components by a recursive walk."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return rf"""
with recursive t as (select doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (
  select distinct doc_id, g from (
    select doc_id, {gram} as g from (select doc_id, w, unnest(range(1, len(w) - {width - 2})) as i from t where len(w) >= {width})
    union all select doc_id, list_aggregate(w, 'string_agg', ' ') from t where len(w) between 1 and {width - 1}
  )
),
n as (select doc_id, count(*)::bigint as n from s group by doc_id),
c as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from c join n p on p.doc_id = a join n q on q.doc_id = b where 100 * k >= {percent} * (p.n + q.n - k)),
e as (select a, b from l union all select b, a from l),
reach as (select doc_id as a, doc_id as b from t union select reach.a, e.b from reach join e on reach.b = e.a),
comp as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from t left join n using (doc_id) join comp using (doc_id)
"""


op1_ngram_jaccard_join = _components(3, 90)

_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _pieces(text: str, pattern: str) -> str:
    """Text cut at the frames set around matches: every second piece is a match."""
    return rf"string_split(regexp_replace({text}, '({pattern})', chr(64976) || '\1' || chr(64976), 'g'), chr(64976))"


op6_personal_data = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
p as ({" union all ".join(f"select rid, {k} as k, '{name}' as kind, unnest({_pieces('text', pattern)}) as piece, generate_subscripts({_pieces('text', pattern)}, 1) as i from d" for k, (name, pattern) in enumerate(_KINDS.items()))}),
q as (select *, coalesce(sum(length(piece)) over (partition by rid, k order by i rows between unbounded preceding and 1 preceding), 0)::bigint as s, regexp_replace(piece, '[^0-9]', '', 'g') as digits from p),
b as (
  select rid, k, kind, s, s + length(piece) as e, k || ':' || lower(piece) as entity from q where i % 2 = 0 and case kind
    when 'email' then true when 'ip' then regexp_full_match(piece, '{_BYTE}(\.{_BYTE}){{3}}') when 'phone' then length(digits) between 8 and 15
    else length(digits) between 16 and 19 and list_sum(list_transform(regexp_extract_all(reverse(digits), '.'), lambda c, j: case when j % 2 = 1 then c::int when c::int > 4 then 2 * c::int - 9 else 2 * c::int end)) % 10 = 0 end
),
t as (select text, min(rid) as tid, list(rid) as rids from d group by text),
c as (
  select rid, s, e, entity from b
  union all select rid, s, e, k || '@' || case k when 0 then split_part(m, '@', 2) when 1 then regexp_extract(m, '^([0-9]+\.[0-9]+)', 1) when 2 then left(m, 1) else regexp_extract(m, '^\+([0-9]{{1,3}})', 1) end
  from (select rid, s, e, k, substr(entity, 3) as m from b)
),
h as (select distinct tid, entity from c join t on c.rid = t.tid),
x as (select rid as tid, entity, text, s, e from c join t on c.rid = t.tid),
w as (
  select tid, entity, lower(case when s > 80 then regexp_replace(substring(text, s - 79, 80), '^\p{{L}}+', '') else left(text, s) end) as part from x
  union all select tid, entity, lower(case when e + 80 < length(text) then regexp_replace(substring(text, e + 1, 80), '\p{{L}}+$', '') else substring(text, e + 1) end) from x
),
nt as (select distinct tid, entity, unnest(regexp_extract_all(part, '\p{{L}}{{4,}}')) as term from w),
tw as (select distinct tid, term from (select tid, unnest(regexp_extract_all(lower(text), '\p{{L}}{{4,}}')) as term from t)),
total as (select count(*)::double as n from t),
told as (
  select entity, term from (select entity, term, count(*) as both_n from nt group by all having count(*) >= 2)
  join (select entity, count(*) as entity_n from h group by all) using (entity) join (select term, count(*) as term_n from tw group by all) using (term), total
  where entity_n < n and ln(both_n) + ln(n) - ln(term_n) - ln(entity_n) >= 0.75 * (ln(n) - ln(entity_n)) - 1e-12
),
chosen as (select distinct tid, term from tw join told using (term) join h using (tid, entity)),
v as (select tid, unnest({_pieces("text", r"[\p{L}]{4,}")}) as piece, generate_subscripts({_pieces("text", r"[\p{L}]{4,}")}, 1) as i from t where tid in (select tid from chosen)),
y as (select tid, i, lower(piece) as term, coalesce(sum(length(piece)) over (partition by tid order by i rows between unbounded preceding and 1 preceding), 0)::bigint as s, length(piece) as n from v),
z as (select tid, s, s + n as e from y join chosen using (tid, term) where i % 2 = 0),
free as (select r.rid, s, e from z join (select tid, unnest(rids) as rid from t) r using (tid) where not exists (select 1 from b where b.rid = z.tid and b.s < z.e and z.s < b.e)),
base as (select rid, count(*) filter (k = 0) as n_email, count(*) filter (k = 1) as n_ip, count(*) filter (k = 2) as n_card, count(*) filter (k = 3) as n_phone, string_agg(kind || ':' || s || ':' || e, ',' order by k, s) as spans from b group by rid),
terms as (select rid, string_agg('term:' || s || ':' || e, ',' order by s, e) as spans from free group by rid)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
  sha256(coalesce(base.spans, '')) as base_sha256, coalesce(concat_ws(',', base.spans, terms.spans), '') as spans
from d left join base using (rid) left join terms using (rid)
"""


_TAIL = r"([T\x20][0-9]{2}:[0-9]{2}(:[0-9]{2})?(\x20?[AP]M)?(\x20?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?"


def _local(us: str) -> str:
    """Offset, in microseconds, of `zone` at the UTC time `us`."""
    return f"(epoch_us(timezone(zone, timezone('UTC', make_timestamp({us})))) - ({us}))"


op13_timestamp_normalisation = rf"""
with s as (select stamp_id, coalesce('=' || source, 'null') as source, zone, coalesce(regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '') as x from stamps),
f as (
  select *, case when regexp_full_match(x, '[0-9]{{10}}|[0-9]{{13}}') then 'e'
    when regexp_full_match(x, '20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}{_TAIL}') then '-'
    when regexp_full_match(x, '20[0-9]{{6}}{_TAIL}') then 'n'
    when regexp_full_match(x, '[0-9]{{2}}[.][0-9]{{2}}[.]20[0-9]{{2}}{_TAIL}') then '.'
    when regexp_full_match(x, '[0-9]{{2}} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) 20[0-9]{{2}}{_TAIL}') then 'b'
    when regexp_full_match(x, '[0-9]{{2}}/[0-9]{{2}}/20[0-9]{{2}}{_TAIL}') then '/' else 'x' end as form
  from s
),
p as (
  select *, case form when '-' then substr(x, 1, 10) when 'n' then substr(x, 1, 4) || '-' || substr(x, 5, 2) || '-' || substr(x, 7, 2)
      when 'b' then substr(x, 8, 4) || '-' || lpad(((strpos('JanFebMarAprMayJunJulAugSepOctNovDec', substr(x, 4, 3)) + 2) // 3)::varchar, 2, '0') || '-' || substr(x, 1, 2)
      when 'x' then null when 'e' then null else substr(x, 7, 4) || '-' || substr(x, 4, 2) || '-' || substr(x, 1, 2) end as day_text,
    case when form = '/' then substr(x, 7, 4) || '-' || substr(x, 1, 2) || '-' || substr(x, 4, 2) end as month_text,
    case form when 'n' then substr(x, 9) when 'b' then substr(x, 12) else substr(x, 11) end as tail
  from f
),
q as (
  select *, try_cast(day_text as date) as dd, try_cast(month_text as date) as md,
    case when tail = '' then 0 else substr(tail, 2, 2)::int end as h, case when tail = '' then 0 else substr(tail, 5, 2)::int end as mi,
    coalesce(try_cast(regexp_extract(tail, '^.{{6}}:([0-9]{{2}})', 1) as int), 0) as se, regexp_extract(tail, '([AP])M', 1) as half,
    regexp_extract(tail, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$', 1) as off
  from p where form not in ('x', 'e')
),
t as (
  select *, (mi < 60 and se < 60 and (case when half = '' then h < 24 else h between 1 and 12 end)
      and (off in ('', 'Z') or (try_cast(substr(off, 2, 2) as int) <= 14 and try_cast(right(off, 2) as int) < 60)) and (off <> '' or zone is not null) and (dd is not null or md is not null)) as good,
    (((case when half = '' then h else h % 12 + case half when 'P' then 12 else 0 end end) * 60 + mi) * 60 + se)::bigint * 1000000 as clock,
    case when off in ('', 'Z') then 0 else (try_cast(substr(off, 2, 2) as bigint) * 60 + try_cast(right(off, 2) as bigint)) * 60000000 * (case left(off, 1) when '-' then -1 else 1 end) end as shift
  from q
),
v as (select source, sum((md is null)::int) as d, sum((dd is null)::int) as m from t where good and form = '/' group by source),
w as (
  select stamp_id, zone, good, off, form = '/' and dd is not null and md is not null and dd <> md as two, d, m,
    epoch_us((case when form <> '/' or md is null then dd when dd is null then md when d > m then dd else md end)::timestamp) + clock - shift as wall
  from t left join v using (source)
),
z as (select *, {_local("wall - 172800000000")} as o1, {_local("wall + 172800000000")} as o2 from w where good and off = ''),
u as (select *, {_local("wall - o1")} = o1 as ok1, {_local("wall - o2")} = o2 as ok2 from z),
r as (
  select stamp_id, wall - case when ok1 or not ok2 then o1 else o2 end as utc_us, two, d, m, o1 <> o2 and ok1 = ok2 as odd from u
  union all select stamp_id, wall, two, d, m, false from w where good and off <> ''
)
select stamp_id, utc_us::bigint as utc_us, case when not two then 'plain' when d <> m then 'votes' else 'default' end as rule, (two or odd) as ambiguous from r
union all select stamp_id, x::bigint * case length(x) when 10 then 1000000 else 1000 end, 'epoch', false from f where form = 'e'
union all select stamp_id, null, 'bad', false from f where form = 'x'
union all select stamp_id, null, 'bad', false from w where not coalesce(good, false)
"""
