"""SQL that must give the same rows as the queries."""

ORDERS = (2, 3, 4)
_LEVELS = ",\n".join(f"""
c{n} as (select substr(gram, 1, {n - 1}) as context, sum(a) as na, sum(b) as nb,
    count(*) filter (a > 0) as ta, count(*) filter (b > 0) as tb from g{n} group by 1),
p{n} as (select gram,
    case when na = 0 then pa else (a + ta * pa) / (na + ta) end as pa,
    case when nb = 0 then pb else (b + tb * pb) / (nb + tb) end as pb
  from (select g{n}.gram, a::double as a, b::double as b, na::double as na, nb::double as nb,
      ta::double as ta, tb::double as tb, pa, pb
    from g{n} join c{n} on c{n}.context = substr(g{n}.gram, 1, {n - 1})
    join p{n - 1} on p{n - 1}.gram = substr(g{n}.gram, 2, {n - 1})))""" for n in ORDERS)

URLS = rf"""
with cut as (
  select page_id, coalesce(url, '') as text,
    case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages),
parts as (
  select page_id, text, regexp_extract(rest, '^[^/?#]*') as raw, rest from cut),
named as (
  select page_id, text,
    translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from parts),
ruled as (
  select *, case
      when (host = 'www.example.com' or host like '%.www.example.com') and path like '/en/%' then 'www.example.com/en/'
      when (host = 'example.com' or host like '%.example.com') and path like '/en/%' then 'example.com/en/'
      when (host = 'net' or host like '%.net') and path like '/es/%' then 'net/es/'
      when (host = 'net' or host like '%.net') and path like '/fr/%' then 'net/fr/'
      when (host = 'com' or host like '%.com') and path like '/%' then 'com/' end as rule from named),
judged as (
  select *, case when rule in ('www.example.com/en/', 'com/') then 'allow'
                 when rule is not null then 'block' end as action from ruled),
texts as (
  select text, action, count(*) as n, substr(md5(text), 1, 1) in
    ('0','1','2','3','4','5','6','7','8','9','a','b') as trains from judged group by text, action),
grams as (
  select text, action, trains, n, unnest([substr(chr(2) || chr(2) || chr(2) || text || chr(3), i, 4)
    for i in range(1, length(text) + 2)]) as gram from texts),
g4 as (select gram, sum(case when trains and action = 'allow' then n else 0 end) as a,
         sum(case when trains and action = 'block' then n else 0 end) as b from grams group by gram),
g3 as (select substr(gram, 2) as gram, sum(a) as a, sum(b) as b from g4 group by 1),
g2 as (select substr(gram, 2) as gram, sum(a) as a, sum(b) as b from g3 group by 1),
g1 as (select substr(gram, 2) as gram, sum(a) as a, sum(b) as b from g2 group by 1),
p1 as (select gram, (a::double + 1) / ((select sum(a) from g1)::double + 256) as pa,
         (b::double + 1) / ((select sum(b) from g1)::double + 256) as pb from g1),
{_LEVELS},
scores as (
  select text, floor(sum(round(ln(pa / pb) * 1e6)::bigint)::double / (length(text) + 1) / 1000)::bigint as score
  from grams join p4 using (gram) group by text),
levels as (
  select score as level, count(*) filter (action = 'allow') as a, count(*) filter (action = 'block') as b
  from texts join scores using (text) where not trains and action is not null group by 1),
gains as (
  select level, round(sum(a) over (order by level desc)::double / (select sum(a) from levels)
    - sum(b) over (order by level desc)::double / (select sum(b) from levels), 9) as gain,
    floor((level + coalesce(lead(level) over (order by level desc), level)) / 2.0)::bigint as cut from levels),
chosen as (
  select coalesce((select case when (select sum(a) from levels) > 0 and (select sum(b) from levels) > 0
    then (select cut from gains order by gain desc, level limit 1) end), 0) as threshold)
select page_id, host, path, rule,
  coalesce(action, case when score >= threshold then 'allow' else 'block' end) as verdict,
  score, threshold
from judged join scores using (text), chosen
"""

_UNIFORM = "('0x' || substr(md5({0}), 1, 13))::bigint::double / 4503599627370496"
MIXED = f"""
with sizes as (select source, sum(coalesce(length(text), 0)) as chars from documents group by 1),
shares as (select source, chars, case when chars > 0 then pow(chars::double, 0.5) else 0 end as share from sizes),
rates as (select source, case when chars > 0 then round(share / (select sum(share) from shares)
    * (select sum(chars) from shares)::double / chars, 9) else 1.0 end as rate from shares),
steps as (select source, rate, greatest(ceil(rate / 8.0)::int, 1) as draws,
    rate / greatest(ceil(rate / 8.0)::int, 1) as each from rates),
terms as (select source, k, sum(exp(-each) * pow(each, k) / factorial(least(k, 33)::int)
    / case when k > 33 then exp(lgamma(k + 1) - lgamma(34)) else 1 end)
    over (partition by source order by k) as passed
  from steps, range(0, 81) as t(k)),
drawn as (select d.doc_id, d.source, rate, j,
    {_UNIFORM.format("concat_ws(':', '17', coalesce(d.doc_id::varchar, ''), j::varchar)")} as u
  from documents d join steps s on d.source is not distinct from s.source, range(1, draws + 1) as t(j)),
counted as (select distinct doc_id, source, rate, j, (select count(*) from terms
    where terms.source is not distinct from drawn.source and passed <= u and k < 80) as k from drawn),
copies as (select doc_id, source, rate, sum(k)::int as copies from counted group by all)
select d.*, rate, i::int as copy, md5(concat_ws(':', '17', 'order', coalesce(d.doc_id::varchar, ''), i::varchar)) as shuffle_key
from documents d join copies c on d.doc_id is not distinct from c.doc_id and d.source is not distinct from c.source,
  range(1, copies + 1) as t(i)
"""

EXACT = r"""
with norm as (select doc_id, length(coalesce(text, '')) as chars,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as content from documents),
ranked as (select doc_id, content, count(*) over (partition by content) as group_size,
    first_value(doc_id) over (partition by content order by chars desc, doc_id nulls last) as keep_id from norm)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept,
  sha256(content) as text_sha256 from ranked
"""

ARCHIVED = """
with bodies as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes,
    sha256(coalesce(html, '')) as payload_digest from pages),
firsts as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first
  from bodies)
select page_id, payload_bytes, payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when first is not null and page_id is distinct from first then first end as refers_to
from firsts
"""

NEAR = r"""
with recursive words as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])) end as s from words),
classed as (select doc_id, s, len(s) as size,
    case when len(s) = 0 then doc_id else min(doc_id) over (partition by s) end as class_id,
    case when len(s) = 0 then 1 else count(*) over (partition by s) end as class_size from sets),
items as materialized (select doc_id, size, unnest(s) as item from classed where doc_id = class_id),
pairs as materialized (select a.doc_id as x, b.doc_id as y from items a join items b on a.item = b.item and a.doc_id <> b.doc_id
    and least(a.size, b.size) * 5 >= greatest(a.size, b.size) * 4
    group by a.doc_id, b.doc_id, a.size, b.size having count(*) * 9 >= 4 * (a.size + b.size)),
reach as (select x, y from pairs union select r.x, p.y from reach r join pairs p on p.x = r.y)
select doc_id, class_id, class_size, (select count(*) from pairs where x = class_id) as n_links,
  least(class_id, coalesce((select min(y) from reach where x = class_id), class_id)) as group_id
from classed
"""

NEAREST = """
with v as (select distinct vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
    and len([x for x in embedding if x <> 0]) > 0),
sized as (select *, row_number() over () as query from v
  where len(e) = (select len(e) from v group by 1 order by count(*) desc, 1 limit 1)),
scored as (select q.query, q.vec_id as query_id, c.vec_id,
    list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)]) as score
  from sized q join sized c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""

HARD = """
with whole as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * x::double)::bigint for x in embedding] as w from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
numbered as (select *, row_number() over () as n from whole),
scored as (select a.n as anchor, a.vec_id as anchor_id, r.vec_id, a.label = r.label as same,
    coalesce(list_sum([a.w[i] * r.w[i] for i in range(1, least(len(a.w), len(r.w)) + 1)]), 0)::bigint as score
  from numbered a join numbered r on a.vec_id % 100 = 0 and (a.vec_id <> r.vec_id or a.label <> r.label)),
positives as (select anchor, anchor_id, vec_id as positive_id, score as positive_score,
    row_number() over (partition by anchor order by score desc, vec_id) as p from scored where same qualify p <= 5),
negatives as (select p.anchor_id, p.positive_id, s.vec_id as negative_id, p.positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor, p.p order by s.score desc, s.vec_id)::int as rank
  from positives p join scored s on s.anchor = p.anchor and not s.same
    and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from negatives where rank <= 5
"""
