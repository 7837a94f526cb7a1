"""DuckDB SQL for the queries that SQL can express over the test tables."""

from __future__ import annotations

import math

from .license_scan import CONTAINMENT, PHRASES, TEMPLATES, _cut
from .url_reputation import MAX_STRENGTH, MIN_STRENGTH, SUFFIXES, THRESHOLD, Z


def _strength(groups: str) -> str:
    return f"""(select coalesce(case when observed <= sampling then {MAX_STRENGTH!r}::double
        else least({MAX_STRENGTH!r}::double, greatest({MIN_STRENGTH!r}::double, spread / (observed - sampling) - 1)) end, {MIN_STRENGTH!r}::double)
      from (select sum(n * (good / n - parent) * (good / n - parent)) as observed, sum(parent * (1 - parent)) as sampling,
                   sum((n - 1) * parent * (1 - parent)) as spread from {groups} where n > 0))"""


_plain = "(" + ", ".join(f"'{x}'" for x in SUFFIXES if not x.startswith("*")) + ")"
_wild = "(" + ", ".join(f"'{x[2:]}'" for x in SUFFIXES if x.startswith("*")) + ")"
_URL = f"""
with split as (
  select page_id,
    lower_host as host, path
  from (select page_id,
          translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_host,
          coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
        from pages)),
sited as (select *, regexp_replace(regexp_replace(host, '^.*@', '', 's'), '\\.*(:[0-9]*)?$', '') as site from split),
ruled as (
  select *, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from sited),
outcome as (
  select page_id, count(*) as n, sum(quality) as good
  from (select page_id, try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})', 1), '') as bigint) as doc_id from split)
  join labels using (doc_id) where quality is not null and page_id is not null group by page_id),
counted as (select site, coalesce(sum(n), 0)::double as n, coalesce(sum(good), 0)::double as good from sited left join outcome using (page_id) group by site),
parts as (
  select *, string_split(site, '.') as p, regexp_full_match(site, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}|\\[.*\\]') as numeric,
    case when array_to_string(p[-2:], '.') in {_plain} then 2 when len(p) >= 2 and p[-1] in {_wild} then 2 else 1 end as k
  from counted),
hosts as (
  select site as host, n, good, case when numeric then '[address]' else array_to_string(p[-k:], '.') end as suffix,
    case when numeric then site else array_to_string(p[-(k + 1):], '.') end as domain
  from parts),
domains as (select domain, suffix, sum(n) as n, sum(good) as good from hosts group by domain, suffix),
suffixes as (select suffix, sum(n) as n, sum(good) as good, (select coalesce(sum(good) / nullif(sum(n), 0), 0.5) from domains) as parent from domains group by suffix),
suffix_mean as (select suffix, (s * parent + good) / (s + n) as parent from suffixes, (select {_strength('suffixes')} as s)),
domain_in as (select domain, suffix, n, good, parent from domains join suffix_mean using (suffix)),
domain_mean as (select domain, suffix, (s * parent + good) / (s + n) as parent from domain_in, (select {_strength('domain_in')} as s)),
host_in as (select host, n, good, parent from hosts join domain_mean using (domain, suffix)),
host_mean as (select host, n, good, s + n as total, (s * parent + good) / (s + n) as mean from host_in, (select {_strength('host_in')} as s)),
bound as (select host as site, n, good, mean, mean - {Z} * sqrt(mean * (1 - mean) / (total + 1)) as lower from host_mean)
select page_id, host, path, rule,
  case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
       when lower >= {THRESHOLD} then 'allow' else 'block' end as verdict,
  n::bigint as n_labelled, good::bigint as n_good, round(mean, 9) as mean, round(lower, 9) as lower
from ruled join bound using (site)
"""

_CHAT = """
with t as (select distinct conv_id, turn, role, text from conversations),
p as (select distinct conv_id, role as perspective from t where role <> '' and role <> 'system'),
j as (
  select t.conv_id, perspective, turn, role, text,
    case when turn is null then -1 else greatest(0, turn) // 256 end as segment,
    coalesce(role = perspective, false) as own,
    case when role = 'system' then '<|system|>' || chr(10) when role = perspective then '<|assistant|>' || chr(10)
         else '<|user|>' || coalesce(role, '') || chr(10) end as header,
    replace(coalesce(text, ''), '<|', '< |') as body
  from t join p on t.conv_id is not distinct from p.conv_id),
m as (
  select *, coalesce(sum(length(header) + length(body) + 8) over (partition by conv_id, perspective, segment
      order by turn nulls first, role nulls first, text nulls first rows between unbounded preceding and 1 preceding), 0) + length(header) as begins
  from j)
select conv_id, perspective, segment::bigint as segment, count(*)::bigint as n_turns, sum(own::int)::bigint as n_trained,
  string_agg(header || body || '<|end|>' || chr(10), '' order by turn nulls first, role nulls first, text nulls first) as rendered,
  coalesce(string_agg(case when own then begins::bigint::varchar || '-' || (begins + length(body) + 7)::bigint::varchar end, ','
    order by turn nulls first, role nulls first, text nulls first), '') as spans
from m group by conv_id, perspective, segment
"""

_SHINGLES = """
w as (
  select rowid as r, doc_id, [x for x in string_split(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' ') if x <> ''] as w
  from (select *, row_number() over () as rowid from documents)),
s as (
  select r, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(list_slice(w, i, i + 4), ' ') for i in range(1, len(w) - 3)]) end as s from w)
"""

_JOIN = f"""
with recursive {_SHINGLES.strip()},
size as (select r, doc_id, len(s) as n from s),
g as (select r, unnest(s) as g from s),
link as (
  select a.r as x, b.r as y from g a join g b on a.g = b.g and a.r <> b.r
  join size sa on sa.r = a.r join size sb on sb.r = b.r
  group by a.r, b.r, sa.n, sb.n having 100 * count(*) >= 80 * (sa.n + sb.n - count(*))),
reach as (select r as x, r as y from size union select reach.x, link.y from reach join link on link.x = reach.y),
least as (select x, min(size.doc_id) as component_id from reach join size on size.r = reach.y group by x),
degree as (select x, count(*) as n_links from link group by x)
select size.doc_id, size.n::bigint as n_shingles, least.component_id, coalesce(degree.n_links, 0)::bigint as n_links
from size join least on least.x = size.r left join degree on degree.x = size.r
"""


def _scan() -> str:
    longest = max(len(_cut(t)) for t in TEMPLATES)
    templates = ", ".join(f"('{label}', {sorted(set(_cut(t)))!r}, {math.ceil(CONTAINMENT * len(set(_cut(t))) - 1e-9)})" for t, label in TEMPLATES.items())
    known = sorted({w for t in TEMPLATES for w in _cut(t)})
    places = " union all ".join(
        f"select r, i, '{label}' as label from spot where "
        + " and ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(phrase.split()))
        for phrase, label in PHRASES.items()
    )
    return f"""
with d as (
  select r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w
  from (select *, row_number() over () as r from documents)),
spot as (select r, w, unnest(range(0, len(w))) as i from d),
places as ({places}),
base as (select r, count(*) as n, min(i) as a, max(i) as z, list_sort(list_distinct(list(label))) as labels from places group by r),
t(label, own, need) as (values {templates}),
hit as (
  select r, label, c / len(own) as c from (
    select spot.r, t.label, t.own, t.need, len(list_intersect(list_distinct(list_slice(w, i + 1, i + {2 * longest})), t.own)) as c
    from spot, t where list_contains({known}, w[i + 1])) where c >= need),  -- a block that starts elsewhere holds no more than the next of these
method as (select r, list(distinct label) as labels, max(c) as c from hit group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(base.n, 0)::bigint as n_base, base.a::bigint as first_word, base.z::bigint as last_word,
  coalesce(array_to_string(base.labels, ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(method.labels, [])))), ','), '') as labels,
  case when base.n > 0 then 1.0 else coalesce(method.c, 0.0) end::double as score
from d left join base on base.r = d.r left join method on method.r = d.r
"""


_LEAKS = f"""
with {_SHINGLES.strip().split("s as (")[0].rstrip().rstrip(",")},
g as (select r, doc_id, [array_to_string(list_slice(w, i, i + 4), ' ') for i in range(1, len(w) - 3)] as g from w where len(w) >= 5),
item as (
  select item_id, [array_to_string(list_slice(w, i, i + 4), ' ') for i in range(1, len(w) - 3)] as g
  from (select item_id, [x for x in string_split(translate(text,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' ') if x <> ''] as w from benchmark)
  where len(w) >= 5),
place as (select r, g.g as own, unnest(range(1, len(g.g) + 1)) as p, unnest(g.g) as x from g),
mark as (select item_id, len(g) as size, unnest(range(1, len(g) + 1)) as q, unnest(g) as x from item),
window_at as (select distinct r, size, greatest(0, least(p - q, len(own) - size)) as a from place join mark using (x)),
shown as (select r, window_at.size, a, list_slice(g.g, a + 1, a + window_at.size) as seen from window_at join g using (r)),
tf as (select r, size, a, len(seen) as length, x, count(*) as n from (select r, size, a, seen, unnest(seen) as x from shown) group by all),
itf as (select item_id, size, x, count(*) as m from mark group by all),
common as (select r, item_id, tf.size, a, length, sum(least(n, m)) as same from tf join itf on tf.x = itf.x and tf.size = itf.size group by all),
scored as (select r, item_id, a, same / (size + length - same) as similarity from common where same / (size + length - same) >= 0.8)
select doc_id, item_id, first_word::bigint as first_word, round(similarity, 6) as similarity from (
  select r, item_id, max(similarity) as similarity, min(a) filter (where similarity = top) as first_word
  from (select *, max(similarity) over (partition by r, item_id) as top from scored) group by r, item_id)
join g using (r)
"""

ORACLE = {
    "op1_url_reputation": _URL,
    "op2_chat_rotation": _CHAT,
    "op4_partenum": _JOIN,
    "op5_simhash_windows": _LEAKS,
    "op6_license_scan": _scan(),
}
