"""DuckDB SQL with the same results as the queries, for the operators that SQL can express."""

from __future__ import annotations

from runledger.llm.license_scan import NAMES, NOTICES, SPELLINGS, TEXTS
from runledger.llm.url_reputation import LIMIT, LOWER, RULES, TWO_LABEL_SUFFIXES, UPPER, Z

JACCARD_JOIN = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s
  from words),
entries as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (
  select a.doc_id as a, b.doc_id as b from entries a join entries b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach as (
  select doc_id, doc_id as r from sets
  union
  select reach.doc_id, links.b from reach join links on reach.r = links.a)
select s.doc_id, len(s.s) as n_shingles, min(r.r) as component_id from sets s join reach r on s.doc_id = r.doc_id group by s.doc_id, len(s.s)
"""

TOPK = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select * from r where rank <= 5
"""

FILTER_AUDIT = r"""
with words as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
copies as (select t, min(doc_id) as first_id from words group by t),
marks as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
cells as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, count(*) as n,
    case when len(w) < 200 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
    + case when 100 * length(regexp_replace(words.t, '[^A-Z]', '', 'g')) > 3 * length(words.t) then 4 else 0 end
    + case when regexp_matches(words.t, '[#$%&*|]') then 8 else 0 end + case when words.doc_id > first_id then 16 else 0 end as bits
  from words join copies on words.t = copies.t left join marks on words.doc_id = marks.doc_id group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order from l a, l b, l c, l d, l e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
met as (
  select *, list_min(list_filter([1, 2, 3, 4, 5], lambda s: (bits >> (strpos('ABCDE', substr(filter_order, s, 1)) - 1)) % 2 = 1)) as hit from cells, orders),
steps as (
  select part, filter_order, step, substr(filter_order, step, 1) as f,
    sum(case when hit is null or hit > step then n else 0 end)::bigint as kept, sum(case when hit = step then n else 0 end)::bigint as removed,
    sum(case when hit < step and (bits >> (strpos('ABCDE', substr(filter_order, step, 1)) - 1)) % 2 = 1 then n else 0 end)::bigint as redundant,
    sum(case when bits = 1 << (strpos('ABCDE', substr(filter_order, step, 1)) - 1) then n else 0 end)::bigint as unique_fails,
    sum(case when hit = step then n * good else 0 end)::bigint as good_lost, sum(case when hit = step then n * toxic else 0 end)::bigint as toxic_lost
  from met, (select unnest([1, 2, 3, 4, 5]) as step) s group by part, filter_order, step)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from steps
"""

DIVERGENCE = r"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
terms as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term from terms group by lang, term having count(distinct r) >= 3),
sizes as (select lang, count(*) as v from kept group by lang),
own as (select distinct lang, source from docs),
counts as (select lang, source, term, count(*) as c from terms semi join kept using (lang, term) group by lang, source, term),
totals as (select lang, source, sum(c) as n from counts group by lang, source),
p as (
  select lang, source, term, coalesce(c, 0) as c, (1 + 1000000000::hugeint * (coalesce(c, 0) + 1) // (coalesce(n, 0) + v))::bigint as p
  from own join kept using (lang) join sizes using (lang) left join totals using (lang, source) left join counts using (lang, source, term)),
q as (
  select lang, term, (1 + 1000000000::hugeint * (sum(c) + 1) // (sum(sum(c)) over (partition by lang) + any_value(v)))::bigint as q
  from counts join sizes using (lang) group by lang, term),
sums as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
found as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from own a join own b on a.lang = b.lang and a.source <> b.source left join sums on sums.lang = a.lang and sums.source = a.source and sums.item = b.source
  union all
  select p.lang, source, 'term', p.term, ((p - q) * (p - q) // q)::bigint from p join q on p.lang = q.lang and p.term = q.term where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank from found)
select * from ranked where part = 'pair' or rank <= 200
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    out = f"translate({column}, '{UPPER}', '{LOWER}')"
    out = rf"regexp_replace({out}, '(^|\n)[ \t]*(copyright|\(c\)|©|portions copyright)[^\n]*', '\1', 'g')"
    out = f"' ' || trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g')) || ' '"
    out = f"replace({out}, ' ', '  ')"
    for spelling, plain in SPELLINGS:
        out = f"replace({out}, ' {spelling.replace(' ', '  ')} ', ' {plain.replace(' ', '  ')} ')"
    return f"trim(replace({out}, '  ', ' '))"


def license_scan() -> str:
    rows = [("text", k, v) for k, v in TEXTS.items()] + [("notice", k, form.format(name)) for k, names in NAMES.items() for name in names for form in NOTICES]
    values = ", ".join(f"('{kind}', '{name}', {_text(text)})" for kind, name, text in rows)
    return f"""
with known as (
  select kind, sha256({_canonical("t")}) as digest, min(license) as license from (values {values}) as x(kind, license, t) group by all),
whole as (select doc_id, sha256({_canonical("text")}) as digest from documents),
lines as (select doc_id, sha256({_canonical("line")}) as digest from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)),
named as (
  select doc_id, string_agg(distinct license, ',' order by license) as notices
  from lines join known on lines.digest = known.digest and kind = 'notice' group by doc_id)
select w.doc_id, k.license, coalesce(n.notices, '') as notices
from whole w left join known k on w.digest = k.digest and k.kind = 'text' left join named n on w.doc_id = n.doc_id
"""


def url_reputation() -> str:
    two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    fits = {(h, p): f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for h, p, _ in RULES}
    longest = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    rule = "case " + " ".join(f"when {fits[h, p]} then '{h}{p}'" for h, p, _ in longest) + " end"
    verdict = "case " + " ".join(f"when {fits[h, p]} then '{v}'" for h, p, v in longest) + " end"

    def strength(level: str, parent: str, above: str) -> str:
        return f"""(select case when rho is null then 9.0 else (1 - rho) / rho end from (
  select case when free > 0 and total - own - free > 0 then least(greatest((s - free) / (total - own - free), 0.001), 0.999) end as rho from (
  select sum(l.n * pow(l.bad / l.n - p.bad / p.n, 2) / ((p.bad / p.n) * (1 - p.bad / p.n))) as s, count(*) - count(distinct p.name) as free,
    sum(l.n) as total, sum(l.n * l.n / p.n) as own
  from {level} l join {parent} p on l.{above} = p.name where p.bad > 0 and p.bad < p.n)))"""

    def posterior(level: str, parent: str, above: str, prior: str) -> str:
        return f"""(select l.name, l.bad + k.k * (p.a / (p.a + p.b)) as a, l.n - l.bad + k.k * (1 - p.a / (p.a + p.b)) as b
  from {level} l join {prior} p on l.{above} = p.name, (select {strength(level, parent, above)} as k) k)"""

    return f"""
with rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
parsed as (
  select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from rest),
named as (
  select host, case when two in ({two}) then three else two end as domain, case when two in ({two}) then two else one end as suffix
  from (select host, array_to_string(p[-3:], '.') as three, array_to_string(p[-2:], '.') as two, p[-1] as one
    from (select distinct host, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') as p from parsed))),
hosts as (
  select p.host as name, n.domain, n.suffix, sum(case when l.quality = 0 or l.toxic = 1 then 1.0::double else 0 end) as bad, count(*)::double as n
  from parsed p join labels l on l.doc_id = p.page_id join named n on n.host = p.host group by all),
domains as (select domain as name, suffix, sum(bad) as bad, sum(n) as n from hosts group by all),
suffixes as (select suffix as name, '' as everything, sum(bad) as bad, sum(n) as n from domains group by all),
whole as (select '' as name, coalesce(sum(bad), 0) as bad, coalesce(sum(n), 0) as n from suffixes),
p0 as (select name, bad + 1 as a, n - bad + 1 as b from whole),
p1 as {posterior("suffixes", "whole", "everything", "p0")},
p2 as {posterior("domains", "suffixes", "suffix", "p1")},
p3 as {posterior("hosts", "domains", "domain", "p2")},
judged as (
  select n.host, coalesce(h.a, d.a, s.a, o.a) as a, coalesce(h.b, d.b, s.b, o.b) as b
  from named n left join p3 h on n.host = h.name left join p2 d on n.domain = d.name left join p1 s on n.suffix = s.name, p0 o)
select page_id, p.host, path, {rule.replace("host", "p.host")} as rule,
  coalesce({verdict.replace("host", "p.host")}, case when a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {LIMIT} then 'block' else 'allow' end) as verdict
from parsed p join judged j on p.host = j.host
"""
