"""Comparison SQL of the operators that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

URLS = r"""
with parts as (
  select page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(rule_host, rule_path, rule_verdict) as (values
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
patterns as (
  select *, case
    when regexp_matches(host || path, '(^|[./-])cheap-pills([./-]|$)') then 'pills'
    when regexp_matches(host || path, '(^|[./-])(online-)?casino([./-]|$)') then 'casino'
    when regexp_matches(host || path, '^ads?\.[^/]*/') then 'adserver'
    when regexp_matches(host || path, '/(wp-)?login\.php(/|$)') then 'login'
    when regexp_matches(host || path, '/cart/checkout(/|$)') then 'cart' end as pat
  from parts),
best as (
  select p.*, (select arg_max(struct_pack(r := rule_host || rule_path, v := rule_verdict), length(rule_host || rule_path)) from rules
               where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)) as b
  from patterns p)
select page_id, host, path, b.r as rule, coalesce(b.v, case when pat is not null then 'block' else 'allow' end) as verdict,
       case when b.r is null then pat end as pattern
from best"""

MIXING = rf"""
with sized as (
  select doc_id, source, cast(len({WORDS}) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 9) as bigint) as place
  from documents),
per as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
ranked as (select *, row_number() over (order by source is null, source) - 1 as n from per),
weighed as (select *, 3 * source_size as cap, case n % 3 when 0 then 5 when 1 then 2 else 1 end as w from ranked),
levels as (
  select *, cast(sum(source_size) over () - coalesce(sum(cap) over before, 0) as double)
            / cast(sum(w) over () - coalesce(sum(w) over before, 0) as double) as lvl
  from weighed window before as (order by cap / w, n rows between unbounded preceding and 1 preceding)),
share as (select arg_min(lvl, cap / w) as lvl from levels where not (cap < lvl * w)),
goal as (select source, source_size, least(cast(cap as double), coalesce((select lvl from share) * w, cap)) as target from levels),
budget as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from goal),
places as (
  select source, place, sum(size) as size, sum(sum(size)) over (partition by source order by place) as upto
  from sized group by source, place)
select s.doc_id, s.size, b.source_size, b.target,
       cast(s.size * least(3, b.whole + case when p.upto - p.size / 2.0 <= b.target - b.whole * b.source_size then 1 else 0 end) as bigint) as taken
from sized s join budget b on s.source is not distinct from b.source
join places p on s.source is not distinct from p.source and s.place = p.place"""

QUALITY = rf"""
with rows as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text, {WORDS} as w from documents),
pos as (select r, w, unnest(generate_series(1, len(w) - 2)) as i from rows where len(w) >= 3),
grams as (select r, i, count(*) over (partition by r, w[i], w[i + 1], w[i + 2]) as n from pos),
covered as (select r, count(distinct j) as n from (select r, unnest([i, i + 1, i + 2]) as j from grams where n > 1) group by r),
counted as (
  select doc_id, source, cast(len(w) as bigint) as n_words,
         cast(length(array_to_string(w, '')) as bigint) as word_chars,
         cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
         cast(len([x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')])
              - len(list_distinct([x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')])) as bigint) as n_dup_lines,
         cast(coalesce(c.n, 0) as bigint) as n_repeat_words
  from rows left join covered c using (r)),
rules as (
  select *, n_words < 50 as few_words, 100 * n_repeat_words > 50 * n_words as repeated_words, 10 * n_symbols > n_words as symbols,
         10 * n_dup_lines > n_words as repeated_lines, word_chars < 2 * n_words or word_chars > 15 * n_words as word_length
  from counted),
long_ as (
  unpivot (select source, cast(few_words as int) few_words, cast(repeated_words as int) repeated_words, cast(symbols as int) symbols,
                  cast(repeated_lines as int) repeated_lines, cast(word_length as int) word_length from rules)
  on few_words, repeated_words, symbols, repeated_lines, word_length into name rule value f),
hosts as (select rule, source, count(*)::double as n, sum(f)::double as f from long_ group by rule, source),
means as (select rule, sum(f) / sum(n) as m, sum(n) as docs, count(*) as hosts from hosts group by rule),
spread as (select rule, m, docs, hosts, sum(n * (f / n - m) * (f / n - m)) as s from hosts join means using (rule) group by all),
prior as (
  select rule, m, case when docs > hosts and m > 0 and m < 1 then least(1.0, greatest(0.0, (s / (m * (1 - m)) - hosts) / (docs - hosts))) else 0.0 end as rho
  from spread),
rated as (
  select source, max(case when rho > 0 then (f + (1 / rho - 1) * m) / (n + (1 / rho - 1)) else m end) as rate
  from hosts join prior using (rule) group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words or repeated_words as base_failed,
       not (few_words or repeated_words) and rate <= 0.5 as kept
from rules join rated on rules.source is not distinct from rated.source"""


TOP_K = r"""
with ints as (
  select vec_id, [cast(floor(cast(x as double) * 256) as bigint) for x in embedding] as v
  from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from ints q join ints c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, cast(r as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored) where r <= 5"""

PHRASES = r"""
with texts as (
  select row_number() over () as d, coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents),
cut as (select d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from texts),
pieces as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from cut),
places as (select lang, w, unnest(generate_series(1, len(w))) as i from pieces where len(w) > 0),
grams as (select lang, w[i:i + s - 1] as g from places, (values (1), (2), (3), (4)) as sizes(s) where i + s - 1 <= len(w)),
totals as (select lang, sum(len(w)) as n from pieces group by lang),
freq as (select lang, g, count(*) as f from grams group by lang, g having count(*) >= 30),
cand as (select lang, g, f as a from freq where len(g) >= 2),
cuts as (select lang, g, a, unnest(generate_series(1, len(g) - 1)) as k from cand),
scored as (
  select c.lang, c.g, c.a, c.k, x.f as l, y.f as r, (2000000::hugeint * c.a) // (x.f + y.f) as score
  from cuts c join freq x on x.lang = c.lang and x.g = c.g[1:c.k] join freq y on y.lang = c.lang and y.g = c.g[c.k + 1:]),
lowest as (select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1),
inner_ as (
  select lang, g[i:i + s - 1] as g, max(a) as longer
  from (select lang, g, a, s, unnest(generate_series(1, len(g) - s + 1)) as i from cand, (values (2), (3)) as sizes(s) where s < len(g))
  group by all),
kept as (
  select lowest.*, array_to_string(g, ' ') as phrase from lowest left join inner_ using (lang, g)
  where longer is null or 100::hugeint * longer < 80::hugeint * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked join totals using (lang) where rank <= 2000"""
