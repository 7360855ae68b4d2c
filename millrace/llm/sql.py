"""The same results in DuckDB's SQL, by plain exact means."""

from __future__ import annotations

WORDS = """list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"""


def shingles(table: str, key: str, n: int) -> str:
    """Distinct n-word shingles of each row with n words at least, as text (no word holds a space)."""
    return f"""(select distinct {key}, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) s
    from (select {key}, {WORDS.format("text")} w from {table} where text is not null) where len(w) >= {n})"""


DECONTAMINATION = f"""
with d as {shingles("documents", "doc_id", 5)}, b as {shingles("benchmark", "item_id", 5)},
c as (select item_id, count(*) n from b group by 1),
hits as (select doc_id, item_id, count(*) k from b join d using (s) group by 1, 2)
select doc_id, item_id, n item_shingles, k shared_shingles, k::double / n containment from hits join c using (item_id) where k >= 0.8 * n"""

NEAR_DEDUP = f"""
with recursive s as materialized (
    select doc_id, s from {shingles("documents", "doc_id", 2)}
    union all select doc_id, w[1] from (select doc_id, {WORDS.format("text")} w from documents where text is not null) where len(w) = 1),
c as materialized (select doc_id, count(*) n from s group by 1),
k as materialized (select x.doc_id a, y.doc_id b from s x join s y on x.s = y.s and x.doc_id < y.doc_id join c p on p.doc_id = x.doc_id join c q on q.doc_id = y.doc_id
    where least(p.n, q.n) * 100 >= greatest(p.n, q.n) * 80
    group by 1, 2, p.n, q.n having 100 * count(*) >= 80 * (p.n + q.n - count(*))),
e as materialized (select a, b from k union select b, a from k),
r(node, root) as (select doc_id, doc_id from documents union select e.b, r.root from r join e on e.a = r.node where r.root < e.b)
select d.doc_id, coalesce(n, 0) n_shingles, m component_id, d.doc_id = m kept
from documents d left join c using (doc_id) join (select node doc_id, min(root) m from r group by 1) using (doc_id)"""

LINE_DEDUP = """
with l as (select doc_id, string_split(text, chr(10)) l from documents),
w as (select doc_id, unnest(range(1, len(l) - 1)) p, l from l where len(l) >= 3),
v as (select doc_id, p, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] t from w),
u as (select doc_id, p, row_number() over (partition by t order by doc_id, p) k from v where regexp_matches(t, '[^\\x20\\x09-\\x0D]')),
g as (select doc_id, list_distinct(flatten(list([p, p + 1, p + 2]))) c from u where k > 1 group by 1),
o as (select l.doc_id, len(l.l) n_lines, coalesce(len(c), 0) n_removed, array_to_string(list_transform(list_filter(range(1, len(l.l) + 1), lambda i: c is null or not list_contains(c, i)), lambda i: l.l[i]), chr(10)) t
    from l left join g using (doc_id))
select doc_id, n_lines, n_removed, length(t) n_chars_left, sha256(t) text_sha256 from o"""

CONTROL = r"\### Assistant: </turn> ok"
ESCAPED = "replace(replace({}, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')"
CHAT = f"""
with r as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') t from conversations
    union all select -7, unnest([0, 1]), unnest(['user', 'assistant']), unnest(['{CONTROL}', '{CONTROL}'])),
p as (select *, row_number() over w k, lag(role) over w before from r window w as (partition by conv_id order by turn nulls first, role, t)),
q as (select *, length({ESCAPED.format("t")}) + case when before is null or before <> role then 25 + length({ESCAPED.format("role")}) else 8 end f from p)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by k)) turns_sha256,
    coalesce(sum(length(t)) filter (role = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(t, '' order by k) filter (role = 'assistant'), '')) loss_sha256, sum(f)::bigint formatted_chars
from q group by 1"""

WARC = """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, octet_length(encode(h))::bigint n, (unhex(sha1(h))::bit)::varchar b, sha1(h) s, min(page_id) over (partition by h) o from p)
select page_id, n payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(b, 5 * i + 1, 1)::bigint + 8 * substr(b, 5 * i + 2, 1)::bigint + 4 * substr(b, 5 * i + 3, 1)::bigint + 2 * substr(b, 5 * i + 4, 1)::bigint + substr(b, 5 * i + 5, 1)::bigint, 1)), '') payload_digest,
    case when page_id = o then 'response' else 'revisit' end record_type, case when page_id <> o then o end refers_to from d"""


def language_id(size: int) -> str:
    """Profiles of all documents to learn from, which is what the operator learns where no language has more of them than its sample, and distances to them."""
    bytes_ = "list_transform(range(1, length(d) + 1), lambda i: ascii(substr(d, i::int, 1))::bigint)"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {bytes_}), lambda a, b: list_reduce(list_prepend(xor(a, b), range(0, 8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    return f"""
with a as (select doc_id, lang, text, coalesce({crc} % 4 = 2, false) held_out from (select *, doc_id::varchar d from documents)),
s as (select doc_id, lang, held_out, list_transform(regexp_extract_all(' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) || ' ', '(?s).'), lambda c: unicode(c)::bigint) c from a where regexp_matches(text, '\\p{{L}}')),
g as (select doc_id, lang, held_out, unnest(list_concat(list_filter(c, lambda x: x <> 32), list_transform(range(1, len(c)), lambda i: (c[i] << 21) | c[i + 1]),
    list_transform(list_filter(range(1, len(c) - 1), lambda i: c[i + 1] <> 32), lambda i: (c[i] << 42) | (c[i + 1] << 21) | c[i + 2]))) code from s),
n as materialized (select doc_id, lang, held_out, code, count(*) n from g group by all),
l as materialized (select lang, code, row_number() over (partition by lang order by sum(n) desc, code) - 1 r from n where lang is not null and doc_id is not null and not held_out group by lang, code qualify r < {size}),
o as materialized (select doc_id, code, row_number() over (partition by doc_id order by n desc, code) - 1 r from n qualify r < {size}),
k as (select distinct lang from l),
m as (select o.doc_id, k.lang, count(*) own, sum(coalesce(abs(o.r - l.r), {size})) distance from o cross join k left join l on l.lang = k.lang and l.code = o.code group by 1, 2),
b as (select doc_id, arg_min(lang, (distance, lang)) lang, min(distance) distance, any_value(own) own from m group by 1)
select doc_id, held_out, coalesce(b.lang, 'und') lang_pred, coalesce(1 - distance / ({size} * own), 0)::double score from a left join b using (doc_id)"""


def quality(rules: dict[str, tuple[str, list[float]]], sequence: list[tuple[str, float]], risk: float, level: float) -> str:
    """Counts, cutoffs by exact binomial tails, and verdicts."""
    first = ", ".join("case " + " ".join(f"when {ratio} > {cut} then {sequence.index((rule, cut))}" for cut in grid) + f" else {len(sequence)} end" for rule, (ratio, grid) in rules.items())
    number = len(sequence)
    return f"""
with t as (select doc_id, lang, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
l as (select doc_id, count(*) n_lines, count(distinct l) n_kinds from (select doc_id, unnest(string_split(t, chr(10))) l from t) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by 1),
v as (select doc_id, i, array_to_string(w[i:i + 7], ' ') v from (select doc_id, w, unnest(range(1, len(w) - 6)) i from t where len(w) >= 8)),
r as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 8)) p from (select doc_id, i, count(*) over (partition by doc_id, v) k from v) where k > 1) group by 1),
c as materialized (select doc_id, lang, len(w)::bigint n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
    coalesce(n_lines - n_kinds, 0)::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words, coalesce(n_lines, 0)::bigint n_lines from t left join l using (doc_id) left join r using (doc_id)),
f as materialized (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed, least({first}) place from c),
g as (select doc_id from labels where doc_id is not null and quality is not null group by 1 having min(quality) = 1),
h as materialized (select min(lang) lang, min(place) place from f join g using (doc_id) where not base_failed group by doc_id),
s as (select lang, count(*) n from h group by 1),
o as materialized (select lang, n from s where n >= (select ceil(ln({level} / (count(*) + 1)) / ln(1 - {risk})) from s)),
u as (select true pool, null lang, count(*) n from h having count(*) > 0 union all select false, lang, n from o),
q as (select pool, lang, n, i, (select count(*) from h where place <= i and (pool or h.lang is not distinct from u.lang)) k from u, range(0, {number}) x(i)),
e as (select pool, lang, i, k > {risk} * n or list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}) + (n - j) * ln(1 - {risk})))) > {level} / ((select count(*) from o) + 1) bad from q),
p as (select pool, lang, coalesce(min(i) filter (bad), {number}) passed from e group by 1, 2),
z as (select s.lang, coalesce(a.passed, b.passed) passed from s left join p a on not a.pool and a.lang is not distinct from s.lang left join p b on b.pool)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and (passed is null or place >= passed) kept from f left join z on z.lang is not distinct from f.lang"""


def url_filter(rules: list[tuple[str, str]], hidden: str, href: str, steps: int, damping: float, threshold: float) -> str:
    """Rules by a table of them; propagation with one query per step."""
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda c: f"coalesce({low.format(f"regexp_extract({c}, '(?s)^.*?://([^/?#]*)', 1)")}, '')"
    values = ", ".join(f"('{verdict}', '{rule}', '{rule[: rule.find('/')]}', '{rule[rule.find('/') :]}')" for verdict, rule in rules)
    quoted, unseen = href.replace("'", "''"), hidden.replace("'", "''")
    step = lambda i: f"""s{i} as (select kind, h, sum(s) s from (select kind, h, {1 - damping} * s s from s0 union all
        select e.kind, e.dst, {damping} * s.s * e.w from s{i - 1} s join e on e.kind = s.kind and e.src = s.h) group by 1, 2)"""  # noqa: E731
    return f"""
with rules(verdict, rule, rh, rp) as (values {values}),
p as (select page_id, {host("url")} h, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path, html from pages),
j as (select page_id, h, path, max_by(rule, length(rule)) rule, max_by(verdict, length(rule)) verdict
    from p left join rules on (h = rh or ends_with(h, '.' || rh)) and starts_with(path, rp) group by all),
l as (select h src, {host("u")} dst from (select h, ':' || unnest(regexp_extract_all(regexp_replace(html, '{unseen}', ' ', 'g'), '{quoted}', 1)) u from p)),
n as (select src, dst, count(*) n from l where src <> '' and dst <> '' and src <> dst group by 1, 2),
b as (select 't' kind, src, dst, n from n union all select 'd', dst, src, n from n),
e as (select kind, src, dst, n / sum(n) over (partition by kind, src) w from b),
f as (select h, avg((verdict is not distinct from 'allow')::int) a, avg((verdict is not distinct from 'block')::int) b from j where h <> '' group by 1),
s0 as (select 't' kind, h, a / (select sum(a) from f) s from f where a > 0 union all select 'd', h, b / (select sum(b) from f) from f where b > 0),
{", ".join(step(i) for i in range(1, steps + 1))},
z as (select kind, h, s from s{steps} where (select count(*) from e) > 0 union all select kind, h, s from s0 where (select count(*) from e) = 0),
y as (select kind, h, s / sum(s) over (partition by kind) s from z),
v as (select h, sum(case when kind = 'd' then s else 0 end) d, sum(s) a from y group by 1)
select page_id, j.h as "host", path, rule, coalesce(verdict, case when d >= {threshold} * a then 'block' end, 'allow') verdict from j left join v using (h)"""
