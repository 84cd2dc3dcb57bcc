"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"[\x20\x09-\x0D]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str, between: str) -> str:
    return f"list_filter(string_split_regex({text}, '{between}'), lambda x: x <> '')"


OP1 = f"""
with recursive w as (select doc_id, {_words(_LOWER, _BLANK)} as w from documents),
s as (
    select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)
    union select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and 4),
n as (select doc_id, count(*) as n from s group by doc_id),
inter as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from inter join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
reach as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
low as (select a, min(b) as m from reach group by a),
deg as (select a, count(*) as d from links group by a)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least(w.doc_id, coalesce(low.m, w.doc_id)) as component_id, cast(coalesce(d, 0) as bigint) as n_links
from w left join n using (doc_id) left join low on low.a = w.doc_id left join deg on deg.a = w.doc_id
"""

OP4 = rf"""
with t as (select doc_id, coalesce(text, '') as text, {_words("coalesce(text, '')", _BLANK)} as w from documents),
l as (
    select doc_id, count(*) as n_lines, count(*) - count(distinct x) as n_dup_lines
    from (select doc_id, unnest(string_split(text, chr(10))) as x from t) where regexp_matches(x, '[^\x20\x09-\x0D]') group by doc_id),
g as (select doc_id, i, count(*) over (partition by doc_id, s) as c from (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from t where len(w) >= 3))),
r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from g where c >= 2) group by doc_id),
b as (
    select doc_id, len(w) as n_words, len(array_to_string(w, '')) as word_chars, len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
        coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
        len(text) - len(regexp_replace(text, '[!?]', '', 'g')) as marks, len(text) - len(regexp_replace(text, '[A-Z]', '', 'g')) as upper_, len(text) - len(regexp_replace(text, '[a-z]', '', 'g')) as lower_
    from t left join l using (doc_id) left join r using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not (base_failed or 100 * n_symbols > 30 * n_words or 100 * marks > 50 * n_words or (upper_ > 200 and upper_ > 2 * lower_)
        or (n_lines >= 4 and 100 * n_dup_lines > 70 * n_lines) or not (word_chars between 2 * n_words and 20 * n_words)) as kept
from f
"""

OP6 = f"""
with d as (select doc_id, {_words(_LOWER, _BETWEEN)} as w from documents),
i as (select item_id, {_words(_LOWER, _BETWEEN)} as w from benchmark),
win as (select distinct item_id, size, array_to_string(w[k : k + size - 1], ' ') as s from (select *, unnest(range(1, len(w) - size + 2)) as k from (select item_id, w, least(10, len(w)) as size from i where len(w) > 0))),
sizes as (select distinct size from win),
spot as (select doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') as s from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as k from d, sizes where len(w) >= size)),
occ as (select doc_id, size, k, item_id from spot join win using (size, s)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + size)) as p from (select distinct doc_id, k, size from occ)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct doc_id, cast(item_id as varchar) as x from occ) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""


#: Written out on their own, so that the SQL is a check of the operator's patterns too. 24+ hex digits and 20+ characters
#: of an access identifier are tested after the match, as are the 6+ of an assigned value.
_SECRET = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "key": "[-_/+0-9A-Za-z]{32,}",
    "endpoint": "[Hh][Tt][Tt][Pp][Ss]?://[-.0-9A-Za-z]+[0-9A-Za-z](:[0-9]+)?(/[-._~/0-9A-Za-z]*)?",
}
_GOOD = {"assign": "len(value) >= 6", "access": "len(m) >= 20", "hex": "len(m) >= 24", "key": "regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]')", "endpoint": "true"}


def _secret_parts(kind: str) -> str:
    found = f"regexp_extract_all(text, '{_SECRET[kind]}')"
    value = f"regexp_extract_all(text, '{_SECRET[kind]}', 2)" if kind == "assign" else found
    return f"""select doc_id, '{kind}' as kind, m, sum(len(gap) + len(m)) over (partition by doc_id order by idx) as stop, {_GOOD[kind]} as good from (
        select doc_id, generate_subscripts(ms, 1) as idx, unnest(ms) as m, unnest(list_slice(rest, 1, len(ms))) as gap, unnest(vs) as value
        from (select doc_id, {found} as ms, {value} as vs, string_split_regex(text, '{_SECRET[kind]}') as rest from texts) where len(ms) > 0)"""


_RANK = "list_position(['assign', 'access', 'hex', 'key', 'endpoint'], kind)"
OP9 = f"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
parts as (select doc_id, kind, stop - len(m) as a, stop as b from ({" union all ".join(map(_secret_parts, _SECRET))}) as p where good),
weak as (
    select w.doc_id, w.kind, w.a, w.b,
        bool_or(case when w.kind = 'key' then n.kind in ('access', 'endpoint') else n.kind in ('access', 'assign') end and not (n.kind in ('assign', 'access', 'hex') and n.a < w.b and w.a < n.b)) as linked,
        bool_or(w.kind = 'key' and n.kind in ('assign', 'access', 'hex') and n.a < w.b and w.a < n.b) as covered
    from parts w join parts n on w.doc_id = n.doc_id and n.a - w.b <= 200 and w.a - n.b <= 200 where w.kind in ('key', 'endpoint') group by all),
spans as (select doc_id, kind, a, b from parts where kind in ('assign', 'access', 'hex') union all select doc_id, kind, a, b from weak where linked and not covered),
digest as (
    select doc_id, count_if(kind = 'assign') as n_assign, count_if(kind = 'access') as n_access, count_if(kind = 'hex') as n_hex,
        string_agg(kind || ':' || a || ':' || b, ',' order by a, {_RANK}, b) filter (where kind in ('assign', 'access', 'hex')) as base,
        string_agg(kind || ':' || a || ':' || b, ',' order by a, {_RANK}, b) as spans
    from spans group by doc_id)
select d.doc_id, cast(coalesce(n_assign, 0) as bigint) as n_assign, cast(coalesce(n_access, 0) as bigint) as n_access, cast(coalesce(n_hex, 0) as bigint) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join digest using (doc_id)
"""

ORACLES = {"op1_ngram_jaccard_join": OP1, "op4_quality_rules": OP4, "op6_benchmark_decontamination": OP6, "op9_secret_scans": OP9}
