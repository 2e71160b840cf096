"""DuckDB SQL for the queries that SQL can express."""

_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, group that is measured, least length; base kinds first, as the operator lists them.
_KINDS = (
    ("assign", _ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1), ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("google", "AIza[A-Za-z0-9_-]{35}", 0, 1), ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1), ("stripe", "[sr]k_live_[A-Za-z0-9]{16,}", 0, 1),
)


def _secrets() -> str:
    each = " union all ".join(
        f"select doc_id, {k} as rule, '{kind}' as kind, {least} as least, regexp_extract_all(t, '{p}', 0) as m, regexp_extract_all(t, '{p}', {g}) as part, string_split_regex(t, '{p}') as piece from d"
        for k, (kind, p, g, least) in enumerate(_KINDS)
    )
    return rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
found as ({each}),
numbered as (select doc_id, rule, kind, least, unnest(m) as m, unnest(part) as part, unnest(piece[1:len(m)]) as piece, unnest(range(1, len(m) + 1)) as i from found where len(m) > 0),
placed as (select doc_id, rule, kind, least, length(m) as width, length(part) as plen,
  sum(length(piece) + length(m)) over (partition by doc_id, rule order by i) as stop from numbered),
spans as (select doc_id, rule, stop - width as start, kind || ':' || (stop - width) || ':' || stop as s, kind from placed where plen >= least)
select d.doc_id,
  count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(s, ',' order by start, rule) filter (where rule < 3), '')) as base_sha256,
  coalesce(string_agg(s, ',' order by start, rule), '') as spans
from d left join spans on d.doc_id = spans.doc_id group by d.doc_id
"""


_CLASSES = r"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
  when len(w) > 0 then [array_to_string(w, ' ') || ' '] else [] end as s from words),
items as (select doc_id, len(s) as n, unnest(s) as x from sets),
pairs as (select a.doc_id as a, b.doc_id as b from items a join items b on a.x = b.x and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
links as (select a as u, b as v from pairs union all select b, a from pairs),
reach as (select doc_id as node, doc_id as other from sets union select r.node, l.v from reach r join links l on l.u = r.other),
least as (select node, min(other) as component_id from reach group by node)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from sets join least on node = doc_id
"""

_FIXITY = """
with r as (select page_id, coalesce(page_id, -1) as id, coalesce(html, '') as body,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
  || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
  || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as record from pages)
select page_id, id // 1024 as file, cast(coalesce(sum(strlen(record)) over (partition by id // 1024 order by id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset",
  strlen(record) as length, sha256(record) as digest,
  case when page_id % 211 = 17 then 'missing' when page_id % 89 = 3 then 'changed' else 'intact' end as outcome
from r union all select -page_id - 2, null, null, null, null, 'added' from pages where page_id % 307 = 5
"""

ORACLES = {"op7_fixity": _FIXITY, "op9_secrets": _secrets(), "op4_near_duplicates": _CLASSES}
