"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from .secret_scan import ADDED, BASE, Rule

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
with items as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark where item_id is not null),
windows as (
  select item, case when len(w) < 10 then w else list_slice(w, i, i + 9) end as k
  from (select item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from items where len(w) > 0)),
docs as (select doc_id, {_WORDS} as w from documents),
lengths as (select distinct len(k) as n from windows),
places as (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from docs, lengths where len(w) >= n),
found as (select p.doc_id, p.i, p.n, k.item from places p join windows k on list_slice(p.w, p.i, p.i + p.n - 1) = k.k),
hits as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as j from found) group by doc_id),
names as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from found) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(n.n_items, 0) as n_items, sha256(coalesce(n.items, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from docs d left join hits h using (doc_id) left join names n using (doc_id)"""

EMBEDDINGS = """
with recursive usable as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(v, r) as (select vec_id, vec_id from embeddings union select reach.v, links.b from reach join links on links.a = reach.r),
component as (select v, min(r) as c from reach group by v),
degree as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(d.n, 0) as n_links, c.c as component_id, c.c = e.vec_id as kept from embeddings e join component c on c.v = e.vec_id left join degree d on d.a = e.vec_id"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit."""
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, y: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint)"


def _add(value: str, cost: str, letter: str) -> str:
    """A value is nine digits of cost and the audit; an edit adds to both."""
    return f"(lpad(cast(cast(substr({value}, 1, 9) as int) + ({cost}) as varchar), 9, '0') || substr({value}, 10) || '{letter}')"


def _closed(e: str, h: str, v: str, w: str) -> str:
    """The four states after any inserts."""
    ins = lambda x: _add(x, "3", "I")
    return f"select c, i, e, h, v, least(w, {ins('v')}) as w from (select c, i, e, h, w, least(v, {ins('e')}, {ins('h')}, {ins('w')}) as v from (select c, i, {e} as e, {h} as h, {v} as v, {w} as w from src))"


_GONE = lambda x: _add(x, "4", "D")
_STEP = f"""with src as (select s.c, r.i, s.e as e0, s.h as h0, s.v as v0, s.w as w0, least(s.e, s.h, s.w) as open, r.sym, case when r.fault = 't' then 3 else 0 end as late from st s join faulty r on r.c is not distinct from s.c and r.i = s.i + 1)
  {_closed(_GONE('e0'), f"least({_GONE('h0')}, case when sym = 's' then {_add('e0', 'late', 'K')} end)",
           f"least({_GONE('v0')}, case when sym = 'u' then {_add('open', 'late', 'K')} end, case when sym <> '-' then {_add('open', '3 + late', 'R')} end)",
           f"least({_GONE('w0')}, case when sym = 'a' then {_add('v0', 'late', 'K')} end, case when sym <> '-' then {_add('v0', '3 + late', 'R')} end)")}"""
_START = f"""with src as (select distinct conv_id as c, 0::bigint as i from conversations) {_closed("'000000000'", "null::varchar", "null::varchar", "null::varchar")}"""

REPAIR = f"""
with recursive keyed as (
  select conv_id as c, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc32("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as kind from conversations),
damaged as (
  select c, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when kind = 0 then 0 when kind = 3 then 2 else 1 end)) as copy from keyed),
placed as (select *, row_number() over (partition by c order by turn nulls first, role, text, copy) as i, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as shown from damaged),
faults as (select *, case when shown = '' then 'b' when row_number() over (partition by c, role, text order by i) > 1 then 'd' when right(shown, 1) not in ('.', '!', '?') then 't' else '' end as fault,
    lag(left(role, 1)) over (partition by c order by i) as before from placed),
faulty as (select *, case when fault in ('b', 'd') then '-' when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'o' end as sym from faults),
st as (select * from ({_START}) union all select * from ({_STEP})),
ends as (select c, least(e, w) as value from st qualify row_number() over (partition by c order by i desc) = 1),
edits as (select c, p, substr(value, 9 + p, 1) as letter from (select c, value, unnest(range(1, length(value) - 8)) as p from ends)),
read as (select *, count(case when letter <> 'I' then 1 end) over (partition by c order by p) as i from edits),
turns as (select d.c, d.letter, f.role, f.text, row_number() over (partition by d.c order by d.p) as k from read d left join faulty f on f.c is not distinct from d.c and f.i = d.i where d.letter <> 'D'),
begun as (select c, case when letter = 'K' and left(role, 1) = 's' then 1 else 0 end as skip from turns where k = 1),
repaired as (select t.c, string_agg(case when t.letter = 'K' then t.role when (t.k - b.skip) % 2 = 1 then 'user' else 'assistant' end || ':' || case when t.letter = 'I' then '' else t.text end, chr(10) order by t.k) as body
  from turns t join begun b on b.c is not distinct from t.c group by t.c),
counts as (select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(case when fault = 'b' then 1 end) as blank, count(case when fault = 'd' then 1 end) as duplicate,
    count(case when fault = 't' then 1 end) as truncated, count(case when before is not null and before || left(role, 1) not in ('su', 'ua', 'au') then 1 end) as illegal from faulty group by c)
select e.c as conv_id, coalesce(n.gaps, 0) as gaps, coalesce(n.blank, 0) as blank, coalesce(n.duplicate, 0) as duplicate, coalesce(n.truncated, 0) as truncated, coalesce(n.illegal, 0) as illegal,
  cast(substr(e.value, 1, 9) as bigint) as cost, substr(e.value, 10) as audit, sha256(coalesce(r.body, '')) as repaired_sha256
from ends e left join counts n on n.c is not distinct from e.c left join repaired r on r.c is not distinct from e.c"""


def _secret(rule: Rule, order: int) -> str:
    """Spans of one rule; letters in either case are spelt out."""
    p = rule.pattern
    if p.startswith("(?i)"):
        head, tail = p[4:].split(")", 1)
        p = "".join(f"[{ch.upper()}{ch}]" if ch.isalpha() else ch for ch in head) + ")" + tail
    p = p.replace("'", "''")
    return f"""select doc, cast(start as bigint) as start, {order} as ord, '{rule.kind}' as kind, start + length(hit) as stop from (
      select doc, hit, list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0) as start from (
        select doc, gaps, hits, k, hits[k] as hit, judged[k] as own from (
          select doc, string_split_regex(text, '{p}') as gaps, regexp_extract_all(text, '{p}') as hits, regexp_extract_all(text, '{p}', {rule.group}) as judged, unnest(range(1, len(regexp_extract_all(text, '{p}')) + 1)) as k from docs)) where length(own) >= {rule.least})"""


_JOINED = "coalesce(string_agg({cond}kind || ':' || start || ':' || stop{end}, ',' order by start, ord), '')"
SECRETS = f"""
with docs as (select row_number() over () as doc, doc_id, coalesce(text, '') as text from documents),
found as ({' union all '.join(_secret(r, k) for k, r in enumerate(BASE + ADDED))})
select any_value(d.doc_id) as doc_id, {', '.join(f"count(case when kind = '{r.kind}' then 1 end) as n_{r.kind}" for r in BASE)},
  sha256({_JOINED.format(cond=f'case when ord < {len(BASE)} then ', end=' end')}) as base_sha256, {_JOINED.format(cond='', end='')} as spans
from docs d left join found f on f.doc = d.doc group by d.doc"""

TRIE = f"""
with t as (select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id order by turn nulls first) as pos from conversations where conv_id is not null),
ids as (select c, c - c % 5 as base, {_crc32('cast(c as varchar)')} % 9 as h from (select distinct c from t)),
mixed as (select i.c, 0 as own, t.pos, t.r, t.x from ids i join t on t.c = i.base and t.pos <= i.h union all select i.c, 1, t.pos, t.r, t.x from ids i join t on t.c = i.c and t.pos > i.h),
path as (select c, r, x, row_number() over (partition by c order by own, pos) as d from mixed),
occ as (select c, d, octet_length(encode(x)) as b, string_agg(sha256(r) || sha256(x), '') over (partition by c order by d) as key from path union all select c, 0, 0, '' from ids),
lens as (select c, max(d) as len from occ group by c),
node as (select key, d, min(c) as owner, count(*) as n, max(b) as b from occ group by key, d),
step as (select distinct a.key as up, b.key as down from occ a join occ b on b.c = a.c and b.d = a.d + 1),
kids as (select up, count(*) as n from step group by up),
below as (select distinct a.key as top, b.key as under from occ a join occ b on b.c = a.c and b.d >= a.d),
sums as (select w.top, count(case when k.n is null then 1 end) as leaves, cast(sum((n.n - 1) * n.b) as bigint) as saved from below w join node n on n.key = w.under left join kids k on k.up = w.under group by w.top),
ends as (select o.key, string_agg(cast(o.c as varchar), ',' order by o.c) as ids from occ o join lens l on l.c = o.c and l.len = o.d group by o.key)
select n.owner as conv_id, n.d as depth, p.owner as parent_conv_id, n.n as n_convs, coalesce(k.n, 0) as n_children, s.leaves as n_leaves, s.saved as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from node n join sums s on s.top = n.key left join kids k on k.up = n.key left join ends e on e.key = n.key left join step u on u.down = n.key left join node p on p.key = u.up"""

ORACLE_SQL = {
    "op5_embedding_dedup": EMBEDDINGS,
    "op10_decontamination": DECONTAMINATION,
    "op11_conversation_repair": REPAIR,
    "op12_secret_scan": SECRETS,
    "op13_prefix_trie": TRIE,
}
