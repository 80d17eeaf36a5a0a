"""DuckDB SQL for the ranked search, the fingerprints and the conversation repair: the same results by plain evaluation."""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED_SEARCH = f"""
with docs as (select row_number() over () as d, doc_id, {_TERMS} as w from documents),
counts as (select d, any_value(doc_id) as doc_id, term, count(*) as tf from (select d, doc_id, unnest(w) as term from docs) group by d, term),
totals as (select count(*) filter (where len(w) > 0) as n, cast(coalesce(sum(len(w)), 0) as bigint) as l from docs),
sizes as (select d, 10 + (90 * cast(len(w) as bigint) * n) // greatest(l, 1) as m from docs, totals),
asks as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
weights as (select term, cast(floor(1000 * ln(cast(2 * n + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w
  from (select term, count(*) as df from counts where term in (select term from asks) group by term), totals),
scores as (select item_id, d, any_value(doc_id) as doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from asks join weights using (term) join counts using (term) join sizes using (d) group by item_id, d),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank, doc_id, score from scores where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 10
"""

_GRAM, _WINDOW, _PRIME, _BASE = 8, 16, 2**31 - 1, 1_000_003
_HASH = "cast(0 as bigint)"
for _i in range(_GRAM):
    _HASH = f"(({_HASH} * {_BASE} + lead(code, {_i}) over w) % {_PRIME})"


def _likeness(a: str, b: str) -> str:
    both = f"len(list_intersect({a}.h, {b}.h))"
    return f"case when len({a}.h) + len({b}.h) = 0 then cast(1 as double) else cast({both} as double) / cast(len({a}.h) + len({b}.h) - {both} as double) end"


FINGERPRINTS = f"""
with rows as (select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id desc nulls last) as pos, count(*) over () as n from documents),
pairs as (select a.doc_id, a.text, b.text as next, length(a.text) as size, length(a.text) // 3 as third from rows a join rows b on b.pos = a.pos % a.n + 1),
edited as (select *, substr(text, 1, size - third) || substr(next, 1, third) as other from pairs),
texts as (select t, row_number() over () as id, case when t = '' then cast([] as varchar[]) else string_split(t, '') end as c from (select text as t from edited union select other from edited)),
codes as (select id, len(c) as n, cast(unicode(unnest(c)) as bigint) as code, unnest(range(len(c))) as pos from texts),
long_grams as (select id, n, pos, {_HASH} as h from codes where n >= {_GRAM} window w as (partition by id order by pos)),
grams as (select id, n - {_GRAM} + 1 as many, pos, h from long_grams where pos <= n - {_GRAM}
  union all select id, 1, 0, list_reduce(list_prepend(cast(0 as bigint), list(code order by pos)), lambda a, x: (a * {_BASE} + x) % {_PRIME}) from codes where n < {_GRAM} group by id),
minima as (select id, many, pos, min(h * 4294967296 + {_PRIME} - pos) over (partition by id order by pos rows between current row and {_WINDOW - 1} following) as k from grams),
kept as (select distinct id, {_PRIME} - k % 4294967296 as pos, k // 4294967296 as h from minima where pos <= greatest(many - {_WINDOW}, 0)),
gaps as (select id, pos, h, pos - lag(pos, 1, 0) over (partition by id order by pos) as gap from kept),
prints as (select t, coalesce(h, []) as h, coalesce(f, '') as f from texts left join (select id, list(distinct h) as h, string_agg(hex(gap * 2147483648 + h), ',' order by pos) as f from gaps group by id) using (id))
select doc_id, cast(size as bigint) as n_chars, sha256(other) as edited_sha256, a.f as fingerprint, b.f as edited_fingerprint,
  {_likeness("a", "b")} as near_edited, {_likeness("a", "c")} as near_next
from edited join prints a on a.t = text join prints b on b.t = other join prints c on c.t = next
"""


def _more(state: str, cost: str, edit: str, turn: str = "''") -> str:
    """A state's best way with one more edit: cost (6 digits), audit, chr(1), repaired turns; the least text is the cheapest, then the least audit."""
    rest = f"substr({state}, 7, instr({state}, chr(1)) - 7) || '{edit}' || chr(1) || substr({state}, instr({state}, chr(1)) + 1)"
    line = "" if edit == "D" else f" || case when substr({state}, instr({state}, chr(1)) + 1) = '' then '' else chr(10) end || {turn}"
    return f"(lpad(cast(cast(left({state}, 6) as int) + {cost} as varchar), 6, '0') || {rest}{line})"


_CUT = "(case when fault = 'truncated' then 3 else 0 end)"
_FREE = "fault in ('sound', 'truncated')"
_AS_IT_IS, _USER, _ASSISTANT = "role || ':' || text", "'user:' || text", "'assistant:' || text"


def _inserted(then: str) -> str:
    """States 0 to 3 (q0 …) with turns inserted, as a subquery over ``then``."""
    a2 = f"least(q2, {_more('q0', '3', 'I', chr(39) + 'user:' + chr(39))}, {_more('q1', '3', 'I', chr(39) + 'user:' + chr(39))}, {_more('q3', '3', 'I', chr(39) + 'user:' + chr(39))})"
    return f"(select * exclude (q2, q3), a2, least(q3, {_more('a2', '3', 'I', chr(39) + 'assistant:' + chr(39))}) as a3 from (select *, {a2} as a2 from {then}))"


def _kept(state: str, turn: str, cost: str, edit: str, when: str) -> str:
    return f"case when {_FREE} and {when} then {_more(state, cost, edit, turn)} end"


_CRC = """byte(b) as (select unnest(range(256))), crc_step as (select b, 0 as n, cast(b as bigint) as c from byte union all
  select b, n + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc_step where n < 8),
crc_table as (select list(c order by b) as t from crc_step where n = 8)"""

CONVERSATION_REPAIR = f"""
with recursive {_CRC},
hashed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ascii(x) as bigint))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 as what from conversations, crc_table),
damaged as (select conv_id, turn, case when what = 4 then 'user' else role end as role, case when what = 1 then '' when what = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from hashed, unnest(range(case when what = 0 then 0 when what = 3 then 2 else 1 end)) as copies(i)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from damaged),
turns as (select *, left(role, 1) as x, case when bare = '' then 'blank' when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate' when right(bare, 1) in ('.', '!', '?') then 'sound' else 'truncated' end as fault,
  lag(left(role, 1)) over (partition by conv_id order by pos) || left(role, 1) as pair from placed),
ways as (select conv_id, cast(0 as bigint) as pos, '000000' || chr(1) as q0, cast(null as varchar) as q1, cast(null as varchar) as q2, cast(null as varchar) as q3 from (select distinct conv_id from conversations)
  union all
  select conv_id, pos, {_more('q0', '4', 'D')}, least({_more('q1', '4', 'D')}, {_kept('q0', _AS_IT_IS, _CUT, 'K', "x = 's'")}),
    least({_more('a2', '4', 'D')}, {', '.join(_kept(q, _AS_IT_IS, _CUT, 'K', "x = 'u'") for q in ('q0', 'q1', 'a3'))}, {', '.join(_kept(q, _USER, '3 + ' + _CUT, 'R', 'true') for q in ('q0', 'q1', 'a3'))}),
    least({_more('a3', '4', 'D')}, {_kept('a2', _AS_IT_IS, _CUT, 'K', "x = 'a'")}, {_kept('a2', _ASSISTANT, '3 + ' + _CUT, 'R', 'true')})
  from {_inserted("(select w.conv_id, t.pos, role, text, x, fault, q0, q1, q2, q3 from ways w join turns t on t.conv_id is not distinct from w.conv_id and t.pos = w.pos + 1)")}),
last as (select conv_id, max(pos) as pos from ways group by conv_id),
best as (select conv_id, least(q0, a3) as way from {_inserted("(select w.* from ways w join last l on l.conv_id is not distinct from w.conv_id and l.pos = w.pos)")}),
facts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
  count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where pair is not null and pair not in ('su', 'ua', 'au')) as illegal from turns group by conv_id)
select b.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  cast(left(way, 6) as bigint) as cost, substr(way, 7, instr(way, chr(1)) - 7) as audit, sha256(substr(way, instr(way, chr(1)) + 1)) as repaired_sha256
from best b left join facts f on f.conv_id is not distinct from b.conv_id
"""
