"""Comparison SQL of the operators that SQL can express."""

from __future__ import annotations

OP1 = r"""
with words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
items as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
windows as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[i:i + 12], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(2, len(w) - 11))) as i from items where len(w) > 0)),
lengths as (select distinct n from windows),
places as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, lengths where len(w) >= n)),
found as (select doc_id, p.n, i, item_id from places p join windows x on p.n = x.n and p.g = x.g),
hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from found) group by 1),
named as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
          from (select distinct doc_id, cast(item_id as varchar) as id from found) group by 1),
merged as (
  select doc_id, string_agg((s - 1) || ':' || (e - 1), ',' order by s) as removal from (
    select doc_id, min(i) as s, max(i + n) as e from (
      select *, sum(case when i <= prev then 0 else 1 end) over (partition by doc_id order by i, n rows unbounded preceding) as part from (
        select *, max(i + n) over (partition by doc_id order by i, n rows between unbounded preceding and 1 preceding) as prev
        from (select distinct doc_id, i, n from found)))
    group by doc_id, part) group by doc_id)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated,
       coalesce(removal, '') as removal
from words w left join hit using (doc_id) left join named using (doc_id) left join merged using (doc_id)
"""

OP10 = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from sets group by 1),
digests as (select doc_id, md5(string_agg(g, chr(10) order by g)) as h from sets group by 1),
firsts as (select h, min(doc_id) as r from digests group by 1),
rare as (select s.doc_id, g from sets s join firsts f on s.doc_id = f.r),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from rare a join rare b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from pairs p join sizes x on p.a = x.doc_id join sizes y on p.b = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as (select a, b from links union select b, a from links),
reach(a, b) as (select distinct a, a from both_ways union select r.a, t.b from reach r join both_ways t on r.b = t.a),
least_of as (select a, min(b) as m from reach group by 1)
select w.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles,
       coalesce(m, r, w.doc_id) as component_id, coalesce(m, r, w.doc_id) = w.doc_id as kept
from words w left join sizes s on w.doc_id = s.doc_id left join digests d on w.doc_id = d.doc_id
left join firsts f on d.h = f.h left join least_of l on f.r = l.a
"""

_CLASSES = [  # as character lists of a pattern
    "a-z", "A-Z", "0-9", r" \t\x0B\x0C\r", r"\n", r".,;:!?'\"\-()", "#*$%&|<>", r"\x{80}-\x{7FF}", r"\x{800}-\x{FFFF}", r"\x{10000}-\x{10FFFF}"]


def _js(p: str, q: str) -> str:
    half = f"list_sum(list_transform(list_zip({p}, {q}), lambda x: case when x[1] > 0 then x[1] * log2(x[1] * 2 / (x[1] + x[2])) else 0 end))"
    other = f"list_sum(list_transform(list_zip({p}, {q}), lambda x: case when x[2] > 0 then x[2] * log2(x[2] * 2 / (x[1] + x[2])) else 0 end))"
    return f"sqrt(greatest(0, ({half} + {other}) / 2))"


def _op8() -> str:
    classes = ", ".join(f"length(regexp_replace(t, '[^{c.replace(chr(39), chr(39) * 2)}]', '', 'g'))" for c in _CLASSES)
    return rf"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
             [{classes}] as c0 from d),
v as (select *, len(w) as n, list_append(c0, length(t) - list_sum(c0)) as c,
             list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as lw from w),
grams as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as g
          from (select doc_id, w, unnest(range(1, n - 3)) as i from v where n >= 5)),
again as (select doc_id, count(distinct k) as r from (
            select doc_id, unnest(range(i, i + 5)) as k from (select *, count(*) over (partition by doc_id, g) as m from grams) where m > 1)
          group by 1),
base as (select v.*, coalesce(r, 0) as r, n < 10 or 100 * coalesce(r, 0) > 20 * n as failed from v left join again using (doc_id)),
langs as (select lang, sum(n) as n from base group by 1),
judged as (select lang, n from langs where n >= 1),
class_ref as (select lang, list(s / t order by k) as q from (
                select lang, k, s, sum(s) over (partition by lang) as t from (
                  select lang, k, sum(x)::double as s from (select lang, unnest(c) as x, generate_subscripts(c, 1) as k from base) group by 1, 2))
              group by 1),
counted as (select doc_id, lang, x, count(*) as m from (select doc_id, lang, unnest(lw) as x from base) group by 1, 2, 3),
common as (select lang, x, s from (select lang, x, sum(m) as s from counted group by 1, 2) join judged using (lang) where s >= 0.002 * n),
rest as (select j.lang, j.n - coalesce(sum(s), 0) as s from judged j left join common c on j.lang = c.lang group by j.lang, j.n),
word_ref as (select lang, list(s / n order by x nulls last) as q from (
               select lang, x, s from common union all select lang, null, s from rest) join judged using (lang) group by 1),
mine as (select b.doc_id, b.n, c.x, coalesce(k.m, 0) as m from base b join common c on b.lang = c.lang
         left join counted k on k.doc_id = b.doc_id and k.x = c.x where b.n > 0),
mine_all as (select doc_id, list_append(list(m / n order by x), (n - sum(m)) / n) as p from mine group by doc_id, n),
far as (select b.*,
          case when length(t) >= 200 and j.n is not null then {_js("list_transform(c, lambda y: y / length(t))", "cr.q")} end as cd,
          case when b.n >= 100 and j.n is not null then {_js("coalesce(p, [1.0])", "wr.q")} end as wd,
          coalesce(p, [1.0])[-1] as mine_rest, wr.q[-1] as rest
        from base b left join judged j on b.lang = j.lang left join class_ref cr on j.lang = cr.lang
        left join word_ref wr on j.lang = wr.lang left join mine_all a on a.doc_id = b.doc_id)
select doc_id, cast(n as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
       cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
       cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(r as bigint) as n_repeat_words, failed as base_failed,
       round(cd, 6) as class_distance, round(wd, 6) as word_distance,
       not failed and coalesce(cd, 0) <= 0.33 and coalesce(wd, 0) <= case when 1 - mine_rest < (1 - rest) / 2 and n * (1 - rest) >= 20
         then least(0.5, 0.85 * sqrt((log2(2 / (1 + rest)) + (1 - rest) + case when rest > 0 then rest * log2(2 * rest / (1 + rest)) else 0 end) / 2)) else 0.5 end as kept
from far
"""

OP2 = """
with p as (select page_id, coalesce(html, '') as h from pages),
f as (select h, min(page_id) as r from p group by 1),
d as (select page_id, p.h, r, list_aggregate(list_transform(range(1, 41),
        lambda i: right('0000' || bin(('0x' || substr(sha1(encode(p.h)), i, 1))::integer), 4)), 'string_agg', '') as b from p join f on p.h = f.h)
select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(1, 6), lambda k: substr(b, 5 * i + k, 1)::integer * (1 << (5 - k))))::integer, 1)), 'string_agg', '') as payload_digest,
       case when page_id = r then 'response' else 'revisit' end as record_type, case when page_id = r then null else r end as refers_to
from d
"""

SQL = {"op1_decontaminate": OP1, "op2_warc": OP2, "op8_quality": _op8(), "op10_near_dedup": OP10}

SQL["op12_mix"] = r"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
sent as (select *, sum(size) over (partition by source order by md5('mix:' || coalesce(cast(doc_id as varchar), '')), doc_id nulls first, size
   rows unbounded preceding)::bigint as s from sized),
src as (select source, source_size, rank, 1 + rank % 3 as w from (
   select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from sized group by 1)),
laid as (select *, sum(source_size) over () as total, sum(w) over () - coalesce(sum(w) over lower, 0) as w_left,
   coalesce(sum(3 * source_size) over lower, 0) as full_below from src
   window lower as (order by source_size / w range between unbounded preceding and current row exclude group)),
full_ as (select *, w * ((total - full_below) / w_left) > 3 * source_size as is_full from laid),
dealt as (select source, source_size, rank, case when is_full then (3 * source_size)::double
   else ((total - coalesce(sum(case when is_full then 3 * source_size end) over (), 0)) * w)::double
        / (sum(case when is_full then 0 else w end) over ())::double end as target, total from full_),
placed as (select doc_id, size, s, source_size, target, rank, total from sent join dealt on sent.source is not distinct from dealt.source),
line as (select *, sum(size) over (order by finish, rank, e, s rows unbounded preceding) as run from (
   select *, (e * source_size + s)::double / target as finish from placed, range(3) t(e) where size > 0 and target > 0)),
gave as (select doc_id, rank, s, sum(case when run <= total then size when run - size < total then total - (run - size) else 0 end)::bigint as taken
   from line group by all)
select p.doc_id, p.size, p.source_size, p.target, coalesce(g.taken, 0)::bigint as taken
from placed p left join gave g on p.size > 0 and p.rank = g.rank and p.s = g.s"""

#: The table of the byte-wise CRC-32, and the checksum over a list of bytes.
_CRC_TABLE = """select list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
   lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t"""


def _crc(octets: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


SQL["op13_spelling"] = rf"""
with recursive tab as ({_CRC_TABLE}),
runs as (select doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as n
   from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as w from documents) group by all),
summed as (select w, n, {_crc("""flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || w, ''),
     lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end))""")} as h from runs, tab),
words as (select word, sum(n)::bigint as n from (select n, case when h % 97 = 0
     then left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word from summed)
   where length(word) >= 5 group by 1 having sum(n) >= 3),
cuts as (select word, n, i, left(word, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word)))::int as i from words)),
near as (select distinct a.word, b.word as other, b.n from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
   union select c.word, w.word, w.n from cuts c join words w on c.rest = w.word
   union select w.word, c.word, c.n from cuts c join words w on c.rest = w.word),
best as (select word, count(*) as n_near, max(n) as top from near group by 1),
forms as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near,
     case when top >= 2 * w.n then (select min(other) from near where near.word = w.word and near.n = b.top) end as form,
     case when top >= 2 * w.n then top end as form_n from words w left join best b using (word)),
follow as (select word, word as root from forms union all select f.word, g.form from follow f join forms g on f.root = g.word where g.form is not null)
select word, form, arg_max(root, n) as root, any_value(n_word) as n, any_value(n_near) as n_near, any_value(form_n) as form_n
from (select f.word, f.form, f.n as n_word, f.n_near, f.form_n, x.root, y.n from forms f join follow x using (word) join words y on y.word = x.root)
group by word, form"""

SQL["op11_prefix_trie"] = rf"""
with tab as ({_CRC_TABLE}),
t as (select conv_id, strlen(coalesce(text, '')) as bytes, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as id,
   row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos from conversations where conv_id is not null),
convs as (select conv_id, n, {_crc("list_transform(string_split(conv_id::varchar, ''), lambda c: unicode(c)::bigint)")} % 9 as h
   from (select conv_id, count(*) as n from t group by 1), tab),
info as (select c.conv_id, c.conv_id - c.conv_id % 5 as base, c.h, least(c.h, coalesce(b.n, 0)) as k, c.n
   from convs c left join convs b on b.conv_id = c.conv_id - c.conv_id % 5),
rebuilt as (select i.conv_id, t.pos + 1 as d, id, bytes from info i join t on t.conv_id = i.base and t.pos < i.h
   union all select i.conv_id, t.pos - h + k + 1, id, bytes from info i join t on t.conv_id = i.conv_id and t.pos >= i.h),
ways as (select conv_id, 0 as d, '' as way, 0 as bytes from convs union all
   select conv_id, d, md5(string_agg(id, '') over (partition by conv_id order by d rows unbounded preceding)), bytes from rebuilt),
named as (select *, min(conv_id) over (partition by d, way) as r, max(d) over (partition by conv_id) as size from ways),
nodes as (select r, d, count(*) as n_convs, any_value(bytes) as bytes,
   sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where size = d), '')) as ends_sha256 from named group by r, d),
family as (select x.*, p.r as parent from nodes x left join named p on p.conv_id = x.r and p.d = x.d - 1),
kids as (select parent, d - 1 as d, count(*) as n from family where parent is not null group by all),
full_ as (select f.*, coalesce(k.n, 0) as n_children from family f left join kids k on k.parent = f.r and k.d = f.d),
below as (select up.r, up.d, sum(case when x.n_children = 0 then 1 else 0 end) as n_leaves, sum((x.n_convs - 1) * x.bytes) as saved_tokens
   from full_ x join named up on up.conv_id = x.r and up.d <= x.d group by all)
select r as conv_id, d::bigint as depth, parent as parent_conv_id, n_convs::bigint as n_convs, n_children::bigint as n_children,
   n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, ends_sha256 from full_ join below using (r, d)"""
