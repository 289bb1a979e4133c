"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from . import mixing

WORD = r"[^\x20\x09-\x0D]+"

OP4 = rf"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as rid from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '{WORD}') as ws from d),
win as (select rid, unnest(range(1, len(ws) - 6)) as i, ws from w where len(ws) >= 8),
win2 as (select rid, i, array_to_string(ws[i : i + 7], ' ') as s from win),
rep as (select rid, i, lead(i) over (partition by rid order by i) as nxt
        from (select rid, i, count(*) over (partition by rid, s) as c from win2) where c >= 2),
cov as (select rid, cast(sum(least(coalesce(nxt - i, 8), 8)) as bigint) as n from rep group by rid),
ln as (select rid, count(*) - count(distinct l) as n
       from (select rid, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '{WORD}') group by rid),
b as (select w.rid, doc_id, t, len(ws) as n_words,
        cast(length(array_to_string(ws, '')) as bigint) as word_chars,
        cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        coalesce(ln.n, 0) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words
      from w left join ln on ln.rid = w.rid left join cov on cov.rid = w.rid),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or word_chars > 15 * n_words or word_chars < 2 * n_words or 5 * n_symbols > n_words
    or 5 * length(regexp_replace(t, '[^!]', '', 'g')) > n_words
    or 2 * length(regexp_replace(t, '\P{{Lu}}', '', 'g')) > word_chars
    or 2 * length(regexp_replace(t, '\P{{L}}', '', 'g')) < word_chars
    or 2 * len(regexp_extract_all(t, '(?m)(\.\.\.|…)$')) > len(regexp_extract_all(t, '(?m)^.*\S'))) as kept
from f
"""

OP9 = rf"""
with recursive d as (
  select row_number() over () as rid, doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as size from documents),
k as (select *, md5(concat('9:', coalesce(cast(doc_id as varchar), 'null'), ':', size)) as key from d),
per as (select source, cast(sum(size) as bigint) as source_size, 2.0::double * sum(size) as cap,
   row_number() over (order by source is null, source) - 1 as i from k group by source),
per2 as (select *, [5.0::double, 2.0, 1.0][1 + i % 3] as weight, 1.5::double * sum(source_size) over () as budget from per),
per3 as (select *, row_number() over (order by cap / weight, i) as o,
   coalesce(sum(cap) over (order by cap / weight, i rows between unbounded preceding and 1 preceding), 0) as caps,
   sum(weight) over (order by cap / weight, i rows between current row and unbounded following) as rest from per2),
lev as (select (budget - caps) / rest as level from per3 where (budget - caps) / rest * weight <= cap order by o limit 1),
tg as (select source, i, source_size, coalesce(least(cap, (select level from lev) * weight), cap) as target from per3),
tt as (select *, cast(round(target) as bigint) as goal, cast(sum(cast(round(target) as bigint)) over (order by i) as bigint) as hi,
   cast(sum(cast(round(target) as bigint)) over () as bigint) as total from tg),
iv as (select source, cast(hi - goal as hugeint) * {mixing.ONE} // total as lo, cast(hi as hugeint) * {mixing.ONE} // total as up
   from tt where goal > 0),
sl as (select id, (cast(id as hugeint) * {mixing.PHI}) % {mixing.ONE} as u
   from range(cast(round(1.5 * (select sum(size) from k) / {mixing.BLOCK_WORDS}) as bigint)) t(id)),
sc as (select id as slot, source, row_number() over (partition by source order by id) - 1 as r from sl join iv on u >= lo and u < up),
q as (select source, source_size, goal, (source_size + {mixing.BLOCK_WORDS - 1}) // {mixing.BLOCK_WORDS} as blocks from tt where goal > 0),
q2 as (select *, (goal // source_size) * blocks + (goal % source_size + {mixing.BLOCK_WORDS - 1}) // {mixing.BLOCK_WORDS} as quota from q),
came as (select source, count(*) as n from sc group by source),
short as (select q2.source, quota, coalesce(n, 0) as n,
   (select count(*) from sl) - coalesce(n, 0) + coalesce(sum(quota - coalesce(n, 0)) over (order by q2.source is null, q2.source
   rows between unbounded preceding and 1 preceding), 0) as first
   from q2 left join came on came.source is not distinct from q2.source where coalesce(n, 0) < quota),
tail as (select cast(first + r as bigint) as slot, source, r from (select *, unnest(range(n, quota)) as r from short)),
s as (select slot, q2.source, r % blocks as block, r // blocks as pass, least({mixing.BLOCK_WORDS}, goal - ((r // blocks) * source_size + (r % blocks) * {mixing.BLOCK_WORDS})) as words
   from (select * from sc union all select * from tail) x join q2 on q2.source is not distinct from x.source where r < quota),
lay as (select *, cast(sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and current row) as bigint) as e from k),
pc as (select rid, source, e - size as st, e, unnest(range((e - size) // {mixing.BLOCK_WORDS}, (e - 1) // {mixing.BLOCK_WORDS} + 1)) as block from lay where size > 0),
got as (select rid, cast(sum(w) as bigint) as taken, min(case when pass = 0 then slot end) as first_slot, min(case when pass = 1 then slot end) as second_slot
   from (select rid, slot, pass, least(e, pc.block * {mixing.BLOCK_WORDS} + words) - greatest(st, pc.block * {mixing.BLOCK_WORDS}) as w
         from pc join s on s.source is not distinct from pc.source and s.block = pc.block) where w > 0 group by rid)
select doc_id, size, tg.source_size, target, coalesce(taken, 0) as taken,
  coalesce(first_slot, -1) as first_slot, coalesce(second_slot, -1) as second_slot
from k join tg on tg.source is not distinct from k.source left join got on got.rid = k.rid
"""


OP1 = rf"""
with l as (select doc_id, unnest(range(1, len(ls) + 1)) as pos, unnest(ls) as line
           from (select doc_id, string_split(text, chr(10)) as ls from documents)),
c as (select *, sum(len(regexp_extract_all(line, '{WORD}'))) over (partition by doc_id order by pos) as upto from l),
b as (select *, coalesce(lag(upto) over (partition by doc_id order by pos), 0) as before from c),
win as (select x.doc_id, x.pos as s, min(y.pos) as e from b x join b y on x.doc_id = y.doc_id and y.pos >= x.pos and y.upto - x.before >= 50 group by all
        union
        select y.doc_id, max(x.pos) as s, y.pos as e from b x join b y on x.doc_id = y.doc_id and y.pos >= x.pos and y.upto - x.before >= 50 group by y.doc_id, y.pos),
run as (select w.doc_id, s, e, string_agg(line, chr(10) order by pos) as t from win w join l on l.doc_id = w.doc_id and l.pos between s and e group by all),
f as (select *, first_value(doc_id) over v as fd, first_value(e) over v as fe from run window v as (partition by t order by doc_id, s)),
gone as (select distinct f.doc_id, pos from f join l on l.doc_id = f.doc_id and pos between s and e where f.doc_id <> fd or s > fe)
select d.doc_id, coalesce(n.n_lines, 0) as n_lines, coalesce(n.n_removed, 0) as n_removed, case when d.text is not null then coalesce(n.t, '') end as text
from documents d left join (
  select l.doc_id, count(*) as n_lines, count(gone.pos) as n_removed, string_agg(line, chr(10) order by l.pos) filter (gone.pos is null) as t
  from l left join gone on gone.doc_id = l.doc_id and gone.pos = l.pos group by l.doc_id) n on n.doc_id = d.doc_id
"""

_CONTROL = r"(\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\]|\[END\])"

OP2 = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls last, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(3 + sum(length(regexp_replace(text, '{_CONTROL}', '\\\1', 'g')) + case role when 'system' then 15 when 'user' then 13 when 'assistant' then 4
    else 18 + length(regexp_replace(role, '{_CONTROL}', '\\\1', 'g')) end) as bigint) as formatted_chars
from c group by conv_id
"""

OP3 = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
k as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98),
r as (select a, b from k union select r.a, k.b from r join k on k.a = r.b),
c as (select vec_id, (select count(*) from k where a = vec_id) as n_links, least(vec_id, coalesce((select min(b) from r where a = vec_id), vec_id)) as component_id from embeddings)
select vec_id, n_links, component_id, vec_id = component_id as kept from c
"""

OP5 = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
k as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
e as (select a, b from k union select b, a from k),
r as (select a, b from e union select r.a, e.b from r join e on e.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) as component_id
from documents d left join n on n.doc_id = d.doc_id left join (select a, min(b) as low from r group by a) m on m.a = d.doc_id
"""

#: CRC32 by its table of 256 remainders; a prefix is named by the JSON of its turns.
OP11 = """
with t as (select list(r order by i) as rest from (select i, list_reduce([i] || range(8), lambda a, b: case when a % 2 = 1 then xor(3988292384, a // 2) else a // 2 end) as r
           from (select unnest(range(256)) as i))),
o as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) - 1 as idx,
        coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
c as (select conv_id, n, base, xor(4294967295, list_reduce([4294967295] || [ord(x) for x in string_split(cast(conv_id as varchar), '')],
        lambda a, b: xor(rest[xor(a % 256, b) + 1], a // 256))) % 6 as h
      from t, (select conv_id, count(*) as n, conv_id - conv_id % 100 as base from o group by conv_id)),
k as (select c.conv_id, c.base, c.h, least(c.h, coalesce(l.n, 0)) as k, c.n from c left join c l on l.conv_id = c.base),
r as (select k.conv_id, idx as pos, role, text from k join o on o.conv_id = k.base where idx < k.h
      union all select k.conv_id, idx - h + k.k, role, text from k join o on o.conv_id = k.conv_id where idx >= h),
s as (select k.conv_id, list({'role': role, 'text': text} order by pos) filter (pos is not null) as ts from k left join r on r.conv_id = k.conv_id group by k.conv_id),
p as (select conv_id, coalesce(len(ts), 0) as total, unnest(range(0, coalesce(len(ts), 0) + 1)) as depth, coalesce(ts, []) as ts from s),
m as (select conv_id, total, depth, md5(to_json(ts[1 : depth])) as key, case when depth > 0 then md5(to_json(ts[1 : depth - 1])) end as up,
        case when depth > 0 then length(ts[depth].text) else 0 end as chars from p),
n as (select depth, key, any_value(up) as up, any_value(chars) as chars, min(conv_id) as conv_id, count(*) as n_convs,
        sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (total = depth), '')) as ends_sha256 from m group by depth, key),
f as (select n.*, (select count(*) from n x where x.depth = n.depth + 1 and x.up = n.key) as n_children from n),
a as (select m.depth, m.key, cast(sum(case when f.n_children = 0 then 1 else 0 end) as bigint) as n_leaves, cast(sum((f.n_convs - 1) * f.chars) as bigint) as saved_tokens
      from f join m low on low.conv_id = f.conv_id and low.depth = f.depth join m on m.conv_id = f.conv_id and m.depth <= f.depth group by m.depth, m.key)
select f.conv_id, f.depth, q.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
from f join a using (depth, key) left join n q on q.depth = f.depth - 1 and q.key = f.up
"""

ORACLE: dict[str, str] = {"op1_line_dedup": OP1, "op2_chat_format": OP2, "op3_embedding_dedup": OP3, "op4_quality_cascade": OP4,
                          "op5_parity_join": OP5, "op9_mix_schedule": OP9, "op11_prefix_trie": OP11}
