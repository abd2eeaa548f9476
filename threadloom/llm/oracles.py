"""SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

#: Copies, exact shingle overlap and its connected components, all pairs that share a shingle.
NGRAM_JACCARD = r"""
with recursive k as (
  select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') as w from documents where doc_id is not null),
c as (select array_to_string(w, ' ') as key, min(doc_id) as copy_id, count(*) as n_copies, any_value(w) as w from k group by 1),
g as (select distinct copy_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [key]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from c),
n as (select copy_id, count(*) as n from g group by 1),
p as (select a.copy_id as a, b.copy_id as b, count(*) as m from g a join g b on a.s = b.s and a.copy_id < b.copy_id group by all),
l as (select a, b from p join n x on x.copy_id = a join n y on y.copy_id = b where 5 * m >= 4 * (x.n + y.n - m)),
e as (select a, b from l union all select b, a from l),
r as (select copy_id as node, copy_id as root from c union select e.b, r.root from r join e on e.a = r.node),
cls as (select node, min(root) as class_id from r group by node),
deg as (select a, count(*) as n_links from e group by a)
select k.doc_id, cls.class_id, c.copy_id, c.n_copies, coalesce(deg.n_links, 0) as n_links
from k join c on c.key = array_to_string(k.w, ' ') join cls on cls.node = c.copy_id left join deg on deg.a = c.copy_id
"""

#: What the formatted text must hold, and how long it is: marks, and two letters more for each control string, one for each backslash.
CHAT_FORMAT = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
x as (select *, length(regexp_replace(replace(role, '\', '\\'), '(<s>|</s>|\[INST\]|\[/INST\])', '\1..', 'g')) + length(regexp_replace(replace(text, '\', '\\'), '(<s>|</s>|\[INST\]|\[/INST\])', '\1..', 'g'))
  + length('<s>[INST]  [/INST]') + length('</s>') + 2 as n from t),
o as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
  coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss, sum(n)::bigint as formatted_chars from x group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars, false as rewrites_history from o
"""

#: Every item against every document that shares a term.
LEXICAL_SEARCH = r"""
with d as (select row_number() over () as d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
q as (select row_number() over () as q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from benchmark),
c as (select count(*) as n, sum(len(w))::bigint as l from d where len(w) > 0),
m as (select d, doc_id, 75 + (25 * len(w) * c.n) // c.l as m from d, c where len(w) > 0),
p as (select d, term, count(*) as tf from (select d, unnest(w) as term from d) group by all),
t as (select term, floor(1000 * ln((2 * c.n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, c group by term, c.n),
a as (select q, item_id, term, count(*) as r from (select q, item_id, unnest(w) as term from q) group by all),
s as (select q, item_id, d, sum(r * t.w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score, any_value(doc_id) as doc_id from a join t using (term) join p using (term) join m using (d) group by all)
select item_id, rank, doc_id, score from (select *, row_number() over (partition by q order by score desc, doc_id) as rank from s where score > 0) where rank <= 20
"""

#: The checksum's table by its rule, folded over the bytes of each distinct feature.
RESAMPLING = r"""
with recursive e as (select range as i, range as v, 0 as k from range(256) union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from e where k < 8),
z as (select list(v order by i) as z from e where k = 8),
w as (select 0 as kind, row_number() over () as d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all select 1, row_number() over (), null, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
f as (select kind, d, unnest(w) as g from w),
h as (select g, list_transform(range(1, octet_length(encode(g)) + 1), lambda i: ('0x' || substr(hex(encode(g)), 2 * i - 1, 2))::bigint) as b from (select distinct g from f)),
b as (select g, xor(list_reduce(b, lambda a, x: xor(a >> 8, z[(xor(a, x) & 255) + 1]), 4294967295::bigint), 4294967295) % 10000 as b from h, z),
n as (select kind, b, count(*) as n from f join b using (g) group by all),
k as (select sum(n) filter (kind = 0) as s, coalesce(sum(n) filter (kind = 1), 0) as t from n),
v as (select r.range as b, floor(1000 * ln(((coalesce(y.n, 0) + 1) * (k.s + 10000))::double / ((coalesce(x.n, 0) + 1) * (k.t + 10000))::double))::bigint as v
  from range(10000) r cross join k left join n x on x.kind = 0 and x.b = r.range left join n y on y.kind = 1 and y.b = r.range),
s as (select d, sum(v)::bigint as weight from f join b using (g) join v using (b) where kind = 0 group by d),
o as (select doc_id, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[:8])::bigint + 0.5::double) / 4294967296)))::bigint as score from w left join s using (d) where kind = 0),
r as (select *, n_features >= 20 as able, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as rank, count(*) filter (n_features >= 20) over () as able_all from o)
select doc_id, n_features, weight, score, case when able and rank <= able_all * 10 // 100 then rank end as rank from r
"""

ORACLE: dict[str, str] = {"op5_ngram_jaccard": NGRAM_JACCARD, "op10_chat_format": CHAT_FORMAT, "op12_lexical_search": LEXICAL_SEARCH, "op13_importance_resampling": RESAMPLING}
