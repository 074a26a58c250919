"""SQL that says the same as a query, where SQL can."""

HOST_RULES = r"""
with t as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
u as (select rid, unnest(range(1, len(w) - 1)) as i, w from w),
c as (select rid, i, count(*) over (partition by rid, array_to_string(w[i:i + 2], ' ')) as n from u),
v as (select rid, count(distinct p) as n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) as p from c where n > 1) group by 1),
m as (select w.rid, doc_id, source, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join v using (rid)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
d as (select *, base_failed or 100 * n_symbols > 10 * word_chars or 100 * n_dup_lines > 30 * n_lines as wrong from b),
h as (select source, count(*) as n, sum(wrong::int) as f from d where source is not null group by 1),
p as (select least(greatest(sum(f) / sum(n), 1e-6), 1 - 1e-6) as mean, coalesce(var_samp(f / n), 0) as v, avg(1 / n) as noise, count(*) as hosts from h),
s as (select mean, case when v - mean * (1 - mean) * noise > 1e-9 then least(greatest(mean * (1 - mean) / (v - mean * (1 - mean) * noise) - 1, 2.0), 1e4) when hosts > 1 then 1e4 else 2.0 end as strength from p),
r as (select source, (f + mean * strength) / (n + strength) as rate from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(rate, 0) <= 0.6 as kept, round(rate, 6) as host_rate from d left join r on d.source = r.source
"""

NEAR_DUPLICATES = r"""
with recursive t as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from documents where text is not null),
u as (select min(doc_id) as k, any_value(w) as w, count(*) as copies, text from t group by text),
g as (select distinct k, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from u),
n as (select k, count(*) as c from g group by 1),
p as (select a.k as a, b.k as b, count(*) as x from g a join g b on a.s = b.s and a.k <> b.k group by 1, 2),
e as (select a, b from p join n na on a = na.k join n nb on b = nb.k where x >= 0.8 * (na.c + nb.c - x) - 1e-9),
reach as (select k as node, k as other from u union select reach.node, e.b from reach join e on reach.other = e.a),
c as (select node as k, min(other) as class_id from reach group by 1),
l as (select a as k, sum(copies) as s from e join u on b = k group by 1),
z as (select class_id, sum(copies)::bigint as class_size from c join u using (k) group by 1)
select doc_id, class_id, (coalesce(s, 0) + copies - 1)::bigint as n_links, class_size, copies::bigint as copies, doc_id = class_id as kept
from t join u using (text) join c using (k) join z using (class_id) left join l using (k)
union all select doc_id, doc_id, 0, 1, 1, true from documents where text is null
"""

EXACT_TOPK = r"""
with t as (select distinct vec_id as id, list_transform(embedding, lambda v: floor(256 * v::double)::bigint) as x from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda v: v is null or isnan(v) or isinf(v))) = 0),
p as (select q.id as query_id, c.id as vec_id, coalesce(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])), 0)::bigint as score
    from t q join t c on q.id % 50 = 0 and q.id <> c.id and len(q.x) = len(c.x)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from p)
select query_id, place::int as rank, vec_id, score from r where place <= 5
"""

#: CRC-32 of a text column c: the table of remainders comes from its polynomial.
CRC = r"""
crc_table as (select list(v order by n) as t from (select n, list_reduce([n::ubigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: case when a & 1 = 1 then xor(a >> 1, 3988292384::ubigint) else a >> 1 end) as v from range(256) r(n)))
"""


def crc(text: str) -> str:
    """Unsigned CRC-32 of a text in UTF-8, beside the table t."""
    of_bytes = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::ubigint)"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {of_bytes}), lambda a, v: xor(a >> 8, t[(xor(a, v) & 255)::int + 1])), 4294967295::ubigint)"


PREFIX_TRIE = f"""
with {CRC.strip()},
m as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, substr(sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) - 1 as pos,
    length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '') as said, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as words from conversations where conv_id is not null),
k as (select c, count(*) as own from m group by 1),
h as (select k.*, {crc("k.c::varchar")}::bigint % 4 as h, k.c - k.c % 20 as base from k, crc_table),
n as (select h.*, least(h, coalesce(b.own, 0)) as taken from h left join k b on b.c = h.base),
r as (select n.c, m.pos, said, words from n join m on m.c = n.base and m.pos < h union all select n.c, m.pos - h + taken, said, words from n join m on m.c = n.c and m.pos >= h),
p as (select c, pos + 1 as depth, words, sha256(string_agg(sha256(said), '') over (partition by c order by pos)) as d, pos + 1 = count(*) over (partition by c) as ends from r),
p0 as (select * from p union all select c, 0, 0, '', c not in (select c from r) from k),
nodes as (select d, depth, min(c) as c, count(*) as n_convs, any_value(words) as words, coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '') as ended from p0 group by 1, 2),
up as (select nodes.d as d, p0.d as parent from nodes join p0 on p0.c = nodes.c and p0.depth = nodes.depth - 1),
kids as (select parent as d, count(*) as n_children from up group by 1),
all_up as (select nodes.*, coalesce(n_children, 0) as n_children, p0.d as above from nodes left join kids using (d) join p0 on p0.c = nodes.c and p0.depth <= nodes.depth),
sums as (select above as d, sum((n_children = 0)::int)::bigint as n_leaves, sum((n_convs - 1) * words)::bigint as saved_tokens from all_up group by 1)
select nodes.c as conv_id, nodes.depth, o.c as parent_conv_id, nodes.n_convs, coalesce(n_children, 0)::bigint as n_children, n_leaves, saved_tokens, sha256(nodes.ended) as ends_sha256
from nodes join sums using (d) left join kids using (d) left join up using (d) left join nodes o on o.d = up.parent
"""

IMPORTANCE = f"""
with {CRC.strip()},
w as (select doc_id, row_number() over () as rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
v as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
f as (select rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from w),
g as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from v),
b as (select f, {crc("f")} % 10000 as bucket from (select distinct f from (select f from f union all select f from g)), crc_table),
s as (select bucket, count(*) as s from f join b using (f) group by 1),
t as (select bucket, count(*) as t from g join b using (f) group by 1),
n as (select (select coalesce(sum(s), 0) from s)::double as big_s, (select coalesce(sum(t), 0) from t)::double as big_t),
gain as (select n.big_s, bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::double) * (big_s + 10000) / ((coalesce(s, 0) + 1.0::double) * (big_t + 10000))))::bigint as gain from s full join t using (bucket), n),
m as (select rid, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from f join b using (f) join gain using (bucket) group by 1),
d as (select doc_id, w.rid, len(w) >= 20 as eligible, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, ('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint as h from w left join m using (rid)),
e as (select *, (weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))))::bigint as score from d),
o as (select *, row_number() over (partition by eligible order by score desc, doc_id nulls first) as place, count(*) filter (eligible) over () as big_n from e)
select doc_id, n_features, weight, score, case when eligible and place <= 25 * big_n // 100 then place end as rank from o
"""
