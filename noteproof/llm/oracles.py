"""What DuckDB must return for the training-data queries that SQL can express."""

from __future__ import annotations

#: crc32 of the UTF-8 bytes of the column ``word`` of ``given``, as table ``coded`` (word, crc): the table of 256 remainders by its rule, then byte by byte.
_CRC = """
crc_table as (
  select list(c order by i) as t from (
    select i, list_reduce([i::bigint] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))
), byted as (
  select word, list_transform(range(octet_length(encode(word))), lambda k: ('0x' || substr(hex(encode(word)), 2 * k::int + 1, 2))::int::bigint) as bytes from given
), coded as (
  select word, xor(list_reduce([4294967295::bigint] || bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as crc from byted, crc_table
)"""

PREFIX_TRIE = f"""
with numbered as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null
), given as (select distinct conv_id::varchar as word from numbered), {_CRC}, convs as (
  select word::bigint as conv_id, crc % 9 as h, word::bigint - word::bigint % 5 as base from coded
), turns as (
  select c.conv_id, 0 as side, t.pos, t.role, t.text from convs c join numbered t on t.conv_id = c.base where t.pos < c.h
  union all
  select c.conv_id, 1, t.pos, t.role, t.text from convs c join numbered t on t.conv_id = c.conv_id where t.pos >= c.h
), seqs as (
  select c.conv_id, coalesce(list({{'r': t.role, 't': t.text}} order by t.side, t.pos) filter (where t.pos is not null), []) as s
  from convs c left join turns t on t.conv_id = c.conv_id group by c.conv_id
), prefixes as (
  select conv_id, unnest(range(len(s) + 1)) as depth, s from seqs
), members as (
  select conv_id, depth, len(s) = depth as ends, octet_length(encode(s[depth].t)) as bytes,
    min(conv_id) over (partition by depth, s[1:depth]) as node
  from prefixes
), nodes as (
  select depth, node, count(*) as n_convs, coalesce(min(bytes), 0) as bytes,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from members group by depth, node
), linked as (
  select n.*, p.node as parent from nodes n left join members p on p.conv_id = n.node and p.depth = n.depth - 1
), kids as (
  select depth - 1 as depth, parent as node, count(*) as n_children from linked where depth > 0 group by all
), placed as (
  select l.*, coalesce(k.n_children, 0) as n_children from linked l left join kids k on k.depth = l.depth and k.node = l.node
), sums as (
  select a.depth, a.node, sum((p.n_children = 0)::int) as n_leaves, sum((p.n_convs - 1) * p.bytes) as saved
  from placed p join members a on a.conv_id = p.node and a.depth <= p.depth group by a.depth, a.node
)
select p.node as conv_id, p.depth, p.parent as parent_conv_id, p.n_convs, p.n_children, s.n_leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, p.ends_sha256
from placed p join sums s on s.depth = p.depth and s.node = p.node
"""

RESAMPLING = f"""
with rows as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words
  from documents
), raw_words as (select rid, unnest(words) as word from rows), target_words as (
  select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word from benchmark
), given as (select word from raw_words union select word from target_words), {_CRC}, cells as (select word, crc % 10000 as bucket from coded
), raw as (select bucket, count(*) as s from raw_words join cells using (word) group by bucket
), target as (select bucket, count(*) as t from target_words join cells using (word) group by bucket
), totals as (select (select coalesce(sum(s), 0) from raw)::double as s_all, (select coalesce(sum(t), 0) from target)::double as t_all
), gains as (
  select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * (s_all + 10000)) / ((s + 1)::double * (t_all + 10000))))::bigint as gain
  from raw left join target using (bucket), totals
), weighed as (select rid, sum(gain)::bigint as weight from raw_words join cells using (word) join gains using (bucket) group by rid
), scored as (
  select rid, doc_id, len(words)::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from rows left join weighed using (rid)
), ranked as (
  select rid, row_number() over (order by score desc, doc_id nulls last, n_features desc) as place, count(*) over () as able from scored where n_features >= 20
)
select doc_id, n_features, weight, score, case when place <= 10 * able // 100 then place end as rank from scored left join ranked using (rid)
"""
