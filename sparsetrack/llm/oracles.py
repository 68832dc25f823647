"""SQL for the operators that have a plain SQL form, for a database with ``documents`` and ``benchmark``.

They compare windows or shingles as they are, so they suit tables of some thousand documents.
"""

from __future__ import annotations

#: Bytes from UTF-8 text as pairs of hexadecimal digits; a window is 100 bytes.
SUFFIX_DEDUP = """
with bytes as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
starts as (select doc_id, n, s, md5(substr(h, 2 * s + 1, 200)) as w from (select doc_id, h, n, unnest(range(0, n - 99)) as s from bytes)),
ranked as (select doc_id, s, row_number() over (partition by w order by doc_id, s) as r from starts),
hits as (select doc_id, s, lag(s) over (partition by doc_id order by s) as before from ranked where r > 1),
grouped as (select doc_id, s, sum(case when before is null or s > before + 100 then 1 else 0 end) over (partition by doc_id order by s) as g from hits),
spans as (select doc_id, min(s) as a, max(s) + 100 as b from grouped group by doc_id, g),
gaps as (
  select doc_id, coalesce(lag(b) over w, 0) as a, a as b from spans window w as (partition by doc_id order by a)
  union all select doc_id, max(b), null from spans group by doc_id
),
kept as (
  select g.doc_id, string_agg(substr(x.h, 2 * g.a + 1, 2 * (coalesce(g.b, x.n) - g.a)), '' order by g.a) as h
  from gaps g join bytes x using (doc_id) group by g.doc_id
),
sums as (select doc_id, sum(b - a) as removed, count(*) as spans from spans group by doc_id)
select b.doc_id, b.n as n_bytes, cast(coalesce(s.removed, 0) as bigint) as n_removed, cast(coalesce(s.spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(k.h, b.h))) as kept_sha256
from bytes b left join sums s using (doc_id) left join kept k using (doc_id)
"""

SUBSTRING_DEDUP = """
with words as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
windows as (select doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as s from words)),
firsts as (select h, min(doc_id) as f from windows group by h),
hits as (select doc_id, s from windows join firsts using (h) where f < doc_id),
covered as (select distinct doc_id, s + o as p from hits, (select unnest(range(0, 50)) as o)),
single as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from words),
kept as (
  select s.doc_id, count(c.p) as removed, string_agg(s.x, ' ' order by s.p) filter (where c.p is null) as t
  from single s left join covered c on c.doc_id = s.doc_id and c.p = s.p group by s.doc_id
)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(k.removed, 0) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from words w left join kept k using (doc_id)
"""

NEAR_DUPLICATES = """
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
),
sets as (
  select distinct doc_id, md5(case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[s : s + 4], ' ') end) as h
  from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as s from words where len(w) > 0)
),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b from sets a join sets b using (h) join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))
),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on l.a = r.b),
labels as (select a as doc_id, min(b) as c from reach group by a)
select d.doc_id, coalesce(s.n, 0) as n_shingles, l.c as component_id, d.doc_id = l.c as kept
from documents d join labels l using (doc_id) left join sizes s using (doc_id)
"""

DECONTAMINATION = """
with items as (select cast(item_id as varchar) as item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark),
words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
phrases as (
  select distinct item_id, n, array_to_string(w[s : s + n - 1], ' ') as t
  from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from items where len(w) > 0)
),
places as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from words, (select distinct n from phrases) where len(w) >= n),
hits as (select doc_id, p.n, s, item_id from places x join phrases p on p.n = x.n and p.t = array_to_string(x.w[s : s + x.n - 1], ' ')),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hits) group by doc_id),
named as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as t from hits group by doc_id)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(n.n_items, 0) as n_items,
  sha256(coalesce(n.t, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from words w left join covered c using (doc_id) left join named n using (doc_id)
"""

RANKED_SEARCH = """
with items as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark),
words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
counts as (select doc_id, x, count(*) as tf from (select doc_id, unnest(w) as x from words) group by doc_id, x),
sizes as (select doc_id, len(w) as n from words where len(w) > 0),
whole as (select count(*) as many, cast(sum(n) as bigint) as total from sizes),
weights as (select x, cast(floor(1000 * ln((2 * any_value(many) + 2)::double / (2 * count(*) + 1)::double)) as bigint) as weight from counts, whole group by x),
asked as (select item_id, x, count(*) as times from (select item_id, unnest(w) as x from items) group by item_id, x),
scores as (
  select item_id, doc_id, cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * many) // total)))) as bigint) as score
  from asked join weights using (x) join counts using (x) join sizes using (doc_id), whole group by item_id, doc_id
),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scores where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_dedup": SUFFIX_DEDUP, "op6_minmax_dedup": NEAR_DUPLICATES, "op7_substring_dedup": SUBSTRING_DEDUP, "op8_decontaminate": DECONTAMINATION, "op13_ranked_search": RANKED_SEARCH}
