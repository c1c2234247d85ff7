"""SQL for DuckDB beside the queries whose results SQL can express."""

from __future__ import annotations

from patronlens.llm.license_rules import all_rules
from patronlens.llm.licenses import keyword, signature

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


RULES = ",\n".join(
    f"({', '.join(map(_text, (r.kind, r.label, keyword(r), signature(r))))}, {r.priority}, {r.weight})" for r in all_rules()
)

LICENSES = rf"""
with rules(kind, label, kw, rx, priority, weight) as (values {RULES}),
words as (
  select doc_id, case when w = '' then '' else ' ' || w || ' ' end as words
  from (select doc_id, trim(regexp_replace({LOWER}, '{NOT_ALNUM}', '  ', 'g'), ' ') as w from documents)
),
hit as (
  select doc_id, kind, label, priority, weight,
    list_transform(regexp_extract_all(words, rx), lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) as sizes,
    list_transform(regexp_split_to_array(words, rx), lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) as gaps
  from words join rules on contains(words, kw) and regexp_matches(words, rx)
),
place as (
  select doc_id, kind, label, priority, weight, i,
    cast(list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) as bigint) as first, sizes[i] as size
  from (select *, unnest(range(1, len(sizes) + 1)) as i from hit)
),
detection as (select distinct doc_id, kind, label, priority, weight, first, first + size - 1 as last from place),
marked as (
  select d.*, not exists (
    select 1 from detection o
    where o.doc_id = d.doc_id and o.priority >= d.priority and o.first <= d.first and o.last >= d.last
      and ((o.last - o.first) > (d.last - d.first) or o.priority > d.priority
        or (o.priority = d.priority and (o.label, o.kind, o.weight) < (d.label, d.kind, d.weight)))
  ) as kept from detection d
),
found as (
  select doc_id,
    count(*) filter (where kind = 'base') as n_base,
    min(first) filter (where kind = 'base') as first_word,
    max(first) filter (where kind = 'base') as last_word,
    string_agg(distinct label, ',' order by label) filter (where kind = 'base') as base_labels,
    string_agg(distinct label, ',' order by label) filter (where kind = 'base' or kept) as labels,
    max(weight) filter (where kept) / 100.0::double as score
  from marked group by doc_id
)
select w.doc_id, cast((length(words) - length(replace(words, ' ', ''))) // 2 as bigint) as n_words,
  coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
  coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
from words w left join found f on w.doc_id = f.doc_id
"""


def _digits(column: str, start: int, modulus: int) -> str:
    return f"(('0x' || substr(md5({column}), {start}, 6))::bigint % {modulus})"


URLS = rf"""
with page as (
  select page_id, url, date '2023-01-01' + cast({_digits('url', 1, 730)} as integer) as day,
    rtrim(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '.') as host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') as steps
  from pages
),
labelled as (select *, string_split(host, '.') as labels from page where host <> ''),
asked as (
  select page_id, day, unnest(list_distinct(
    [host] || list_transform(range(2, len(labels)), lambda k: array_to_string(labels[len(labels) - k + 1:], '.'))
    || list_transform(range(1, len(steps) + 1), lambda k: host || '/' || array_to_string(steps[1:k], '/')))) as key
  from labelled
),
candidate as (
  select distinct unnest([host] || list_transform(range(2, len(labels)), lambda k: array_to_string(labels[len(labels) - k + 1:], '.'))
    || list_transform(range(1, len(steps) + 1), lambda k: host || '/' || array_to_string(steps[1:k], '/'))) as key
  from labelled
),
listed as (
  select key, (['adult', 'gambling', 'malware', 'spam'])[{_digits('key', 25, 4)} + 1] as category,
    {_digits('key', 27, 3)} + 1 as n, {_digits('key', 1, 500)} as a, {_digits('key', 7, 120)} as b, {_digits('key', 13, 90)} as c
  from candidate where {_digits('key', 19, 3)} = 0
),
active as (
  select key, category, date '2023-01-01' + cast(a as integer) as valid_from,
    case when n >= 2 then date '2023-01-01' + cast(a + b + 1 as integer) end as valid_to from listed
  union all
  select key, category, date '2023-01-01' + cast(a + b + c + 2 as integer), null from listed where n = 3
),
best as (
  select page_id, first({{'key': a.key, 'category': category, 'valid_from': valid_from}} order by length(a.key) desc, a.key) as b
  from asked s join active a on a.key = s.key and day >= valid_from and (valid_to is null or day < valid_to)
  group by page_id
)
select p.page_id, day, host, b is not null as blocked, b.key as entry, b.category as category, b.valid_from as valid_from
from page p left join best using (page_id)
"""

DECONTAMINATION = rf"""
with doc as (select doc_id, regexp_extract_all({LOWER}, '{ALNUM}') as w from documents),
item as (select cast(item_id as varchar) as item, regexp_extract_all({LOWER}, '{ALNUM}') as w from benchmark),
gram as (
  select distinct item, size, array_to_string(w[i:i + size - 1], ' ') as gram
  from (select item, w, least(len(w), 10) as size, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from item where len(w) > 0)
),
sizes as (select distinct size from gram),
place as (
  select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as gram
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from doc cross join sizes where len(w) >= size)
),
hit as (select doc_id, i, size, item from place join gram using (gram, size)),
counted as (
  select doc_id, count(distinct spot) as n_hit from (select doc_id, unnest(range(i, i + size)) as spot from hit) group by doc_id
),
found as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hit) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join counted using (doc_id) left join found using (doc_id)
"""

WARC = """
with payload as (select page_id, coalesce(html, '') as html from pages),
sized as (
  select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha1(html) as payload_digest,
    max(page_id) over (partition by html) as largest
  from payload
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> largest then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> largest then largest end as refers_to
from sized
"""

FILTER_AUDIT = r"""
with flags as (
  select doc_id, max(cast(quality = 1 as bigint)) as good, max(cast(toxic = 1 as bigint)) as toxic from labels group by doc_id
),
doc as (
  select coalesce(source, '') as part, d.doc_id, coalesce(text, '') as text, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents d left join flags f on d.doc_id = f.doc_id
),
failed as (
  select part, good, toxic,
    (case when len(w) < 200 then 'A' else '' end)
    || (case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end)
    || (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) then 'C' else '' end)
    || (case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end)
    || (case when doc_id > min(doc_id) over (partition by text) then 'E' else '' end) as letters
  from doc
),
counted as (select part, letters, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by part, letters),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
orders as (
  select a.l || b.l || c.l || d.l || e.l as o
  from letter a, letter b, letter c, letter d, letter e
  where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
place as (select o, step, substr(o, step, 1) as l, substr(o, 1, step - 1) as before from orders, (select unnest(range(1, 6)) as step)),
judged as (
  select c.*, o, step, l, contains(letters, l) as fails, translate(letters, before, '') <> letters as gone from counted c, place
),
summed as (
  select part, o, step, l,
    sum(case when not fails and not gone then n else 0 end) as kept,
    sum(case when fails and not gone then n else 0 end) as removed,
    sum(case when fails and gone then n else 0 end) as redundant,
    sum(case when letters = l then n else 0 end) as unique_fails,
    sum(case when fails and not gone then good else 0 end) as good_lost,
    sum(case when fails and not gone then toxic else 0 end) as toxic_lost
  from judged group by part, o, step, l
)
select part, o as filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, l) as bigint) as shapley
from summed
"""

TOP_K = """
with whole as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings
  where list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from whole q join whole c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored qualify rank <= 20
"""

# The table of CRC-32 by its rule, then one step for each byte.
SPELLING = r"""
with recursive crc as (
  select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by i) as steps
  from range(256) r(i)
),
run as (
  select doc_id, r, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as r
        from documents)
  where length(r) >= 6 group by doc_id, r
),
hashed as (
  select r, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || r)), '..'), lambda x: cast('0x' || x as bigint))),
    lambda c, b: xor(steps[xor(c % 256, b) + 1], c // 256))) as h
  from run, crc
),
word as (
  select case when h % 199 = 0 then r[1:h % length(r)] || r[h % length(r) + 2:] else r end as w, cast(sum(n) as bigint) as n
  from hashed group by w having sum(n) >= 5
),
kept as (select * from word where length(w) >= 6),
less as (select w, n, i, w[1:i - 1] || w[i + 1:] as rest from (select w, n, unnest(range(1, length(w) + 1)) as i from kept)),
near as (
  select a.w, a.n, b.w as other, b.n as other_n from less a join less b on a.i = b.i and a.rest = b.rest and a.w <> b.w
  union select a.w, a.n, b.w, b.n from less a join kept b on a.rest = b.w
  union select b.w, b.n, a.w, a.n from less a join kept b on a.rest = b.w
),
best as (
  select w, n, count(*) as n_near, first({'w': other, 'n': other_n} order by other_n desc, other) as b from near group by w, n
),
formed as (
  select k.w, k.n, coalesce(n_near, 0) as n_near, case when b.n >= 5 * k.n then b.w end as form, case when b.n >= 5 * k.n then b.n end as form_n
  from kept k left join best using (w)
),
walk as (
  select w, w as here, form as next from formed
  union all select walk.w, walk.next, f.form from walk join formed f on f.w = walk.next
)
select f.w as word, form, here as root, n, n_near, form_n from formed f join walk on walk.w = f.w and walk.next is null
"""

ORACLE = {
    "op2_license_scans": LICENSES,
    "op3_url_filters": URLS,
    "op6_decontamination": DECONTAMINATION,
    "op9_warc": WARC,
    "op11_top_k": TOP_K,
    "op12_spelling": SPELLING,
    "op13_filter_audit": FILTER_AUDIT,
}
