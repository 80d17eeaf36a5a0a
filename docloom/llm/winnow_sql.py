"""DuckDB SQL for the decontamination query."""

DECONTAMINATION = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null
), item_windows as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') as gram
  from item_words, unnest(range(1, len(w) - least(len(w), 13) + 2)) as t(p) where len(w) > 0
), sizes as (select distinct n from item_windows),
places as (
  select doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') as gram
  from words, sizes, unnest(range(1, len(w) - n + 2)) as t(p) where len(w) >= n
), hits as (
  select doc_id, item_id, p, n from places join item_windows using (n, gram)
), hit_words as (
  select doc_id, count(distinct p + k) as n_hit from hits, unnest(range(0, n)) as t(k) group by doc_id
), hit_items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words left join hit_words using (doc_id) left join hit_items using (doc_id)
"""
