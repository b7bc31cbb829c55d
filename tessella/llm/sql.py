"""SQL of the training-data queries, for those that SQL can express on whole tables."""

from __future__ import annotations

_FOLD = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')"
_NAME = "array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(lower({0}), '[\\s\\p{{Z}}\\p{{Cf}},.;]+'), lambda p: regexp_replace(p, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')), lambda p: p <> '')), ' ')"

_P6_ROWS = f"""
with k as (
  select 'papers' as record_table, paper_id as id, {_FOLD.format("title")} as t,
    coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(authors, lambda x: x is not null), lambda x: {_NAME.format("x")}), lambda x: x <> ''))), '|'), '') as a
  from papers where title is not null
  union all select 'seen_papers', record_id, {_FOLD.format("identity")}, '' from seen_papers where identity is not null)
"""


_STAND_INS = "'', 'null', 'none', 'na', 'nan', 'nil', 'tba', 'tbd', 'unknown', 'missing', 'abstract', 'summary', 'noabstract', 'noabstractavailable', 'abstractnotavailable', 'notavailable', 'abstractwithheld', 'seefulltext', 'seepdf', 'seepaper', 'fulltext', 'abstractunavailable', 'noabstractprovided', 'abstractnotprovided', 'nosummaryavailable', 'clicktoread', 'comingsoon'"

_P2_BEST = r"""
with a as (
  select *, regexp_replace(regexp_extract(replace(lower(doi), '%2f', '/'), '(10\.\d{3,9}\s*/+\s*[^\s"<>]+)', 1), '\s*/+\s*', '/', 'g') as d,
    lower(regexp_replace(source, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) as k,
    trim(regexp_replace(trim(regexp_replace(abstract, '[\s\x{00a0}]+', ' ', 'g')), '(?i)(\s*(\.\.\.|\x{2026}|\[(truncated|\.\.\.|\x{2026}|more)\]|read more|show more|continue reading)\s*[.\x{2026}]*)+$', '')) as t
  from papers),
b as (
  select *, regexp_replace(d, '[.,;:)\]}'']+$', '') as g,
    case when t is not null and regexp_replace(lower(t), '[^\p{L}\p{N}]+', '', 'g') not in (STAND_INS)
      and not regexp_matches(lower(t), '^(access to this (content|article|document)|this (site|website) (sets|uses)|sign in|log in|please (sign|log) in|subscribe|you do not have access|we use cookies|cookies? )') then lower(t) end as own
  from a where d <> ''),
notice as (select own as n from b where own is not null group by own having count(distinct g) >= 3),
r as (select b.*, coalesce(-trust, -1073741824) as tr from b left join archives on archives.source = b.k),
groups as (select g, count(*) as n_rows from r group by g having count(*) >= 2),
c as (
  select g, 'abstract' as field_name, length(t) as rank, retrieved_at, paper_id from r where own is not null and own not in (select n from notice)
  union all select g, 'pdf_url', tr, retrieved_at, paper_id from r where regexp_matches(trim(pdf_url), '(?i)^https?://[^/\s]+/\S*(\.pdf([?#]\S*)?$|pdf/[^/\s]+)') and not regexp_matches(trim(pdf_url), '(?i)/(login|signin|sign-in|abs|landing|cookies?|consent)([/?#]|$)')
  union all select g, 'citation_count', 0, retrieved_at, paper_id from r where citation_count >= 0
  union all select g, 'source', tr, retrieved_at, paper_id from r where k <> ''),
best as (select g, field_name, paper_id from (select *, row_number() over (partition by g, field_name order by rank desc, retrieved_at desc, paper_id) as rn from c) where rn = 1)
""".replace("STAND_INS", _STAND_INS)


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"{_P2_BEST} select g as doi, field_name, paper_id from best where g in (select g from groups)",
        "p5_checks": "select item_no, cast(strlen(text) as bigint) as n_bytes, true as whole, true as within, line_start + length(text) - length(replace(text, chr(10), '')) = line_end as lines from chunks where text is not null and byte_offset is not null",
        "p6_found": f"{_P6_ROWS} select record_table, kept_id, id as copy_id from (select record_table, id, min(id) over (partition by record_table, t, a) as kept_id from k) where id <> kept_id",
        "p6_collapsed": f"{_P6_ROWS} select record_table, min(id) as kept_id, count(*) as copies from k group by record_table, t, a",
    }
