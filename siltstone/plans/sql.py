"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

from ..functions.questions import marker_pattern


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def squeeze_sql(c: str) -> str:
    return trim_sql(f"regexp_replace({c}, '\\s+', ' ', 'g')")


def marker_sql(c: str, markers) -> str:
    return f"regexp_matches({c}, '{marker_pattern(markers)}')"


DOCS_CTE = "docs as (select doc_id, source, 'doc://' || source || '/' || doc_id as url, split_part(text, chr(10), 1) as title, text from documents)\n"
DOCS = "with " + DOCS_CTE

#: The sliding window as a recursion, one step a chunk. Windows that strip to nothing are dropped before chunks are numbered.
CHUNKS = f"""with recursive base as (select doc_id, {trim_sql('text')} as t from documents),
w as (
  select doc_id, t, 0 as i, 0 as j from base where t <> '' and false
  union all select doc_id, t, 0 as i, case when length(t) > 600 and e > 0 then 400 + e else least(length(t), 600) end as j
    from (select doc_id, t, length(regexp_extract(substr(t, 401, 200), '(?s)^.*[.!?。！？]\\s+')) as e from base where t <> '')
), steps as (
  select doc_id, t, i, j from w
  union all
  select doc_id, t, n, case when m < length(t) and e > 0 then s + e else m end from (
    select doc_id, t, n, m, s, length(regexp_extract(substr(t, s + 1, m - s), '(?s)^.*[.!?。！？]\\s+')) as e from (
      select doc_id, t, n, least(length(t), n + 600) as m, greatest(n, least(length(t), n + 600) - 200) as s from (
        select doc_id, t, greatest(0, j - 150) as n from steps where j < length(t))))
), pieces as (
  select doc_id, i, {trim_sql('substr(t, i + 1, j - i)')} as text from steps
), numbered as (
  select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) as chunk_index, text from pieces where text <> ''
), chunks as (
  select doc_id * 1000000 + chunk_index as chunk_id, doc_id, chunk_index, text, cast(length(text) as int) as text_len, sha256(text) as chunk_hash from numbered
)
"""

_A, _B = (f"regexp_replace(split_part(text, ' ', {k}), '[^a-zA-Z]', '', 'g')" for k in (1, 3))
QUESTIONS = f"""select item_id as query_id, case item_id % 12 when 0 then 'Who is ' || {_A} || ' ' || {_B} || '?' when 1 then 'Where is the ' || {_A} || ' of ' || {_B} || '?'
  when 2 then 'What is ' || {_A} || '''s best build?' when 3 then 'What is the latest version of ' || {_A} || '?' when 4 then 'How does ' || {_A} || ' work with ' || {_B} || '?'
  when 5 then 'What is ' || {_A} || ' ' || {_B} || '?' when 6 then 'Tell the story of ' || {_A} || ' before ' || {_B} || ' left whose home it was'
  when 7 then 'Which weapon should ' || {_A} || ' use?' when 8 then 'What is the damage value of the ' || {_A} || ' skill at level 9?'
  when 9 then 'Compare ' || {_A} || ' and ' || {_B} || ' and say what the difference is now?' when 10 then 'summarize everything about ' || {_A}
  else {_A} || ' ' || {_B} || ' crit' end as question from benchmark"""
