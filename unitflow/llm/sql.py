"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from unitflow.llm import line_dedup

_WORDS = "list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP = f"""
with recursive w as (select doc_id, {_WORDS.format(text=_LOWER)} as ws from documents),
s as (
  select doc_id, unnest(case when len(ws) > 1 then list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) else ws end) as g
  from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
both_ways as (select a, b from links union select b, a from links),
reach as (select doc_id, doc_id as r from documents union select reach.doc_id, both_ways.b from reach join both_ways on both_ways.a = reach.r),
least_of as (select doc_id, min(r) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, l.component_id, d.doc_id = l.component_id as kept
from documents d left join n on n.doc_id = d.doc_id join least_of l on l.doc_id = d.doc_id
"""

QUALITY = f"""
with w as (select doc_id, coalesce(text, '') as text, {_WORDS.format(text="coalesce(text, '')")} as ws from documents),
wins as (
  select doc_id, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) as win, unnest(range(1, len(ws) - 6)) as pos
  from w where len(ws) >= 8),
twice as (select doc_id, win from wins group by doc_id, win having count(*) > 1),
hits as (select distinct wins.doc_id, unnest(range(wins.pos, wins.pos + 8)) as pos from wins join twice on twice.doc_id = wins.doc_id and twice.win = wins.win),
rep as (select doc_id, count(distinct pos)::bigint as n_repeat_words from hits group by doc_id),
lines as (
  select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') as ls from w),
m as (
  select w.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
         len(ls)::bigint as n_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g')) as n_upper, length(regexp_replace(text, '[^!]+', '', 'g')) as n_exclaim
  from w join lines on lines.doc_id = w.doc_id left join rep on rep.doc_id = w.doc_id),
f as (
  select *, (n_words < 20)::int + 2 * (100 * n_repeat_words > 30 * n_words)::int + 4 * (100 * n_symbols > 30 * n_words)::int
         + 8 * (n_dup_lines >= 3 and 100 * n_dup_lines > 50 * n_lines)::int + 16 * (word_chars < 2 * n_words or word_chars > 20 * n_words)::int
         + 32 * (n_upper > 50 and 100 * n_upper > 50 * word_chars)::int + 64 * (n_exclaim > 10 and 100 * n_exclaim > 50 * n_words)::int as failed
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed & 3 <> 0 as base_failed, failed = 0 as kept, failed::bigint as failed
from f
"""

SUBSTRING_DEDUP = f"""
with w as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} as ws from documents),
wins as (
  select doc_id, unnest(list_transform(range(1, len(ws) - 18), lambda i: array_to_string(ws[i:i + 19], ' '))) as win, unnest(range(1, len(ws) - 18)) as pos
  from w where len(ws) >= 20),
later as (select doc_id, pos from (select doc_id, pos, row_number() over (partition by win order by doc_id, pos) as k from wins) where k > 1),
gone as (select distinct doc_id, unnest(range(pos, pos + 20)) as pos from later),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as pos from w),
kept as (
  select words.doc_id, count(*) filter (where gone.pos is not null) as n_removed, string_agg(word, ' ' order by words.pos) filter (where gone.pos is null) as kept
  from words left join gone on gone.doc_id = words.doc_id and gone.pos = words.pos group by words.doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join kept on kept.doc_id = w.doc_id
"""

ORACLES = {"op1_line_dedup": line_dedup.ORACLE_SQL, "op5_near_dedup": NEAR_DEDUP, "op8_quality": QUALITY, "op10_substring_dedup": SUBSTRING_DEDUP}
