"""op3: quality rules over every document."""

from netloom.llm.common import read
from netloom.llm.quality import LEAN, MAX_REPEAT_PERCENT, MIN_WORDS, RATIOS, REACH, judge
from netloom.llm.registry import query

CELL = "cast(floor(v / 2.0 ** greatest(len(bin(v)) - 7, 0)) * 2.0 ** greatest(len(bin(v)) - 7, 0) as bigint)"
VALUES = ", ".join(f"case when {b} > 0 then {s} * {a} // {b} else 0 end as {k}" for k, (a, b, s, _, _) in RATIOS.items())
SLACK = " ".join(f"when '{k}' then {v[3]}" for k, v in RATIOS.items())
INSIDE = " and ".join(
    f"{k} <= (select high from f where f.lang is not distinct from m.lang and f.source is not distinct from m.source and f.ratio = '{k}')"
    + (f" and {k} >= (select low from f where f.lang is not distinct from m.lang and f.source is not distinct from m.source and f.ratio = '{k}')"
       if v[4] else "") for k, v in RATIOS.items())


def _quantiles(keys: str, frm: str) -> str:
    """Quantiles of the cells per ``keys`` and ratio."""
    at = lambda q: f"min(cell) filter (upto * 10 >= total * {q})"
    return f"""select {keys}, ratio, max(total) as total, {at(1)} as q10, {at(5)} as q50, {at(9)} as q90 from (
      select *, sum(n) over (partition by {keys}, ratio order by cell) as upto,
        sum(n) over (partition by {keys}, ratio) as total
      from (select {keys}, ratio, cell, sum(n) as n from {frm} group by all)) group by {keys}, ratio"""


MEAN = {q: f"((o.total * o.{q} + {LEAN} * p.{q}) / (o.total + {LEAN}))" for q in ("q10", "q50", "q90")}
SQL = rf"""
with w as materialized (select *, row_number() over () as rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
g as (select rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] as g from (
    select rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) as i from w)),
h as (select rid, i, count(*) over (partition by rid, g) as n from g),
c as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from h where n > 1) group by rid),
b as (select doc_id, lang, source, len(ws) as n_words, len(array_to_string(ws, '')) as word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
    coalesce(c.n, 0) as n_repeat_words, len(ls) as n_lines
  from w left join c using (rid)),
m as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed, {VALUES} from b),
v as (unpivot (select * from m where not base_failed) on {", ".join(RATIOS)} into name ratio value v),
s as (select lang, source, ratio, {CELL} as cell, count(*) as n from v group by all),
o as ({_quantiles("lang, source", "s")}),
p as ({_quantiles("lang", "s")}),
f as (select o.lang, o.source, o.ratio,
    {MEAN['q90']} + {REACH} * ({MEAN['q90']} - {MEAN['q50']}) + case o.ratio {SLACK} end as high,
    {MEAN['q10']} - {REACH} * ({MEAN['q50']} - {MEAN['q10']}) - case o.ratio {SLACK} end as low
  from o join p on o.lang is not distinct from p.lang and o.ratio = p.ratio)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
  cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and coalesce({INSIDE}, false) as kept
from m
"""


@query("op3_quality_rules", SQL)
def op3_quality_rules(spark, sf_dir):
    return judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
