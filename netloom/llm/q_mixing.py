"""op10: every document of the table, with the words that the mix takes of it."""

from pyspark.sql import functions as F

from netloom.llm.common import read
from netloom.llm.mixing import decisions
from netloom.llm.registry import query

SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    md5(coalesce(cast(doc_id as varchar), '') || '/mix-1') as draw
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, 3 * source_size as cap,
  [5, 2, 1][cast((row_number() over (order by source asc nulls last) - 1) % 3 as int) + 1]::double as weight from s),
lv as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source asc nulls last
    rows between unbounded preceding and 1 preceding), 0))::double
  / sum(weight) over (order by cap / weight, source asc nulls last rows between current row and unbounded following)
  as level from w),
l as (select coalesce(max(level) filter (level * weight <= cap), 0) as level from lv),
t as (select w.source, source_size, least(cap::double, level * weight) as target from w, l),
g as (select *, cast(case when source_size > 0 then floor(target / source_size) else 0 end as int) as epochs from t),
r as (select d.*, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size as goal
  from d join g on d.source is not distinct from g.source),
k as (select source, draw, sum(size) as size, any_value(goal) as goal from r group by source, draw),
m as (select source, draw, goal, sum(size) over (partition by source order by draw) - size / 2 as middle from k),
b as (select source, coalesce(max(draw) filter (middle < goal and goal > 0), '') as border from m group by source)
select r.doc_id, r.size, r.source_size, r.target,
  cast(r.size * (r.epochs + case when r.draw <= b.border then 1 else 0 end) as bigint) as taken
from r join b on r.source is not distinct from b.source
"""


@query("op10_mix_sources", SQL)
def op10_mix_sources(spark, sf_dir):
    return decisions(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))
