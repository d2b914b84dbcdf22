"""op7: lines found in at least ten documents go from every document."""

from pyspark.sql import functions as F

from netloom.llm.common import digest, read
from netloom.llm.lines import dedup_lines
from netloom.llm.registry import query

MIN_DOCS = 10
BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
KEY = f"translate(trim(line, {BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
with d as materialized (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select rid, unnest(lines) as line, unnest(range(len(lines))) as pos from d),
k as (select *, {KEY} as key from l),
r as (select key from k where key <> '' group by key having count(distinct rid) >= {MIN_DOCS}),
o as (select k.*, r.key is not null as gone from k left join r using (key))
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from o join d using (rid) group by rid
"""


@query("op7_line_dedup", SQL)
def op7_line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = dedup_lines(docs, min_docs=MIN_DOCS, keep_first=False, counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", digest(F.col("text")).alias("kept_sha256"))
