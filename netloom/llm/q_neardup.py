"""op9: near-duplicate components of all documents, on 2-word shingles."""

from netloom.llm.common import read
from netloom.llm.neardup import components
from netloom.llm.registry import query

SQL = r"""
with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as materialized (select distinct doc_id, unnest(case when len(ws) = 1 then ws
    else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as g from w),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b using (g) where a.doc_id < b.doc_id group by all),
e as materialized (select u, v from i join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 80 * (x.n + y.n - c)),
t as (select u, v from e union select v, u from e),
r(doc_id, root) as (select doc_id, doc_id from documents union select t.v, r.root from r join t on t.u = r.doc_id where r.root < t.v)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.root) as component_id, d.doc_id = min(r.root) as kept
from documents d join r using (doc_id) left join n using (doc_id) group by d.doc_id, n.n
"""


@query("op9_near_duplicates", SQL)
def op9_near_duplicates(spark, sf_dir):
    return components(read(spark, sf_dir, "documents"), size=2, percent=80)
