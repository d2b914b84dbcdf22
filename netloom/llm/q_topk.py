"""op4: the five best neighbours of every fiftieth vector among all others."""

from pyspark.sql import functions as F

from netloom.llm.common import read
from netloom.llm.registry import query
from netloom.llm.topk import top_k, whole_vectors

SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify rank <= 5
"""


@query("op4_exact_top_k", SQL)
def op4_exact_top_k(spark, sf_dir):
    vectors = whole_vectors(read(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)
