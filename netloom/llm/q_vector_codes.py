"""op11: every embedding as four bytes, one entry of a codebook per part."""

import hashlib

from pyspark.sql import functions as F

from netloom.llm.common import join_small, materialise, read, same
from netloom.llm.registry import query
from netloom.llm.vector_codes import ENTRIES, PARTS, ROUNDS, compress


def _assign(t: int) -> str:
    """Nearest entry of codebook c{t} for every part: least (distance, entry) as one number."""
    return f"""a{t} as materialized (select rid, p, min(cast(list_sum(list_transform(list_zip(v.x, c.x),
    lambda q: (q[1] - q[2]) * (q[1] - q[2]))) as bigint) * {ENTRIES} + e) as best from v join c{t} c using (p) group by rid, p)"""


def _update(t: int) -> str:
    """Codebook c{t + 1}: componentwise floor of the means; unused entries stay."""
    return f"""c{t + 1} as materialized (with s as (select p, best % {ENTRIES} as e, i, sum(v.x[i]) as s, count(*) as n
      from a{t} join v using (rid, p), unnest(range(1, len(v.x) + 1)) as u(i) group by all),
    m as (select p, e, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as x from s group by p, e)
  select c.p, c.e, coalesce(m.x, c.x) as x from c{t} c left join m using (p, e))"""


SQL = f"""
with r as materialized (select row_number() over (order by vec_id nulls last, embedding) as rid, vec_id, label,
    list_transform(embedding, lambda x: cast(floor(1024 * x::double) as bigint)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (select rid, p, x[len(x) * p // {PARTS} + 1 : len(x) * (p + 1) // {PARTS}] as x from r, unnest(range({PARTS})) as u(p)),
c0 as materialized (select p, rid - 1 as e, x from v where rid <= {ENTRIES}),
{", ".join(_assign(t) + ", " + _update(t) for t in range(ROUNDS))}, {_assign(ROUNDS)},
k as (select rid, string_agg(format('{{:02x}}', best % {ENTRIES}), '' order by p) as code, cast(sum(best // {ENTRIES}) as bigint) as error
  from a{ROUNDS} group by rid),
h as (select sha256(coalesce(string_agg(array_to_string(x, ','), ',' order by p, e), '')) as h from c{ROUNDS})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256
from r join k using (rid), h
"""


@query("op11_vector_codes", SQL)
def op11_vector_codes(spark, sf_dir):
    done = compress(read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    rows = done.rows.withColumn("group", same(F.col("label")))
    totals = materialise(rows.groupBy("group").agg(F.sum("error").alias("label_error")), "codes-labels")
    written = ",".join(str(c) for book in done.codebooks for c in book.ravel().tolist())
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("bigint")), 2, "0"))), "")
    return join_small(rows, totals, "group").select(
        "vec_id", code.alias("code"), "error", "label_error",
        F.lit(hashlib.sha256(written.encode()).hexdigest()).alias("codebooks_sha256"))
