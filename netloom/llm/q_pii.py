"""op6: personal data in every document."""

from pyspark.sql import functions as F

from netloom.llm.common import digest, read
from netloom.llm.pii import PATTERNS, all_spans, find, joined
from netloom.llm.registry import query


@query("op6_pii")
def op6_pii(spark, sf_dir):
    seen = find(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return seen.select("doc_id", *[count(k).alias(f"n_{k}") for k in PATTERNS], digest(joined(F.col("spans"))).alias("base_sha256"),
                       joined(all_spans(F.col("spans"), F.col("terms"))).alias("spans"))
