"""op12: every embedding on the four strongest components, at unit variance."""

from pyspark.sql import functions as F

from netloom.llm.common import read
from netloom.llm.registry import query
from netloom.llm.whitening import fit, identity_error, whiten


@query("op12_whitening")
def op12_whitening(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fitted = fit(vectors)
    explained = F.array(*[F.lit(float(v)) for v in fitted.explained]).cast("array<double>")
    rows = whiten(vectors, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.count).cast("bigint").alias("n"),
        F.col("deviation").try_cast("bigint").alias("deviation"), "whitened", F.get(explained, F.col("at")).alias("explained"),
        F.lit(identity_error(fitted)).cast("double").alias("identity_error"))
