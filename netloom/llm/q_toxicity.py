"""op5: a toxicity score for every document."""

from pyspark.sql import functions as F

from netloom.llm.common import read
from netloom.llm.registry import query
from netloom.llm.toxicity import add_score, fit, fold


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = add_score(docs, fit(docs, read(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
