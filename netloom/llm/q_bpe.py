"""op1: every document encoded and decoded again."""

from pyspark.sql import functions as F

from netloom.llm.bpe import ids_digest, round_trip
from netloom.llm.common import read
from netloom.llm.registry import query


@query("op1_byte_bpe")
def op1_byte_bpe(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = round_trip(docs).select("doc_id", "ids", "decoded")
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
