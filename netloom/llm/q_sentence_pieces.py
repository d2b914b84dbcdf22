"""op13: every document encoded into pieces and decoded again."""

from pyspark.sql import functions as F

from netloom.llm.bpe import ids_digest
from netloom.llm.common import digest, read
from netloom.llm.registry import query
from netloom.llm.sentence_pieces import round_trip


@query("op13_sentence_pieces")
def op13_sentence_pieces(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = round_trip(docs).select("doc_id", "ids", "decoded")
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"),
                       digest(F.col("decoded")).alias("decoded_sha256"))
