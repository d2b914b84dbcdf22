"""op8: secrets in every document."""

from pyspark.sql import functions as F

from netloom.llm.common import digest, read
from netloom.llm.registry import query
from netloom.llm.secrets import joined, scan_secrets


@query("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    found = scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    s = F.col("secrets")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        digest(joined(F.filter(s, lambda x: x["kind"] != "random"))).alias("base_sha256"),
                        joined(s).alias("spans"))
