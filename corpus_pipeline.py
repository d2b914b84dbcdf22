"""A training corpus from ``documents``: toxic texts out, boilerplate lines out, near-duplicates out, mixed, tokenised.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import bpe, lines, mixing, neardup, toxicity
from netloom.llm.common import fresh, materialise, read

LINE_DOCS = 10
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier rejects go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line found in ten documents or more only the first occurrence stays; ``n_chars`` follows the text.

    Documents of which nothing is left, since all their words are kept elsewhere, go; blank documents stay as they are.
    """
    before = fresh(docs, "words_before")
    word = r"[^\x20\x09-\x0D]"
    kept = lines.dedup_lines(docs.withColumn(before, F.coalesce(F.col("text").rlike(word), F.lit(False))), min_docs=LINE_DOCS)
    left = kept.filter(~F.col(before) | F.col("text").rlike(word)).drop(before)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return neardup.dedup(docs, NEAR_WORDS, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are repeated or left out."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and offsets of every document, and whether they decode to its text."""
    done = bpe.round_trip(docs)
    whole = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return done.withColumns({"n_tokens": F.size("ids").cast("bigint"), "decodes": whole}).drop("decoded", "text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", tokenise),
]

#: Stages 1 (a fitted classifier) and 5 (byte-pair merges) have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
