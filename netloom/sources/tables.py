"""Stored tables: flows, windows, campaigns, parameters, scores and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom import vocab


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str] = ("dataset", "capture")) -> None:
    """One folder per dataset and capture, zstd parquet. Rows stay in the partitions they are in,
    so a capture with a third of all rows is written by many tasks."""
    df.write.mode("overwrite").partitionBy(*keys).option("compression", "zstd").parquet(path)


def load_windows(spark: SparkSession, path: str, datasets: Sequence[str] | None = None) -> DataFrame:
    """All windows; the dataset filter prunes folders. Columns added later are NULL in old files."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df if datasets is None else df.filter(F.col("dataset").isin(*datasets))


def load_campaigns(spark: SparkSession, path: str, datasets: Sequence[str], split: str) -> DataFrame:
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df.filter(F.col("dataset").isin(*datasets) & (F.col("campaign_split") == split))


def raw_files(df: DataFrame, capture: str = "capture") -> DataFrame:
    """File name, size and time behind each capture of a file-based DataFrame."""
    meta = F.col("_metadata")
    return df.select(capture, meta["file_name"].alias("raw_file"), meta["file_size"].alias("raw_bytes"),
                     meta["file_modification_time"].alias("raw_time")).distinct()


def write_timeline(timeline: DataFrame, path: str) -> None:
    timeline.write.mode("overwrite").json(path)


def save_parameters(df: DataFrame, path: str) -> None:
    """Fitted scaler, bins, thresholds or tables: a handful of rows, one file."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def load_parameters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_scores(scored: DataFrame, model: str, seed: int, path: str, score: str = "score") -> None:
    """Append one model's scores; partition folders keep (model, seed) reads pruned."""
    rows = scored.filter(F.col(score).isNotNull()).select(
        "session_key", "pos_in_session", F.col(score).alias("score"), F.lit(model).alias("model"),
        F.lit(seed).alias("seed"))
    rows.write.mode("append").partitionBy("model", "seed").parquet(path)


def join_scores(win: DataFrame, path: str, model: str, seed: int, out: str) -> DataFrame:
    """Scores of one model back on the windows (NULL where the window was not scored)."""
    scores = win.sparkSession.read.parquet(path).filter((F.col("model") == model) & (F.col("seed") == seed))
    return win.join(scores.select("session_key", "pos_in_session", F.col("score").alias(out)),
                    ["session_key", "pos_in_session"], "left")


def append_results(metrics: DataFrame, protocol: str, model: str, seed: int, path: str) -> None:
    """One-row metric table to long rows in the append-only results registry."""
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics.columns]
    rows = metrics.select(F.inline(F.array(*cells))).select(
        F.lit(protocol).alias("protocol"), F.lit(model).alias("model"), F.lit(seed).alias("seed"), "metric", "value")
    rows.write.mode("append").parquet(path)


def packet_block(states: DataFrame, origin: float, seconds: float, valid: str = "packet_level_valid") -> DataFrame:
    """Cached packet features moved to the absolute window grid; the origin must lie on it."""
    if origin % seconds:
        raise ValueError("the origin is not on the window grid")
    keys = [c for c in ("capture",) if c in states.columns]
    return states.filter(F.col(valid) > 0).select(
        *keys, (F.col("window") + int(origin // seconds)).alias("window"),
        *[n for n in vocab.PACKET_FEATURES if n in states.columns], F.lit(1.0).alias("m_packet"))


def read_stix(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a knowledge bundle (one JSON document), one row each."""
    bundle = spark.read.option("multiLine", "true").schema(
        "objects array<struct<id:string,type:string,name:string,description:string,revoked:boolean,"
        "x_mitre_deprecated:boolean,relationship_type:string,source_ref:string,target_ref:string,"
        "external_references:array<struct<source_name:string,external_id:string,url:string>>>>").json(path)
    return bundle.select(F.inline("objects"))
