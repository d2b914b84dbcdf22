"""Capture summaries, label audit, episode tables and seed-aggregated results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom import vocab


def capture_summary(win: DataFrame) -> DataFrame:
    c = F.col
    return win.groupBy("capture").agg(
        F.count(F.lit(1)).alias("windows"), (F.max("session") + 1).alias("sessions"),
        F.count_if(c("stage_now") > 0).alias("attack_windows"),
        (F.max("episode") + 1).alias("episodes"), F.count_if("is_onset").alias("onsets"),
        F.count_if("is_stage_onset").alias("stage_onsets"), F.count_if("is_recurrence").alias("recurrences"),
        *([F.avg("m_packet").alias("packet_coverage")] if "m_packet" in win.columns else []),
        *[F.count_if(c("stage_now") == i).alias(f"stage_{i}") for i in range(vocab.N_STAGES)])


def label_audit(win: DataFrame, schedule: DataFrame, margin: float = 1800.0, tolerance: float = 600.0,
                skip_recon: Sequence[str] = ("Infiltration",), slot_seconds: float = 3600.0) -> DataFrame:
    """First and last labelled window of every scheduled attack, and the offset from its start.

    ``schedule(slot, capture, family, start, end)``, in epoch seconds. Slots are expanded to
    hours so that windows meet them by an equi join.
    """
    slot = F.lit(float(slot_seconds))
    low, high = F.col("start") - margin, F.col("end") + margin
    spans = schedule.withColumn("_hour", F.explode(F.sequence(F.floor(low / slot), F.floor(high / slot))))
    rows = win.filter(F.col("family_now").isNotNull()).select(
        "capture", F.col("family_now").alias("family"), "t", "stage_now", F.floor(F.col("t") / slot).alias("_hour"))
    hit = rows.join(spans, ["capture", "family", "_hour"]).filter(
        F.col("t").between(low, high) & ~(F.col("family").isin(*skip_recon) & (F.col("stage_now") == 1)))
    found = hit.groupBy("slot").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    offset = F.col("first_t") - F.col("start")
    return schedule.join(found, "slot", "left").select(
        "slot", "capture", "family", "first_t", "last_t", (offset / 60.0).alias("offset_min"),
        F.coalesce(F.abs(offset) <= tolerance, F.lit(False)).alias("passed"))


def episode_table(win: DataFrame) -> DataFrame:
    attack = F.col("stage_now") > 0
    return win.filter(F.col("episode") >= 0).groupBy("capture", "episode").agg(
        F.min("t").alias("start_t"), F.max("t").alias("end_t"),
        F.array_sort(F.collect_set(F.when(attack, F.col("stage_now").cast("int")))).alias("stages"),
        F.array_sort(F.collect_set("family_now")).alias("families"),
        F.bool_or("is_onset").alias("onset"), F.count_if(attack).alias("attack_windows"))


def seed_table(results: DataFrame, by: Sequence[str] = ("protocol", "model", "metric")) -> DataFrame:
    """Mean and population spread over seeds; NaN results do not count."""
    value = F.when(~F.isnan("value"), F.col("value"))
    return results.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                                    F.count(value).alias("seeds"))


def build_manifest(win: DataFrame, raw: DataFrame) -> DataFrame:
    """Capture summary with the size and time of its raw files.

    ``raw(capture, raw_file, raw_bytes, raw_time)``, see ``sources.tables.raw_files``.
    """
    files = raw.groupBy("capture").agg(F.count(F.lit(1)).alias("raw_files"), F.sum("raw_bytes").alias("raw_bytes"),
                                       F.max("raw_time").alias("raw_time"))
    return capture_summary(win).join(files, "capture", "left")
