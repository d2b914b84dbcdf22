"""Streaming windows: tumbling states, two-level features, sessions and duplicate suppression.

State is bounded by the watermark everywhere: a window's groups leave once it closes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.config import EngineConfig
from netloom.functions.scalars import share, stage_index


def with_event_time(flows: DataFrame, delay: str) -> DataFrame:
    """Event time from the epoch column, and the watermark for late flows."""
    return flows.withColumn("event_time", F.timestamp_micros(F.round(F.col("ts") * 1e6).cast("bigint"))) \
        .withWatermark("event_time", delay)


def drop_duplicates(flows: DataFrame, delay: str) -> DataFrame:
    """Suppress re-delivered flows; ids are forgotten once the watermark passes them."""
    return with_event_time(flows, delay).dropDuplicatesWithinWatermark(["capture", "flow_id"])


def _slot(cfg: EngineConfig) -> Column:
    return F.window("event_time", f"{int(cfg.window_seconds)} seconds")


def _index(cfg: EngineConfig, slot: str = "slot") -> Column:
    return F.floor(F.unix_timestamp(F.col(f"{slot}.start")) / int(cfg.window_seconds)).cast("bigint")


def tumbling_states(flows: DataFrame, cfg: EngineConfig, delay: str = "0 seconds") -> DataFrame:
    """Window-level features and labels of a flow stream (append once the window closes)."""
    timed = flows if "event_time" in flows.columns else with_event_time(flows, delay)
    attack = F.col("is_attack")
    states = timed.groupBy("capture", _slot(cfg).alias("slot")).agg(
        F.count(F.lit(1)).alias("n_flows"),
        F.sum(F.col("fwd_bytes") + F.col("bwd_bytes")).alias("bytes_total"),
        F.avg("duration").alias("duration_mean"),
        share((F.col("syn_count") > 0) & (F.col("ack_count") <= 0)).alias("unanswered_syn_frac"),
        F.count_if(attack).alias("n_attack_flows"),
        F.coalesce(F.max(F.when(attack, stage_index(F.col("stage")))), F.lit(0)).alias("stage_now"))
    return states.withColumn("window", _index(cfg)).drop("slot")


def host_maxima(flows: DataFrame, cfg: EngineConfig, delay: str = "0 seconds") -> DataFrame:
    """Two chained aggregations in one stream: per source, then the window's busiest source."""
    per_source = with_event_time(flows, delay).groupBy("capture", _slot(cfg).alias("slot"), "src_ip").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("syn_count") > 0) & (F.col("ack_count") <= 0)).alias("half_open"))
    again = per_source.withColumn("closed_at", F.window_time("slot")).drop("slot")
    per_window = again.groupBy("capture", F.window("closed_at", f"{int(cfg.window_seconds)} seconds").alias("slot")).agg(
        F.max("n").alias("flows_per_host_max"), F.max("half_open").alias("half_open_max"),
        F.count(F.lit(1)).alias("unique_src_hosts"))
    return per_window.withColumn("window", _index(cfg)).drop("slot")


def sessions(flows: DataFrame, cfg: EngineConfig, delay: str = "0 seconds") -> DataFrame:
    """Sessions split where windows are more than the gap apart, with the batch rule exactly.

    Window starts merge while they are at most the gap apart; ``session_window`` also merges at
    equality, so feeding it window starts reproduces the batch spine.
    """
    seconds = int(cfg.window_seconds)
    start = F.timestamp_seconds(F.floor(F.col("ts") / seconds) * seconds)
    timed = flows.withColumn("window_start", start).withWatermark("window_start", delay)
    grouped = timed.groupBy("capture", F.session_window("window_start", f"{cfg.gap_windows * seconds} seconds").alias("s")).agg(
        F.count(F.lit(1)).alias("n_flows"), F.min("window_start").alias("first"), F.max("window_start").alias("last"))
    return grouped.select("capture", "n_flows", F.floor(F.unix_timestamp("first") / seconds).cast("bigint").alias("first_window"),
                          F.floor(F.unix_timestamp("last") / seconds).cast("bigint").alias("last_window"))
