"""Flows to the windows table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom import vocab
from netloom.config import EngineConfig
from netloom.operators.features import assign_windows, clean_features, window_features
from netloom.operators.labels import refine_stages, window_labels
from netloom.operators.timeline import add_targets, label_spine

SERIES = ("capture",)


def label_windows(flows: DataFrame, cfg: EngineConfig, series: Sequence[str] = SERIES) -> DataFrame:
    """Spine, labels, episodes and targets: everything that needs no features."""
    ready = assign_windows(refine_stages(flows, cfg.internal_cidrs), cfg)
    return add_targets(label_spine(window_labels(ready, series), cfg, series), cfg, series)


def address_mask(flows: DataFrame, cfg: EngineConfig, series: Sequence[str] = SERIES) -> DataFrame:
    """``m_ip``: internal ranges are known and the capture has more than one source.

    Comparing the smallest and largest address avoids a distinct count.
    """
    several = F.max("src_ip") > F.min("src_ip")
    known = F.lit(bool(cfg.internal_cidrs))
    return flows.groupBy(*series).agg((known & F.coalesce(several, F.lit(False))).cast("double").alias("m_ip"))


def merge_packet_block(windows: DataFrame, block: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """Measured packet features overwrite the flow-derived ones wherever the block has a value."""
    names = [n for n in (*vocab.PACKET_FEATURES, "m_packet") if n in block.columns]
    measured = block.select(*series, "window", *[F.col(n).alias(f"_{n}") for n in names])
    merged = windows.join(measured, [*series, "window"], "left")
    return merged.withColumns({n: F.coalesce(f"_{n}", n) for n in names}).select(*windows.columns)


def build_windows(flows: DataFrame, cfg: EngineConfig, packet_block: DataFrame | None = None,
                  series: Sequence[str] = SERIES) -> DataFrame:
    """One row per window of every session: features, masks, labels, episodes and targets."""
    keys = [*series, "window"]
    feats = window_features(assign_windows(flows, cfg), cfg, series)
    # The narrow label table is already partitioned by the series, so the mask joins it in place;
    # joining it to the wide result would shuffle every feature by capture.
    win = label_windows(flows, cfg, series).join(address_mask(flows, cfg, series), list(series), "left")
    labels = [x for x in win.columns if x not in keys]
    joined = win.join(feats, keys, "left")
    if packet_block is not None:
        joined = merge_packet_block(joined, packet_block, series)
    return clean_features(joined, [*keys, *labels])
