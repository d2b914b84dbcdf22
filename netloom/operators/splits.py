"""Temporal, purged splits as a ``split`` column and a ``fit_row`` flag on the windows table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.config import EngineConfig
from netloom.functions.scalars import stable_uniform


def _cuts(cfg: EngineConfig) -> tuple[Column, Column]:
    length = F.col("pos_in_session") + F.col("remaining") + 1
    train, cal, _ = cfg.split_fractions
    train_end = (length * F.lit(train)).cast("bigint")
    return train_end, train_end + (length * F.lit(cal)).cast("bigint")


def temporal_split(win: DataFrame, cfg: EngineConfig, horizon: int) -> DataFrame:
    """Cut every session in time; drop anchors whose horizon reaches the next span.

    The session length follows from position and remaining windows, so no shuffle is needed.
    """
    pos = F.col("pos_in_session")
    train_end, cal_end = _cuts(cfg)
    split = (
        F.when(pos < cfg.warmup_windows, None)
        .when(pos + horizon < train_end, "train")
        .when((pos >= train_end) & (pos + horizon < cal_end), "calibration")
        .when(pos >= cal_end, "test")
    )
    return win.withColumns({"split": split, "fit_row": pos < train_end})


def span_of_window(win: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Unpurged span of each window (``campaign_split``), for snippet and background extraction."""
    pos = F.col("pos_in_session")
    train_end, cal_end = _cuts(cfg)
    return win.withColumn("campaign_split", F.when(pos < train_end, "train")
                          .when(pos < cal_end, "calibration").otherwise("test"))


def leave_family_out(win: DataFrame, cfg: EngineConfig, horizon: int, family: str) -> DataFrame:
    """Hold one family out: anchors whose context or horizon touches it leave train and calibration
    and join the test."""
    pos = F.col("pos_in_session")
    hit = F.coalesce(F.col("family_now") == family, F.lit(False))
    order = W.partitionBy("session_key").orderBy("pos_in_session")
    back = W.partitionBy("session_key").orderBy(F.desc("pos_in_session"))
    at = F.when(hit, pos)
    marked = win.withColumns({
        "_last": F.last(at, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)),
        "_next": F.last(at, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0)),
    })
    touches = (F.coalesce(pos - F.col("_last") <= cfg.context - 1, F.lit(False))
               | F.coalesce(F.col("_next") - pos <= horizon, F.lit(False)))
    base = temporal_split(marked, cfg, horizon)
    return base.withColumns({
        "split": F.when(touches, F.when(pos >= cfg.warmup_windows, "test")).otherwise(F.col("split")),
        "fit_row": F.col("fit_row") & ~hit,
    }).drop("_last", "_next")


def cross_dataset(win: DataFrame, cfg: EngineConfig, horizon: int, sources: Sequence[str],
                  target: str) -> DataFrame:
    base = temporal_split(win, cfg, horizon)
    from_source = F.col("dataset").isin(*sources)
    scored = (F.col("dataset") == target) & (F.col("pos_in_session") >= cfg.warmup_windows)
    learn = from_source & F.col("split").isin("train", "calibration")
    return base.withColumns({
        "split": F.when(scored, "test").when(learn, F.col("split")),
        "fit_row": F.col("fit_row") & from_source,
    })


def development_split(split: DataFrame, horizon: int, tail: float = 0.2) -> DataFrame:
    """Iterate without the test span: train's tail becomes calibration, calibration becomes test."""
    pos = F.col("pos_in_session")
    session = W.partitionBy("session_key")
    at = F.when(F.col("split") == "train", pos)
    low, high = F.min(at).over(session), F.max(at).over(session)
    cut = F.col("_high") - ((F.col("_high") - F.col("_low")) * F.lit(float(tail))).cast("bigint")
    return split.withColumns({"_low": low, "_high": high}).withColumn(
        "split",
        F.when((F.col("split") == "train") & (pos + horizon < cut), "train")
        .when((F.col("split") == "train") & (pos >= cut), "calibration")
        .when(F.col("split") == "calibration", "test"),
    ).drop("_low", "_high")


def purge_violations(split: DataFrame, horizon: int) -> DataFrame:
    """Sessions in which an earlier span's last target reaches a later span (none expected)."""
    pos = F.col("pos_in_session")

    def bound(fn, *names: str) -> Column:
        return fn(F.when(F.col("split").isin(*names), pos))

    spans = split.groupBy("session_key").agg(
        bound(F.max, "train").alias("train_last"),
        bound(F.min, "calibration", "test").alias("later_first"),
        bound(F.max, "calibration").alias("cal_last"),
        bound(F.min, "test").alias("test_first"),
    )
    return spans.filter((F.col("train_last") + horizon >= F.col("later_first"))
                        | (F.col("cal_last") + horizon >= F.col("test_first")))


def split_sizes(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_if("fit_row").alias("fit_rows"))


def thin_benign(split: DataFrame, cfg: EngineConfig, horizon: int, seed: int = 0) -> DataFrame:
    """Keep a fraction of purely benign training anchors of the configured datasets."""
    u = stable_uniform([F.col("session_key"), F.col("pos_in_session")], seed)
    benign = (F.col("split") == "train") & ~F.col(f"y_{horizon}") & (F.col("stage_now") == 0)
    drop = F.lit(False)
    for dataset, keep in cfg.benign_keep:
        drop = drop | (benign & (F.col("dataset") == dataset) & (u > keep))
    return split.withColumn("split", F.when(drop, None).otherwise(F.col("split")))


def add_campaigns(split: DataFrame, campaigns: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Training campaigns join the training anchors; test campaigns are scored as ``p4`` only."""
    ready = F.col("pos_in_session") >= cfg.warmup_windows
    extra = campaigns.withColumns({
        "synthetic": F.lit(True), "fit_row": F.lit(False),
        "split": F.when(ready & (F.col("campaign_split") == "train"), "train")
        .when(ready & (F.col("campaign_split") == "test"), "p4"),
    })
    return split.withColumn("synthetic", F.lit(False)).unionByName(extra, allowMissingColumns=True)
