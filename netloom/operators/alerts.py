"""Hysteresis, two-level alerts and the alert log. All linear: each row looks at the last quiet row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.config import EngineConfig
from netloom.functions.scalars import window_time

KEY, POS = "session_key", "pos_in_session"


def _order():
    return W.partitionBy(KEY).orderBy(POS)


def run_length(alert: Column) -> Column:
    """Consecutive alert windows ending at each row (0 where there is no alert).

    Positions must be contiguous from 0, as on the window spine.
    """
    through = _order().rowsBetween(W.unboundedPreceding, 0)
    last_quiet = F.last(F.when(~alert, F.col(POS)), ignorenulls=True).over(through)
    return F.col(POS) - F.coalesce(last_quiet, F.lit(-1))


def sustained(df: DataFrame, alert: Column, k: int, out: str) -> DataFrame:
    """True where the alert has held for ``k`` consecutive windows of the session."""
    flag = F.coalesce(alert, F.lit(False))
    return df.withColumn("_flag", flag).withColumn(out, run_length(F.col("_flag")) >= k).drop("_flag")


def sustained_score(df: DataFrame, score: str, k: int, out: str) -> DataFrame:
    """Lowest score of the last ``k`` windows: ``out >= c`` is the sustained alert for any c.

    Missing scores, and the first k-1 windows of a session, can never alert (NULL).
    """
    frame = _order().rowsBetween(-(k - 1), 0)
    complete = F.count(score).over(frame) == k
    return df.withColumn(out, F.when(complete, F.min(score).over(frame)))


def two_level(df: DataFrame, risk: str, early: str, threshold: Column | float, early_threshold: Column | float,
              k: int) -> DataFrame:
    """Level 2: sustained risk. Level 1: sustained early-warning score while level 2 is off."""
    hot = sustained(df, F.col(risk) >= threshold, k, "_two")
    warm = sustained(hot, F.col(early) >= early_threshold, k, "_one")
    return warm.withColumn("level", F.when(F.col("_two"), 2).when(F.col("_one"), 1).otherwise(0)).withColumn(
        "alert", F.col("_two")).drop("_two", "_one")


def true_runs(df: DataFrame, value: str) -> DataFrame:
    """Number the contiguous stretches of equal ``value`` in each session (``island``)."""
    order = _order()
    change = F.coalesce(F.lag(value).over(order) != F.col(value), F.lit(True))
    return df.withColumn("_change", change.cast("int")).withColumn(
        "island", F.sum("_change").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_change")


def alert_log(levelled: DataFrame, cfg: EngineConfig, risk: str = "risk") -> DataFrame:
    """One row per alert run: level, first and last window time, length and peak risk."""
    runs = true_runs(levelled, "level").filter(F.col("level") > 0)
    return runs.groupBy(KEY, "island", "level").agg(
        F.min("t").alias("from_t"), F.max("t").alias("to_t"),
        (F.count(F.lit(1)) * F.lit(cfg.window_seconds / 60.0)).alias("minutes"),
        F.max(risk).alias("peak"),
    ).drop("island")


def timeline(levelled: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Result rows of one analysis, with a timestamp beside the epoch seconds."""
    return levelled.withColumn("time", F.timestamp_seconds(window_time(F.col("window"), cfg.window_seconds)))


def summary(levelled: DataFrame, risk: str = "risk") -> DataFrame:
    """One row per capture: counts, first warning, first alert, highest risk."""
    c = F.col
    return levelled.groupBy("capture").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("n_flows").alias("flows"),
        F.count(risk).alias("scored_windows"), F.count_if("alert").alias("alert_windows"),
        F.count_if(c("level") == 1).alias("early_warning_windows"),
        F.min(F.when(c("level") == 1, c("t"))).alias("first_early_warning"),
        F.min(F.when(c("alert"), c("t"))).alias("first_alert"),
        F.max(risk).alias("max_risk"),
        F.when(F.sum("n_attack_flows") > 0, F.count_if(c("stage_now") > 0)).alias("labelled_attack_windows"),
    )
