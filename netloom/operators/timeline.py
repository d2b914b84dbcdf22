"""The contiguous window spine, episodes, onsets and forecast targets.

These run on the narrow label table (one short row per window), not on flows or features. Its
size per capture is set by recorded time, not by traffic: 3.2 million rows per year at 10 s.
Frames look back to the last event instead of over long ranges, so every window is linear.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.config import EngineConfig
from netloom.functions.scalars import is_compromise, window_time

SERIES = ("capture",)


def session_spine(occupied: DataFrame, gap_windows: int, series: Sequence[str] = SERIES) -> DataFrame:
    """Number the sessions and add the idle windows inside them.

    Every occupied window brings along the idle ones up to its successor, so no join against a
    calendar is needed. Columns other than the keys are NULL on idle windows.
    """
    order = W.partitionBy(*series).orderBy("window")
    c = F.col
    edges = occupied.withColumns({
        "_prev": F.lag("window").over(order),
        "_next": F.lead("window").over(order),
    })
    numbered = edges.withColumns({
        "session": F.sum(F.when(c("window") - c("_prev") > gap_windows, 1).otherwise(0)).over(
            order.rowsBetween(W.unboundedPreceding, 0)).cast("int"),
        "_last": F.when(c("_next") - c("window") <= gap_windows, c("_next") - 1).otherwise(c("window")),
    })
    payload = [x for x in occupied.columns if x not in (*series, "window")]
    filled = numbered.withColumn("_at", F.explode(F.sequence("window", "_last")))
    own = c("_at") == c("window")
    return filled.select(*series, "session", c("_at").alias("window"),
                         *[F.when(own, c(x)).alias(x) for x in payload])


def label_spine(labels: DataFrame, cfg: EngineConfig, series: Sequence[str] = SERIES) -> DataFrame:
    """Spine with labels filled in: idle windows are quiet states, not missing ones."""
    c = F.col
    spine = session_spine(labels, cfg.gap_windows, series)
    whole = W.partitionBy(*series, "session")
    return spine.select(
        *series, "session", "window",
        F.concat_ws("#", *[c(s) for s in series], c("session").cast("string")).alias("session_key"),
        window_time(c("window"), cfg.window_seconds).alias("t"),
        (c("window") - F.min("window").over(whole)).alias("pos_in_session"),
        (F.max("window").over(whole) - c("window")).alias("remaining"),
        F.coalesce("n_flows", F.lit(0)).alias("n_flows"),
        F.coalesce("n_attack_flows", F.lit(0)).alias("n_attack_flows"),
        F.coalesce("stage_now", F.lit(0).cast("tinyint")).alias("stage_now"),
        "family_now",
        F.coalesce("attempted_only", F.lit(False)).alias("attempted_only"),
    ).withColumns({
        "warmup": c("pos_in_session") < cfg.warmup_windows,
        "m_lookback": (c("pos_in_session") >= cfg.context).cast("double"),
    })


def _in_session(series: Sequence[str]) -> W:
    return W.partitionBy(*series, "session").orderBy("pos_in_session")


def _last_before(x: Column, w) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))


def _first_after(x: Column, series: Sequence[str]) -> Column:
    back = W.partitionBy(*series, "session").orderBy(F.desc("pos_in_session"))
    return F.last(x, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1))


def episodes(win: DataFrame, cfg: EngineConfig, series: Sequence[str] = SERIES) -> DataFrame:
    """Attack runs merged over short gaps, their onsets and the flips inside them."""
    c = F.col
    order = _in_session(series)
    pos, attack = c("pos_in_session"), c("stage_now") > 0
    marks = win.withColumns({
        "_prev": _last_before(F.when(attack, pos), order),
        "_next": _first_after(F.when(attack, pos), series),
        "_was": F.lag(attack).over(order),
    })
    starts = attack & (c("_prev").isNull() | (pos - c("_prev") - 1 > cfg.episode_merge_gap))
    quiet_before = F.when(c("_prev").isNull(), pos).otherwise(pos - c("_prev") - 1)
    bridged = c("_next") - c("_prev") - 1 <= cfg.episode_merge_gap
    marks = marks.withColumns({
        "_start": starts,
        "in_episode": attack | F.coalesce(bridged, F.lit(False)),
        "is_onset": starts & (quiet_before >= cfg.onset_quiet),
        "is_recurrence": attack & ~F.coalesce(c("_was"), F.lit(True)) & ~starts,
    })
    through = W.partitionBy(*series).orderBy("window").rowsBetween(W.unboundedPreceding, 0)
    number = F.sum(c("_start").cast("int")).over(through) - 1
    return marks.withColumn("episode", F.when(c("in_episode"), number).otherwise(-1).cast("int")).drop(
        "_prev", "_next", "_was", "_start")


def stage_onsets(win: DataFrame, quiet: int, series: Sequence[str] = SERIES) -> DataFrame:
    """First window of an attack stage that was absent for more than ``quiet`` positions."""
    pos = F.col("pos_in_session")
    seen = F.lag(pos).over(W.partitionBy(*series, "session", "stage_now").orderBy(pos))
    return win.withColumn("_seen", seen).withColumn(
        "is_stage_onset",
        (F.col("stage_now") > 0) & (F.col("_seen").isNull() | (pos - F.col("_seen") > quiet))).drop("_seen")


def forecast_targets(win: DataFrame, horizons: Sequence[int], series: Sequence[str] = SERIES) -> DataFrame:
    """Compromise within k windows after t, distance to it, and the next attack stage.

    Horizons that run past the session end are invalid, not negative.
    """
    c = F.col
    pos, stage = c("pos_in_session"), c("stage_now")
    out = win.withColumns({
        "_hit": _first_after(F.when(is_compromise(stage), pos), series),
        "_stage": _first_after(F.when(stage > 0, stage), series),
    }).withColumns({
        "time_to_compromise": F.coalesce(c("_hit") - pos, F.lit(-1)),
        "next_attack_stage": F.coalesce(c("_stage"), F.lit(0)).cast("bigint"),
    })
    for k in horizons:
        out = out.withColumns({
            f"valid_{k}": c("remaining") >= k,
            f"y_{k}": (c("remaining") >= k) & c("time_to_compromise").between(1, k),
        })
    return out.drop("_hit", "_stage")


def any_attack_targets(win: DataFrame, k: int, series: Sequence[str] = SERIES) -> DataFrame:
    """Any attack stage, reconnaissance included, within (t, t+k]."""
    pos = F.col("pos_in_session")
    ahead = _first_after(F.when(F.col("stage_now") > 0, pos), series) - pos
    return win.withColumn("_ahead", ahead).withColumns({
        f"any_valid_{k}": F.col("remaining") >= k,
        f"any_{k}": (F.col("remaining") >= k) & F.coalesce(F.col("_ahead") <= k, F.lit(False)),
    }).drop("_ahead")


TARGET_COLUMNS = ("episode", "in_episode", "is_onset", "is_recurrence", "is_stage_onset",
                  "time_to_compromise", "next_attack_stage")


def add_targets(win: DataFrame, cfg: EngineConfig, series: Sequence[str] = SERIES) -> DataFrame:
    """Episodes and targets from ``stage_now`` alone; re-runnable on a stored windows table."""
    stale = [x for x in win.columns if x in TARGET_COLUMNS or x.startswith(("y_", "valid_"))]
    out = episodes(win.drop(*stale), cfg, series)
    out = stage_onsets(out, cfg.onset_quiet, series)
    return forecast_targets(out, cfg.horizons, series)


def compromise_onsets(win: DataFrame, quiet: int, series: Sequence[str] = SERIES) -> DataFrame:
    """``is_compromise_onset`` (no compromise in the ``quiet`` windows before) and ``is_quiet``
    (none in the last ``quiet`` windows, the current one included)."""
    pos, now = F.col("pos_in_session"), is_compromise(F.col("stage_now"))
    before = _last_before(F.when(now, pos), _in_session(series))
    gap = F.coalesce(pos - F.col("_before") > quiet, F.lit(True))
    since = F.coalesce(pos - F.col("_before") >= quiet, F.lit(True))
    return win.withColumn("_before", before).withColumns({
        "is_compromise_onset": now & gap,
        "is_quiet": ~now & since,
    }).drop("_before")
