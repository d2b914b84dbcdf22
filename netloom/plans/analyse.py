"""Flows to an alert timeline, with fitted parameters and models applied to every window."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom import vocab
from netloom.config import EngineConfig
from netloom.functions.scalars import arg_max
from netloom.operators import alerts as al
from netloom.operators import dynamics as dy
from netloom.operators import models as md
from netloom.operators import normalise as nm
from netloom.operators import transitions as tr
from netloom.operators.calibration import apply_platt
from netloom.plans.build import build_windows
from netloom.session import materialise


@dataclass
class ForecastModel:
    """Fitted parts of a forecast. All are of fixed size or stored Spark ML models."""

    scaler: DataFrame
    bins: DataFrame | None
    detector: object
    nowcast: object
    forecast: dict[str, np.ndarray]
    onset_counts: DataFrame
    threshold: float
    early_threshold: float
    platt_detector: tuple[float, float]
    platt_rollout: tuple[float, float]


def score_windows(windows: DataFrame, model: ForecastModel, cfg: EngineConfig, warmup: bool = False) -> DataFrame:
    """Hybrid risk, early-warning score, nowcast stage, progress, next stage, the forecast of every step, and surprise if
    the model has bins (NULL otherwise).

    ``warmup`` centres each session on its own warm-up windows (where it has enough), as for networks the model has not seen.
    """
    scaled = nm.scale_wide(windows, model.scaler, centers=nm.warmup_centers(windows) if warmup else None)
    if model.bins is not None:
        scaled = materialise(scaled, "scaled")  # read twice
    inputs = nm.model_input(scaled, out="x")
    scored = md.predict(model.detector, inputs, "detector_raw")
    seen = md.nowcast(model.nowcast, scored)
    seen = tr.nowcast_progress(seen, cfg.context)
    seen = tr.rollout_risk(seen, model.forecast, (cfg.primary_horizon,))
    seen = tr.rollout_steps(seen, model.forecast, cfg.primary_horizon)
    seen = tr.horizon_stage_mass(seen, model.forecast, cfg.primary_horizon)
    seen = seen.withColumn("current", arg_max(F.col("nowcast")))
    seen = tr.next_stage(seen, model.onset_counts, cfg.next_stage_blend)
    early = F.col(f"p_within_{cfg.primary_horizon}")
    ready = F.col("pos_in_session") >= cfg.context - 1
    risk = (apply_platt(F.col("detector_raw"), *model.platt_detector) + apply_platt(early, *model.platt_rollout)) / 2
    if model.bins is not None:
        unlikely = dy.surprise(dy.binned_states(scaled, model.bins), cfg.context, cfg.session_block)
        seen = seen.join(unlikely, [al.KEY, al.POS], "left")
    else:
        seen = seen.withColumn("surprise", F.lit(None).cast("double"))
    return seen.withColumns({
        "risk": F.when(ready, risk), "early": F.when(ready, early),
        "detector_risk": F.when(ready, apply_platt(F.col("detector_raw"), *model.platt_detector)),
    })


def analyse(flows: DataFrame, model: ForecastModel, cfg: EngineConfig, warmup: bool = False) -> DataFrame:
    """The alert timeline of every capture in ``flows``, with the forecast of every step (NULL before a whole context)."""
    windows = materialise(build_windows(flows, cfg), "windows")
    scored = score_windows(windows, model, cfg, warmup)
    levels = al.two_level(scored, "risk", "early", model.threshold, model.early_threshold, cfg.hysteresis)
    ready = F.col(al.POS) >= cfg.context - 1
    levels = levels.withColumns({c: F.when(ready, F.col(c)) for c in ("risk_steps", "stage_steps", "next_probs", "nowcast")})
    return al.timeline(levels, cfg).select(
        "capture", "session_key", "window", "t", "time", "pos_in_session", "n_flows", "n_attack_flows", "stage_now",
        "family_now", "warmup", "risk", "alert", "level", "early", "detector_risk",
        F.col("current").alias("nowcast_stage"), "progress", "heading_to", "heading_to_p",
        "surprise", "nowcast", "risk_steps", "stage_steps", "next_probs")


def fit(windows: DataFrame, cfg: EngineConfig, names: tuple[str, ...] = vocab.FEATURE_NAMES,
        threshold_budget: float | None = None, surprise: bool = False) -> ForecastModel:
    """Fit every part of the forecast on a stored, split windows table; ``surprise`` adds the bins that it needs."""
    from netloom.operators.calibration import conformal_thresholds, early_warning_threshold, fit_platt
    from netloom.operators.timeline import compromise_onsets

    k = cfg.primary_horizon
    y, valid = f"y_{k}", f"valid_{k}"
    scaler = materialise(nm.fit_scaler(nm.fit_rows(windows), names), "scaler")
    scaled, bins = nm.scale_wide(windows, scaler, names), None
    if surprise:
        scaled = materialise(scaled, "scaled")
        bins = materialise(nm.fit_bins(nm.unpivot(nm.fit_rows(scaled), names, [], compressed=False)), "bins")
    inputs = materialise(nm.model_input(scaled, names, "x"), "inputs")
    train = inputs.filter((F.col("split") == "train") & F.col(valid))
    detector = md.fit_logistic(train, y)
    now = md.fit_nowcast(inputs.filter("split = 'train'"))
    table = materialise(tr.transition_table(tr.step_counts(windows, cfg.context)), "transitions")
    forecast = tr.propagate(table, k)
    counts = materialise(tr.onset_counts(windows, cfg.context), "onsets")
    seen = tr.nowcast_progress(md.nowcast(now, md.predict(detector, inputs, "detector_raw")), cfg.context)
    raw = tr.rollout_risk(seen, forecast, (k,)).withColumnRenamed(f"p_within_{k}", "early")
    keep = ["session_key", "pos_in_session", "split", "stage_now", y, valid, "detector_raw", "early", "session", "capture"]
    raw = materialise(compromise_onsets(raw, cfg.onset_quiet).select(*keep, "is_quiet"), "raw-scores")
    cal = raw.filter((F.col("split") == "calibration") & F.col(valid))
    platt = [fit_platt(cal, s, y) for s in ("detector_raw", "early")]
    hybrid = (apply_platt(F.col("detector_raw"), *platt[0]) + apply_platt(F.col("early"), *platt[1])) / 2
    budget = threshold_budget or cfg.primary_fpr_budget
    level2 = conformal_thresholds(cal.withColumn("hybrid", hybrid), (budget,), (), "hybrid", y).first()
    level1 = early_warning_threshold(raw, cfg.early_warning_budget, "early", label=y, valid=valid).first()
    early_threshold = 1.1 if level1["threshold"] is None else float(level1["threshold"])  # without quiet rows: never
    return ForecastModel(scaler, bins, detector, now, forecast, counts, float(level2["threshold"]), early_threshold, platt[0], platt[1])
