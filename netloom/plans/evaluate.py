"""Evaluation reports: one scored windows table in, small metric tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.config import EngineConfig
from netloom.operators import calibration as ca
from netloom.operators import dynamics as dy
from netloom.operators import metrics as mt
from netloom.operators import models as md
from netloom.operators.alerts import KEY, POS, two_level
from netloom.operators.ranking import quantiles
from netloom.session import materialise


def _long(part: str, df: DataFrame) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns]
    return df.select(F.lit(part).alias("part"), F.inline(F.array(*cells)))


def evaluation_report(scored: DataFrame, cfg: EngineConfig, score: str = "score", label: str = "y",
                      n_boot: int = 300, block: int = 180) -> DataFrame:
    """Calibrate on calibration anchors, report on test anchors: (part, metric, value) rows. Parts: ranking and calibration
    error, the interval of average precision, early warning, means over captures, isotonic calibration, thresholds
    of the sustained policy, and per budget the operating point with its lead times.

    ``scored`` is the windows table with split, valid, label, score, is_quiet and
    is_compromise_onset; store it first, since every part reads it.
    """
    ready = F.col("valid") & F.col(score).isNotNull()
    cal, test = (scored.filter((F.col("split") == s) & ready) for s in ("calibration", "test"))
    blocked = mt.time_blocks(test, block)
    parts = [
        _long("all", mt.auprc(test, [], score, label)),
        _long("all", mt.calibration_error(test, [], score, label)),
        _long("auprc_ci", mt.interval(mt.bootstrap_auprc(blocked, n_boot, 0, score, label), "auprc")),
        _long("early_warning", mt.auprc(test.filter("is_quiet"), [], score, label)),
        _long("macro_capture", mt.per_capture(test, score, label).agg(
            F.avg("auprc").alias("auprc"), F.avg("roc_auc").alias("roc_auc"))),
    ]
    calibrated = ca.apply_isotonic(test, ca.isotonic(cal, score, label), score, "_calibrated")
    parts += [_long("isotonic", mt.confusion(calibrated, [], 0.5, "_calibrated", label).select("brier")),
              _long("isotonic", mt.calibration_error(calibrated, [], "_calibrated", label))]
    policy = ca.sustained_policy(scored, cfg.fpr_budgets, cfg.hysteresis, score=score, label=label)
    parts.append(policy.select(F.lit("sustained").alias("part"), F.concat(F.lit("threshold_"), F.col("budget").cast("string")).alias("metric"),
                               F.col("threshold").alias("value")))
    thresholds = ca.conformal_thresholds(cal, cfg.fpr_budgets, (), score, label)
    for budget in cfg.fpr_budgets:
        at = thresholds.filter(F.col("budget") == budget).select("threshold").scalar()
        onset = scored.withColumn("_onset", F.col("is_compromise_onset") & F.coalesce(
            F.col("split") == "test", F.lit(False)))
        leads = mt.lead_times(onset, F.col(score) >= at, "_onset", cfg.primary_horizon, cfg.hysteresis)
        parts += [_long(f"fpr_{budget}", mt.confusion(test, [], at, score, label)),
                  _long(f"fpr_{budget}", mt.lead_summary(leads))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def two_level_report(scored: DataFrame, cfg: EngineConfig, budgets: Sequence[float], threshold: float,
                     risk: str = "score", early: str = "score_b", label: str = "y") -> DataFrame:
    """Warned onsets, false-warning rate and warnings per hour of the two-level policy per budget.

    Budgets multiply the session key, so one job sweeps them all. Onsets are the valid test rows
    where a compromise starts.
    """
    quiet_benign = F.col("is_quiet") & ~F.col(label)
    cal = scored.filter((F.col("split") == "calibration") & F.col("valid") & quiet_benign)
    points = quantiles(cal, [], early, [1 - b for b in budgets]).select("q").scalar()
    cells = F.arrays_zip(F.lit([float(b) for b in budgets]).alias("budget"), points.alias("early_threshold"))
    each = scored.select("*", F.inline(cells)).withColumn(
        "session_key", F.concat_ws("%", F.col("budget").cast("string"), "session_key"))
    levels = two_level(each, risk, early, threshold, F.col("early_threshold"), cfg.hysteresis)
    on_test = F.coalesce(F.col("split") == "test", F.lit(False)) & F.col("valid")
    levels = levels.withColumns({"_test": on_test, "_onset": on_test & F.col("is_compromise_onset")})
    leads = mt.lead_times(levels, F.col("level") > 0, "_onset", cfg.primary_horizon, 1)
    warned = leads.groupBy("budget").agg(F.count(F.lit(1)).alias("onsets"), F.count_if(F.col("lead_windows") > 0).alias("warned"))
    test_quiet = levels.filter("_test and is_quiet")
    one = (F.col("level") == 1).cast("double")
    hours = levels.filter("_test").groupBy("budget", "early_threshold").agg(
        (F.count(F.lit(1)) * F.lit(cfg.window_seconds / 3600.0)).alias("hours"))
    rates = test_quiet.groupBy("budget").agg(
        F.avg(F.when(~F.col(label), one)).alias("false_rate"), F.avg(F.when(F.col(label), one)).alias("hit_rate"),
        F.sum(F.when(~F.col(label), one).otherwise(0.0)).alias("_false"))
    return hours.join(rates, "budget", "left").join(warned, "budget", "left").select(
        "budget", "early_threshold", F.coalesce("onsets", F.lit(0)).alias("onsets"),
        F.coalesce("warned", F.lit(0)).alias("warned"), "false_rate", "hit_rate",
        (F.coalesce("_false", F.lit(0.0)) / F.col("hours")).alias("false_per_hour"))


def fixed_threshold_report(rows: DataFrame, threshold: float, score: str = "score", label: str = "y") -> DataFrame:
    """Metrics of an extra set (campaigns) at a threshold chosen elsewhere."""
    return mt.confusion(rows, [], threshold, score, label)


def next_state_report(states: DataFrame, horizons: Sequence[int], cfg: EngineConfig, edges: Sequence[Sequence[float]] | None = None,
                      n_boot: int = 300, block: int = 180) -> DataFrame:
    """Per horizon, on test windows: mean likelihood of history, persistence and (given the bins' ``edges``) a ridge
    autoregression fitted on training windows, and the interval of history's gain over persistence.

    ``states`` is ``dynamics.binned_states`` with ``split``; store it first. A window counts for k if its whole context ends k before it.
    """
    k_of = F.col("k").cast("string")
    rows = dy.next_state_nll(states, horizons, cfg.context, cfg.session_block)
    anchors = states.filter("split = 'test'").select(
        KEY, F.explode(F.lit(list(horizons))).alias("k"), F.col(POS).alias("_at")).withColumn(POS, F.col("_at") + F.col("k")).drop("_at")
    rows = rows.join(anchors, [KEY, POS, "k"])
    if edges is not None:
        controls = None
        for k in horizons:  # one small model per horizon
            pairs = md.history_pairs(states, k, block=cfg.session_block)
            fitted = md.ridge_autoregression(pairs.filter("split = 'train'"), len(edges))
            found = dy.autoregression_nll(pairs.filter("split = 'test'"), fitted, edges, k)
            controls = found if controls is None else controls.unionByName(found)
        rows = rows.join(controls, [KEY, POS, "k"])
    rows = materialise(rows.withColumn("gain", F.col("nll_persistence") - F.col("nll_history")), "next-state")
    means = [c for c in rows.columns if c.startswith("nll_")] + ["gain"]
    report = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in means])
    out = None
    for k in horizons:
        ci = mt.interval(mt.bootstrap_mean(mt.time_blocks(rows.filter(F.col("k") == k), block), "gain", n_boot), "mean")
        named = ci.select(F.lit(k).alias("k"), F.col("low").alias("gain_low"), F.col("high").alias("gain_high"))
        out = named if out is None else out.unionByName(named)
    return report.join(F.broadcast(out), "k")  # one row per horizon
