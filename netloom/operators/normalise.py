"""Robust scaling and quantile bins.

Parameters are small tables (one row per feature). They reach the windows through a scalar
subquery, so nothing is collected and the windows table is not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom import vocab
from netloom.functions.scalars import bin_index, clip, compress
from netloom.operators.ranking import quantiles, quantiles_of_counts, value_counts
from netloom.session import materialise, release

CLIP = 10.0
EPS = 1e-9
MIN_ACTIVE_ROWS = 100


def unpivot(win: DataFrame, names: Sequence[str], keep: Sequence[str], compressed: bool = True) -> DataFrame:
    """Long form: one row per (window, feature), values compressed where the feature is heavy-tailed."""
    cells = [F.struct(F.lit(n).alias("feature"),
                      (compress(F.col(n), n in vocab.LOG_FEATURES) if compressed else F.col(n)).alias("value"))
             for n in names]
    return win.select(*keep, F.inline(F.array(*cells)))


def fit_rows(split: DataFrame) -> DataFrame:
    """Training-span rows with traffic; all of them if fewer than 100 windows have any."""
    fit = split.filter("fit_row")
    active = fit.agg((F.count_if(F.col("n_flows") > 0) >= MIN_ACTIVE_ROWS).alias("enough")).scalar()
    return fit.filter((F.col("n_flows") > 0) | ~active)


def fit_scaler(fit: DataFrame, names: Sequence[str] = vocab.FEATURE_NAMES) -> DataFrame:
    """``scaler(feature, center, scale, is_log)``: median and IQR with spread fallbacks."""
    long = unpivot(fit, names, [])
    q = quantiles(long, ["feature"], "value", [0.25, 0.5, 0.75])
    spread = long.groupBy("feature").agg(F.stddev_pop("value").alias("std"))
    iqr = (F.col("q")[2] - F.col("q")[0]) / F.lit(1.349)
    scale = F.when(iqr > EPS, iqr).when(F.col("std") > EPS, F.col("std")).otherwise(1.0)
    return q.join(spread, "feature").select(
        "feature", F.col("q")[1].alias("center"), scale.alias("scale"),
        F.col("feature").isin(*vocab.LOG_FEATURES).alias("is_log"))


def scaler_row(scaler: DataFrame, names: Sequence[str]) -> Column:
    """The scaler as one array of structs, in the order of ``names``, for expressions on other tables."""
    pairs = F.collect_list(F.struct("feature", F.struct("center", "scale")))
    return _in_order(scaler.agg(F.map_from_entries(pairs).alias("m")), "m", names).scalar()


def _in_order(df: DataFrame, column: str, names: Sequence[str], *keep: str) -> DataFrame:
    """A map by feature as an array by position, looked up once per table or session and not once per window."""
    return df.select(*keep, F.array(*[F.col(column)[n] for n in names]).alias(column))


def scaled(x: Column, is_log: bool, center: Column, scale: Column) -> Column:
    return clip((compress(x, is_log) - center) / scale, -CLIP, CLIP)


def unscaled(z: Column, is_log: bool, center: Column, scale: Column) -> Column:
    c = z * scale + center
    return F.signum(c) * F.expm1(F.abs(c)) if is_log else c


def scale_wide(win: DataFrame, scaler: DataFrame, names: Sequence[str] = vocab.FEATURE_NAMES,
               centers: DataFrame | None = None) -> DataFrame:
    """Replace each feature by its scaled value; ``centers`` are per-session overrides."""
    if centers is not None:
        per = centers.groupBy("session_key").agg(
            F.map_from_entries(F.collect_list(F.struct("feature", "center"))).alias("_own"))
        win = win.join(_in_order(per, "_own", names, "session_key"), "session_key", "left")
    win = win.withColumn("_s", scaler_row(scaler, names))

    def center(i: int) -> Column:
        shared = F.col("_s")[i]["center"]
        return shared if centers is None else F.coalesce(F.col("_own")[i], shared)

    out = win.withColumns({n: scaled(F.col(n), n in vocab.LOG_FEATURES, center(i), F.col("_s")[i]["scale"])
                           for i, n in enumerate(names)})
    return out.drop("_s", "_own")


def unscale_wide(win: DataFrame, scaler: DataFrame, names: Sequence[str] = vocab.FEATURE_NAMES) -> DataFrame:
    win = win.withColumn("_s", scaler_row(scaler, names))
    return win.withColumns({
        n: unscaled(F.col(n), n in vocab.LOG_FEATURES, F.col("_s")[i]["center"], F.col("_s")[i]["scale"])
        for i, n in enumerate(names)}).drop("_s")


def warmup_centers(win: DataFrame, names: Sequence[str] = vocab.FEATURE_NAMES, min_rows: int = 10) -> DataFrame:
    """Median of each session's warm-up rows, for sessions with enough of them.

    A group holds at most the warm-up length, so the built-in exact percentile is bounded.
    """
    long = unpivot(win.filter("warmup"), names, ["session_key"])
    return (long.groupBy("session_key", "feature")
            .agg(F.count(F.lit(1)).alias("n"), F.percentile("value", F.lit(0.5)).alias("center"))
            .filter(F.col("n") >= min_rows).drop("n"))


def fit_bins(long: DataFrame, n_bins: int = 16) -> DataFrame:
    """``bins(feature, edges, centers)`` from scaled long values: unique quantile edges and the
    median of every bin (the middle of its borders where the bin is empty).

    The long rows are read once, into a stored table of value counts; all later passes read that one. The result, one
    row per feature, is stored too, and the counts are deleted.
    """
    qs = [i / n_bins for i in range(1, n_bins)]
    counts = materialise(value_counts(long, ["feature"], "value"), "bin-values")
    edges = quantiles_of_counts(counts, ["feature"], "value", qs).select("feature", F.array_distinct("q").alias("edges"))
    placed = counts.join(F.broadcast(edges), "feature").withColumn("bin", bin_index(F.col("value"), F.col("edges")))
    medians = quantiles_of_counts(placed, ["feature", "bin"], "value", [0.5]).select(
        "feature", "bin", F.col("q")[0].alias("median"))
    found = medians.groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "median"))).alias("found"))
    ends = counts.groupBy("feature").agg((F.min("value") - 1e-6).alias("lo"), (F.max("value") + 1e-6).alias("hi"))
    borders = F.concat(F.array("lo"), F.col("edges"), F.array("hi"))
    centers = F.transform(
        F.sequence(F.lit(0), F.size("edges")),
        lambda b: F.coalesce(F.col("found")[b], (F.element_at("borders", b + 1) + F.element_at("borders", b + 2)) / 2))
    bins = (edges.join(found, "feature").join(ends, "feature").withColumn("borders", borders)
            .select("feature", "edges", centers.alias("centers")))
    stored = materialise(bins, "bins")
    release(counts)
    return stored


def assign_bins(long: DataFrame, bins: DataFrame) -> DataFrame:
    """Bin index and bin count per long row; the bins table has one row per feature (at most 92)."""
    return long.join(F.broadcast(bins.select("feature", "edges")), "feature").select(
        *long.columns, bin_index(F.col("value"), F.col("edges")).alias("bin"),
        (F.size("edges") + 1).alias("n_bins"))


def model_input(win: DataFrame, names: Sequence[str] = vocab.FEATURE_NAMES, out: str = "x") -> DataFrame:
    """Masked features followed by the three masks, as one array."""
    group = {f.name: f.grp for f in vocab.FEATURES}
    gated = [F.col(n) * F.col(vocab.GROUP_MASK[group[n]]) if group[n] in vocab.GROUP_MASK else F.col(n)
             for n in names]
    return win.withColumn(out, F.array(*gated, *[F.col(m) for m in vocab.MASKS]))
