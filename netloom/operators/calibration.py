"""Thresholds for a false-positive budget, and probability calibration."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions.order_window import rolling_thresholds
from netloom.functions.scalars import bin_index, logit, sigmoid
from netloom.operators.alerts import KEY, POS, sustained_score
from netloom.operators.blocked import with_halo
from netloom.operators.ranking import bucketed, order_statistic, quantiles
from netloom.session import materialise, release


def conformal_rank(n: Column, budget: float) -> Column:
    raw = F.ceil((n + 1) * F.lit(1.0 - budget))
    return F.least(F.greatest(raw, F.lit(1)), n)


def conformal_thresholds(df: DataFrame, budgets: Sequence[float], by: Sequence[str] = (), score: str = "score",
                         label: str = "y") -> DataFrame:
    """Split-conformal threshold per budget, from the scores of negative rows: (by, budget, threshold).

    One ranking pass serves every budget. Without any negative row the threshold is 0.5.
    """
    ranks = {f"_t{i}": conformal_rank(F.col("total_n"), b) for i, b in enumerate(budgets)}
    picked = order_statistic(df.filter(~F.col(label)), by, score, ranks)
    cells = [F.struct(F.lit(float(b)).alias("budget"), F.coalesce(f"_t{i}", F.lit(0.5)).alias("threshold"))
             for i, b in enumerate(budgets)]
    return picked.select(*by, F.coalesce("n", F.lit(0)).alias("n_calibration"), F.inline(F.array(*cells)))


def achieved_rates(df: DataFrame, thresholds: DataFrame, by: Sequence[str] = (), score: str = "score",
                   label: str = "y", seconds: float = 10.0) -> DataFrame:
    """False-positive rate, recall and false alerts per hour at each threshold.

    Thresholds become one array per group, so every budget is counted in a single pass.
    """
    y = F.col(label)
    if by:
        packed = thresholds.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("budget", "threshold"))).alias("_t"))
        joined = df.join(packed, list(by))
    else:
        packed = thresholds.agg(F.array_sort(F.collect_list(F.struct("budget", "threshold"))).alias("_t"))
        joined = df.withColumn("_t", packed.scalar())
    hits = joined.select(*by, y.alias("_y"), F.col(score).alias("_s"), F.explode("_t").alias("_t"))
    alert = F.col("_s") >= F.col("_t.threshold")
    rates = hits.groupBy(*by, F.col("_t.budget").alias("budget"), F.col("_t.threshold").alias("threshold")).agg(
        F.coalesce(F.avg(F.when(~F.col("_y"), alert.cast("double"))), F.lit(0.0)).alias("fpr"),
        F.coalesce(F.avg(F.when(F.col("_y"), alert.cast("double"))), F.lit(0.0)).alias("recall"))
    return rates.withColumn("alerts_per_hour", F.col("fpr") * F.lit(3600.0 / seconds))


def coverage_report(cal: DataFrame, test: DataFrame, budgets: Sequence[float] = (0.005, 0.01, 0.02, 0.05),
                    score: str = "score", label: str = "y", seconds: float = 10.0) -> DataFrame:
    """Target against achieved false-positive rate on calibration and held-out rows."""
    thresholds = conformal_thresholds(cal, budgets, (), score, label)
    on_cal = achieved_rates(cal, thresholds, (), score, label, seconds).select(
        "budget", "threshold", F.col("fpr").alias("calibration_fpr"))
    on_test = achieved_rates(test, thresholds, (), score, label, seconds).select(
        "budget", F.col("fpr").alias("test_fpr"), F.col("recall").alias("test_recall"),
        F.col("alerts_per_hour").alias("test_alerts_per_hour"))
    return on_cal.join(on_test, "budget").withColumns({
        "coverage_gap": F.col("test_fpr") - F.col("budget"),
        "guarantee_held": F.col("test_fpr") <= F.col("budget") * 1.5,
    })


def adaptive_thresholds(df: DataFrame, budget: float, history: int = 500, min_history: int = 20,
                        stream: str = KEY, order: str = POS, score: str = "score", label: str = "y",
                        block: int = 65_536) -> DataFrame:
    """Rolling threshold from the last ``history`` negatives seen before each row of a stream.

    Negatives are numbered per stream. A long stream is cut into blocks of numbers that overlap by the history; inside
    a block a counting tree over score ranks answers every window (``functions.order_window``), so no window is
    ever collected or sorted. Rows then look their threshold up.
    """
    c = F.col
    before = W.partitionBy(stream).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    seen = F.coalesce(F.sum((~c(label)).cast("bigint")).over(before), F.lit(0))
    counted = df.withColumn("_seen", seen)
    negatives = counted.filter(~c(label)).select(c(stream).alias("_k"), c("_seen").alias("_i"), c(score).cast("double").alias("_s"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i", kind="stable")
        first, own = int(pdf["_i"].iloc[0]), pdf["_own"].to_numpy()
        # A block's first rows are its halo: all of the history, or all that the stream has.
        upto = np.arange(1, len(pdf) + 1)
        found = rolling_thresholds(pdf["_s"].to_numpy(), upto, budget, history, min_history)
        keep = own & ~np.isnan(found)
        return pd.DataFrame({"_k": pdf["_k"].to_numpy()[keep], "_seen": (first + upto)[keep], "_t": found[keep]})

    cut = with_halo(negatives, c("_i"), block, before=history - 1)
    schema = T.StructType([negatives.schema["_k"], T.StructField("_seen", T.LongType()), T.StructField("_t", T.DoubleType())])
    table = cut.groupBy("_k", "_slice").applyInPandas(run, schema).withColumnRenamed("_k", stream)
    fallback = quantiles(df, [stream], score, [1 - budget]).select(stream, c("q")[0].alias("_f"))
    return (counted.join(table, [stream, "_seen"], "left").join(fallback, stream, "left")
            .withColumn("threshold", F.coalesce("_t", "_f")).drop("_seen", "_t", "_f"))


def adaptive_summary(rows: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "y",
                     seconds: float = 10.0) -> DataFrame:
    """What rolling thresholds achieved: their median, false-positive rate, recall, false alerts per hour, negatives used."""
    alert, y = (F.col(score) >= F.col("threshold")).cast("double"), F.col(label)
    rates = rows.groupBy(*by).agg(
        F.count_if(~y).alias("n_calibration"),
        F.coalesce(F.avg(F.when(~y, alert)), F.lit(0.0)).alias("fpr"),
        F.coalesce(F.avg(F.when(y, alert)), F.lit(0.0)).alias("recall"))
    middle = quantiles(rows, by, "threshold", [0.5]).select(*by, F.col("q")[0].alias("threshold"))
    joined = rates.join(middle, list(by)) if by else rates.withColumn("threshold", middle.scalar())
    return joined.withColumn("alerts_per_hour", F.col("fpr") * F.lit(3600.0 / seconds))


def warmup_thresholds(test: DataFrame, budgets: Sequence[float], baseline: int = 90, score: str = "score") -> DataFrame:
    """Label-free threshold per session from its first ``baseline`` scored rows.

    Sessions need ten rows more than that; the baseline rows leave the metrics. The percentile
    runs over at most ``baseline`` values.
    """
    rank = F.row_number().over(W.partitionBy(KEY).orderBy(POS))
    size = F.count(F.lit(1)).over(W.partitionBy(KEY))
    ranked = test.withColumns({"_rank": rank, "_size": size}).filter(F.col("_size") > baseline + 10)
    points = F.array(*[F.lit(1.0 - b) for b in budgets])
    thresholds = ranked.filter(F.col("_rank") <= baseline).groupBy(KEY).agg(F.percentile(score, points).alias("_t"))
    cells = [F.struct(F.lit(float(b)).alias("budget"), F.col("_t")[i].alias("threshold"))
             for i, b in enumerate(budgets)]
    return (ranked.filter(F.col("_rank") > baseline).join(thresholds, KEY)
            .select(*test.columns, F.inline(F.array(*cells))))


def sustained_policy(scored: DataFrame, budgets: Sequence[float], k: int, split: str = "split", score: str = "score",
                     label: str = "y", valid: str = "valid", candidates: int = 200) -> DataFrame:
    """Smallest candidate threshold whose sustained false-positive rate stays within each budget.

    Sustained alerts at c are ``lowest score of the last k >= c``, so one histogram over the
    candidate grid gives every candidate's rate; no candidate is evaluated separately.
    """
    held = sustained_score(scored, score, k, "_held")
    cal = held.filter((F.col(split) == "calibration") & F.col(valid))
    points = [0.5 + i * (0.999 - 0.5) / (candidates - 1) for i in range(candidates)]
    grid = quantiles(cal, [], score, points).select(F.array_distinct("q").alias("grid"))
    placed = cal.filter(~F.col(label)).withColumn("_grid", grid.scalar()).select(
        F.coalesce(bin_index(F.col("_held"), F.col("_grid")), F.lit(0)).alias("_i"))
    counts = placed.groupBy("_i").agg(F.count(F.lit(1)).alias("_n"))
    levels = grid.select(F.posexplode("grid").alias("_c", "threshold"))
    # A row in histogram cell i alerts at every level below i. Levels number at most ``candidates``.
    above = F.sum(F.coalesce("_n", F.lit(0))).over(W.orderBy(F.desc("_c")).rowsBetween(W.unboundedPreceding, 0))
    above = levels.join(counts, F.col("_i") == F.col("_c") + 1, "left").select(
        "_c", "threshold", above.alias("_fp"))
    total = counts.agg(F.sum("_n").alias("n")).scalar()
    rated = above.withColumn("fpr", F.col("_fp") / F.greatest(total, F.lit(1)))
    picks = [F.struct(F.lit(float(b)).alias("budget"),
                      F.coalesce(F.min(F.when(F.col("fpr") <= b, F.col("threshold"))), F.max("threshold"))
                      .alias("threshold")) for b in budgets]
    chosen = rated.agg(F.array(*picks).alias("_p")).select(F.inline("_p"))
    return chosen.filter(F.col("threshold").isNotNull())


def early_warning_threshold(scored: DataFrame, budget: float, score: str, quiet: str = "is_quiet",
                            label: str = "y", split: str = "split", valid: str = "valid") -> DataFrame:
    """(1 - budget) quantile of the early-warning score on quiet benign calibration rows."""
    rows = scored.filter((F.col(split) == "calibration") & F.col(valid) & F.col(quiet) & ~F.col(label))
    return quantiles(rows, [], score, [1 - budget]).select("n", F.col("q")[0].alias("threshold"))


def pool_violators(x_low: np.ndarray, x_high: np.ndarray, weight: np.ndarray, total: np.ndarray):
    """Adjacent blocks (ordered) pooled until their means rise: (x_low, x_high, weight, total) of what is left."""
    kept: list[list[float]] = []
    for block in zip(x_low.tolist(), x_high.tolist(), weight.tolist(), total.tolist()):
        block = list(block)
        while kept and kept[-1][3] * block[2] >= block[3] * kept[-1][2]:
            low, _, w, t = kept.pop()
            block = [low, block[1], w + block[2], t + block[3]]
        kept.append(block)
    return [np.array(c) for c in zip(*kept)]


_BLOCKS = "part int, x_low double, x_high double, weight double, total double"


def _pool(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("x_low", kind="stable")
    found = pool_violators(*[pdf[c].to_numpy(float) for c in ("x_low", "x_high", "weight", "total")])
    return pd.DataFrame(dict(zip(("x_low", "x_high", "weight", "total"), found))).assign(part=int(pdf["part"].iloc[0]))[
        ["part", "x_low", "x_high", "weight", "total"]]


def isotonic(cal: DataFrame, score: str = "score", label: str = "y", buckets: int = 64) -> DataFrame:
    """Isotonic regression of the label on the score: stored blocks (part, x_low, x_high, y), y rising strictly.

    Equal scores are one row first. Each range of scores pools its own violators; what may still violate is the border between two
    ranges, so chains of ranges whose borders do are pooled again together, as lists of blocks, until no border
    violates. Blocks are few (at most about n^(2/3) of n labels) and stay spread over their ranges; only the
    ranges' first and last blocks, ``buckets`` rows at most, are looked at together.
    """
    c = F.col
    counts = cal.filter(c(score).isNotNull()).groupBy(c(score).cast("double").alias("x_low")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"), F.sum(c(label).cast("double")).alias("total"))
    cut = bucketed(counts, [], "x_low", ["weight"], buckets).select(
        c("_bucket").alias("part"), "x_low", c("x_low").alias("x_high"), "weight", "total")
    blocks = materialise(cut.groupBy("part").applyInPandas(_pool, _BLOCKS), "isotonic")
    mean = F.struct("x_low", (c("total") / c("weight")).alias("y"))
    inside = W.orderBy("part")  # one row per range
    while True:
        ends = blocks.groupBy("part").agg(F.min(mean)["y"].alias("first"), F.max(mean)["y"].alias("last"))
        apart = ends.withColumn("new", (F.lag("last").over(inside).isNull() | (F.lag("last").over(inside) < c("first"))).cast("int"))
        joined = materialise(apart.select("part", F.sum("new").over(inside).cast("int").alias("chain")), "isotonic-chains")
        done = joined.agg(F.count(F.lit(1)) == F.max("chain")).first()[0]
        if done or done is None:
            release(joined)
            return blocks.select("part", "x_low", "x_high", (c("total") / c("weight")).alias("y"))
        merged = blocks.join(F.broadcast(joined), "part").select(c("chain").alias("part"), "x_low", "x_high", "weight", "total")
        following = materialise(merged.groupBy("part").applyInPandas(_pool, _BLOCKS), "isotonic")
        release(blocks)
        release(joined)
        blocks = following


def apply_isotonic(df: DataFrame, blocks: DataFrame, score: str = "score", out: str = "probability") -> DataFrame:
    """Add the calibrated score: flat inside blocks and outside all of them, linear between two.

    A score first finds its range of blocks among the ranges' starts (few), then its block by a join on the range.
    """
    c = F.col
    start = blocks.groupBy("part").agg(F.min(F.struct("x_low", "y")).alias("s"))
    after = start.select("part", F.lead("s").over(W.orderBy("part")).alias("_after"))
    inside = W.partitionBy("part").orderBy("x_low")
    pieces = blocks.join(F.broadcast(after), "part").withColumn(
        "_next", F.coalesce(F.lead(F.struct("x_low", "y")).over(inside), c("_after"))).select(
        c("part").alias("_part"), c("x_low").alias("_low"), c("x_high").alias("_high"), c("y").alias("_y"), "_next")
    starts = start.agg(F.array_sort(F.collect_list(F.struct(c("s.x_low").alias("x"), "part"))).alias("a")).scalar()
    at = F.greatest(F.size(F.filter("_starts", lambda s: s["x"] <= c(score))), F.lit(1))
    placed = df.withColumn("_starts", starts).withColumns({
        "_part": F.when(c(score).isNotNull(), F.try_element_at("_starts", at)["part"]),
        "_least": F.try_element_at("_starts", F.lit(1))["x"]}).drop("_starts")
    first = c("_low") == c("_least")
    meets = (placed["_part"] == pieces["_part"]) & (first | (c(score) >= c("_low"))) & (c("_next").isNull() | (c(score) < c("_next.x_low")))
    slope = (c("_next.y") - c("_y")) / (c("_next.x_low") - c("_high"))
    value = F.when((c(score) > c("_high")) & c("_next").isNotNull(), c("_y") + slope * (c(score) - c("_high"))).otherwise(c("_y"))
    return placed.join(pieces, meets, "left").withColumn(out, value).select(*[placed[k] for k in df.columns], out)


def fit_platt(cal: DataFrame, score: str = "score", label: str = "y", c: float = 1e3, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic fit on the logit of the score (slope penalised by ``1 / (2 c)``).

    Rows are counted once per distinct score, stored, and every Newton step is one sum over the counts; steps
    that do not lower the loss are halved.
    """
    counts = materialise(cal.filter(F.col(score).isNotNull()).groupBy(logit(F.col(score)).alias("z")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("p")), "platt")
    z, n, p = F.col("z"), F.col("n"), F.col("p")

    def sums(a: float, b: float):
        x = F.lit(a) * z + F.lit(b)
        q, curve = sigmoid(x), n * sigmoid(x) * sigmoid(-x)
        # log(1 + exp(x)) without overflow
        loss = n * (F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))) - p * x
        row = counts.agg(F.sum(loss), F.sum((n * q - p) * z), F.sum(n * q - p), F.sum(curve * z * z), F.sum(curve * z), F.sum(curve)).first()
        return None if row[0] is None else (row[0] + a * a / (2 * c), row[1] + a / c, row[2], row[3] + 1 / c, row[4], row[5])

    at, step = (0.0, 0.0), 1.0
    now = sums(*at)
    for _ in range(steps if now else 0):
        _, ga, gb, haa, hab, hbb = now
        det = haa * hbb - hab * hab
        if det <= 0:  # one class and no curvature left
            break
        move = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        there = at[0] - step * move[0], at[1] - step * move[1]
        after = sums(*there)
        if after[0] <= now[0]:
            done = max(abs(step * m) for m in move) < 1e-10 * (1 + max(map(abs, there)))
            at, now, step = there, after, 1.0
            if done:
                break
        else:
            step /= 2
            if step < 1e-6:
                break
    release(counts)
    return at


def apply_platt(score: Column, a: float, b: float) -> Column:
    return F.when(score.isNotNull(), sigmoid(F.lit(a) * logit(score) + F.lit(b)))


def hybrid_score(scored: DataFrame, first: str, second: str, split: str = "split", label: str = "y",
                 valid: str = "valid") -> DataFrame:
    """Mean of two Platt-calibrated scores, both fitted on calibration rows."""
    cal = scored.filter((F.col(split) == "calibration") & F.col(valid))
    parts = [apply_platt(F.col(s), *fit_platt(cal, s, label)) for s in (first, second)]
    return scored.withColumn("hybrid", (parts[0] + parts[1]) / 2)
