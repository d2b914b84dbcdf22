"""Forecast metrics over a scored table. ``by`` groups let many models or captures share one job."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.scalars import clip, stable_uniform
from netloom.operators.alerts import KEY, POS, run_length, sustained
from netloom.operators.ranking import bucketed, cumulate
from netloom.session import materialise, release


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def score_counts(df: DataFrame, by: Sequence[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score: the only input the ranking metrics need."""
    w = F.lit(1) if weight is None else F.col(weight)
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label), w).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label), 0).otherwise(w)).alias("neg"))


def ranking_metrics(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Average precision (step sum, ties together) and ROC-AUC per group; NULL with one class."""
    curve = cumulate(counts, by, "score", ["pos", "neg"], descending=True)
    p, tp, fp = F.col("pos"), F.col("cum_pos"), F.col("cum_neg")
    both = (F.sum("pos") > 0) & (F.sum("neg") > 0)
    return curve.groupBy(*by).agg(
        F.sum(p + F.col("neg")).alias("n"), F.sum("pos").alias("positives"),
        F.when(both, F.sum(p * tp / (tp + fp)) / F.sum("pos")).alias("auprc"),
        F.when(both, F.sum(F.col("neg") * (tp - p / 2)) / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"),
    )


def auprc(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    return ranking_metrics(score_counts(df, by, score, label), by)


def confusion(df: DataFrame, by: Sequence[str], threshold: Column | float, score: str = "score",
              label: str = "y") -> DataFrame:
    """Counts and rates at a threshold, Brier score; undefined rates are 0."""
    alert, y = F.col(score) >= threshold, F.col(label)
    counted = df.groupBy(*by).agg(
        F.count_if(alert & y).alias("tp"), F.count_if(alert & ~y).alias("fp"),
        F.count_if(~alert & y).alias("fn"), F.count_if(~alert & ~y).alias("tn"),
        F.avg(F.pow(clip(F.col(score), 0, 1) - y.cast("double"), F.lit(2.0))).alias("brier"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return counted.withColumns({
        "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn), "fpr": _ratio(fp, fp + tn),
    })


def reliability(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "y", bins: int = 10) -> DataFrame:
    """Mean prediction, observed rate and count per equal-width bin (last bin closed)."""
    p = clip(F.col(score), 0, 1)
    index = F.least(F.floor(p * bins), F.lit(bins - 1))
    return df.groupBy(*by, index.alias("bin")).agg(
        F.avg(p).alias("predicted"), F.avg(F.col(label).cast("double")).alias("observed"),
        F.count(F.lit(1)).alias("count"))


def calibration_error(df: DataFrame, by: Sequence[str], score: str = "score", label: str = "y",
                      bins: int = 10) -> DataFrame:
    gap = F.abs(F.col("observed") - F.col("predicted")) * F.col("count")
    return reliability(df, by, score, label, bins).groupBy(*by).agg((F.sum(gap) / F.sum("count")).alias("ece"))


def lead_times(scored: DataFrame, alert: Column, onset: str, max_lookback: int, hysteresis: int,
               grace: int = 6) -> DataFrame:
    """Per onset: length of the sustained alert run ending just before it, and detection."""
    alerts = sustained(scored, alert, hysteresis, "_alert")
    order = W.partitionBy(KEY).orderBy(POS)
    back = W.partitionBy(KEY).orderBy(F.desc(POS)).rowsBetween(W.unboundedPreceding, 0)
    marked = alerts.withColumns({
        "_run": run_length(F.col("_alert")),
        "_next": F.last(F.when(F.col("_alert"), F.col(POS)), ignorenulls=True).over(back),
    }).withColumn("_before", F.coalesce(F.lag("_run").over(order), F.lit(0)))
    lead = F.least(F.col("_before"), F.lit(max_lookback)).cast("bigint")
    late = F.coalesce(F.col("_next") - F.col(POS) <= grace, F.lit(False))
    return marked.filter(onset).select(
        *[c for c in scored.columns], lead.alias("lead_windows"), ((lead > 0) | late).alias("detected"))


def lead_summary(leads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Warned and detected onsets, also as fractions (NULL without onsets); median and mean over positive leads (at most the look-back)."""
    lead = F.when(F.col("lead_windows") > 0, F.col("lead_windows"))
    return leads.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_onsets"), F.count(lead).alias("warned_before"),
        F.count_if("detected").alias("detected_within"),
        F.avg((F.col("lead_windows") > 0).cast("double")).alias("warned_before_frac"),
        F.avg(F.col("detected").cast("double")).alias("detected_frac"),
        F.coalesce(F.percentile(lead, F.lit(0.5)), F.lit(0.0)).alias("median_lead_windows"),
        F.coalesce(F.avg(lead), F.lit(0.0)).alias("mean_lead_windows"),
    )


def time_blocks(df: DataFrame, block: int = 180) -> DataFrame:
    return df.withColumn("block", F.concat_ws("@", KEY, F.floor(F.col(POS) / block).cast("string")))


def dense_index(df: DataFrame, key: str, out: str = "i") -> DataFrame:
    """Number distinct keys from 0. Keys are spread over 256 hash groups, numbered inside each, and
    shifted by the group totals (256 rows), so no task orders them all."""
    group = F.substring(F.md5(key), 1, 2)
    keyed = df.select(key).distinct().withColumn("_g", group)
    inside = F.row_number().over(W.partitionBy("_g").orderBy(key)) - 1
    sizes = keyed.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1))
    offsets = F.broadcast(sizes.select("_g", F.coalesce(before, F.lit(0)).alias("_o")))
    return keyed.withColumn("_r", inside).join(offsets, "_g").select(key, (F.col("_r") + F.col("_o")).alias(out))


def block_multiplicities(blocks: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """How often each block is drawn in every resample: ``(boot, block, m)``.

    A resample draws as many blocks as there are. Draw i of resample b picks a block number by
    hash, so the table is the same on every layout and retry.
    """
    numbered = dense_index(blocks, "block", "_i")
    total = blocks.agg(F.count_distinct("block").alias("n")).scalar()
    draws = numbered.withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    u = stable_uniform([F.col("boot"), F.col("_i")], seed)
    picked = draws.select("boot", F.floor(u * total).alias("_i")).groupBy("boot", "_i").agg(
        F.count(F.lit(1)).alias("m"))
    return picked.join(numbered, "_i").select("boot", "block", "m")


def bootstrap_mean(df: DataFrame, value: str, n_boot: int, seed: int = 0) -> DataFrame:
    """Mean of a column in every block resample, from per-block sums."""
    sums = df.groupBy("block").agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    drawn = sums.join(block_multiplicities(df, n_boot, seed), "block")
    return drawn.groupBy("boot").agg((F.sum(F.col("s") * F.col("m")) / F.sum(F.col("c") * F.col("m"))).alias("mean"))


def block_draws(blocks: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """``block_multiplicities`` as one row per drawn block: ``(block, m)``, ``m`` an array over resamples."""
    drawn = block_multiplicities(blocks, n_boot, seed)
    found = drawn.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("boot", "m"))).alias("_m"))
    times = F.transform(F.sequence(F.lit(0), F.lit(n_boot - 1)),
                        lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)).cast("int"))
    return found.select("block", times.alias("m"))


_CELLS = "model string, _bucket bigint, score double, p array<bigint>, q array<bigint>"


def _weighted(n_boot: int):
    """Positives and negatives of every resample per (model, bucket, score) of one task's rows."""
    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def flush():
            keys, values = list(held), list(held.values())
            held.clear()
            side = lambda i: pa.array([v[i] for v in values], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([*[pa.array(c) for c in zip(*keys)], side(0), side(1)],
                                              names=["model", "_bucket", "score", "p", "q"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            m = np.array(batch.column("m").flatten()).reshape(-1, n_boot)
            columns = [batch.column(c).to_pylist() for c in ("model", "_bucket", "score", "pos", "neg")]
            for *key, pos, neg, times in zip(*columns, m):
                at = held.setdefault(tuple(key), np.zeros((2, n_boot), np.int64))
                at[0] += pos * times
                at[1] += neg * times
            if len(held) * n_boot > 1 << 20:
                yield flush()
        if held:
            yield flush()
    return run


def bootstrap_metrics(df: DataFrame, n_boot: int, scores: Sequence[str], seed: int = 0, label: str = "y") -> DataFrame:
    """Average precision and ROC-AUC of every block resample for several scores, on the same draws:
    ``(model, boot, n, positives, auprc, roc_auc)``; the metrics are NULL with one class.

    A block carries its multiplicities as one array over resamples, so a row meets all resamples at once and
    none is shuffled on its own. Rows are added up per (model, score) in their task, stored, and reduced twice
    per range of scores: to the ranges' totals, then, on top of the totals of higher ranges, to the metrics' sums.
    Only models x ranges x resamples numbers reach the driver.
    """
    c = F.col
    rows = df.select("block", c(label).cast("boolean").alias("_y"), F.inline(F.array(*[
        F.struct(F.lit(s).alias("model"), c(s).cast("double").alias("score")) for s in scores]))).filter(c("score").isNotNull())
    counts = score_counts(rows, ["model", "block"], "score", "_y")
    cut = bucketed(counts, ["model"], "score", ["pos", "neg"])
    met = cut.join(block_draws(df, n_boot, seed), "block")
    cells = materialise(met.select("model", "_bucket", "score", "pos", "neg", "m").mapInArrow(_weighted(n_boot), _CELLS), "boot")

    def summed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(resamples in columns) positives and negatives per distinct score, scores falling."""
        pdf = pdf.sort_values("score", ascending=False, kind="stable")
        score = pdf["score"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
        return tuple(np.add.reduceat(np.stack(pdf[k]), first, axis=0) for k in ("p", "q"))

    def totals(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            p, q = (np.array(batch.column(k).flatten()).reshape(-1, n_boot) for k in "pq")
            for i, key in enumerate(zip(batch.column("model").to_pylist(), batch.column("_bucket").to_pylist())):
                held.setdefault(key, np.zeros((2, n_boot), np.int64))
                held[key] += (p[i], q[i])
        if held:
            yield pa.RecordBatch.from_arrays([
                *[pa.array(k) for k in zip(*held)], *[pa.array([v[i] for v in held.values()], pa.list_(pa.int64())) for i in (0, 1)]],
                names=["model", "_bucket", "p", "q"])

    ranges = cells.mapInArrow(totals, "model string, _bucket bigint, p array<bigint>, q array<bigint>").repartition("model", "_bucket")
    merged = {}
    for model, bucket, p, q in ranges.groupBy("model", "_bucket").applyInPandas(
            lambda pdf: pd.DataFrame({"model": pdf["model"].iloc[:1].tolist(), "_bucket": pdf["_bucket"].iloc[:1].tolist(),
                                      "p": [np.stack(pdf["p"]).sum(0)], "q": [np.stack(pdf["q"]).sum(0)]}),
            "model string, _bucket bigint, p array<bigint>, q array<bigint>").collect():
        merged[model, bucket] = np.array([p, q], np.int64)
    none = np.zeros((2, n_boot), np.int64)
    above = {(m, k): sum((v for (n, j), v in merged.items() if n == m and j > k), none) for m, k in merged}

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = summed(pdf)
        before = above[pdf["model"].iloc[0], int(pdf["_bucket"].iloc[0])]
        tp, fp = before[0] + p.cumsum(0), before[1] + q.cumsum(0)
        precise = (p * (tp / np.maximum(tp + fp, 1))).sum(0)
        return pd.DataFrame({"model": pdf["model"].iloc[:1].tolist(), "a": [precise], "u": [(q * (tp - p / 2)).sum(0)]})

    parts = cells.groupBy("model", "_bucket").applyInPandas(sums, "model string, a array<double>, u array<double>").collect()
    release(cells)
    out = []
    for model in scores:
        whole = sum((v for (m, _), v in merged.items() if m == model), none)
        a, u = (sum((np.array(r[k]) for r in parts if r["model"] == model), np.zeros(n_boot)) for k in ("a", "u"))
        for boot, (pos, neg) in enumerate(whole.T.tolist()):
            both = pos > 0 and neg > 0
            out.append((model, boot, pos + neg, pos, float(a[boot] / pos) if both else None,
                        float(u[boot] / (pos * neg)) if both else None))
    return df.sparkSession.createDataFrame(out, "model string, boot int, n bigint, positives bigint, auprc double, roc_auc double")


def bootstrap_auprc(df: DataFrame, n_boot: int, seed: int = 0, score: str = "score", label: str = "y") -> DataFrame:
    """Average precision of every block resample that holds both classes."""
    return bootstrap_metrics(df, n_boot, [score], seed, label).filter(F.col("auprc").isNotNull()).drop("model")


def interval(values: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """95 % percentile interval over the resamples (``n_boot`` rows, so the aggregate is bounded)."""
    return values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("resamples"),
        F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"))


def paired_bootstrap(df: DataFrame, n_boot: int, score_a: str, score_b: str, label: str = "y",
                     seed: int = 0) -> DataFrame:
    """Difference in average precision on identical resamples, from one pass over both scores."""
    runs = bootstrap_metrics(df, n_boot, [score_a, score_b], seed, label)
    pick = lambda name: F.max(F.when(F.col("model") == name, F.col("auprc")))
    diffs = runs.groupBy("boot").agg((pick(score_a) - pick(score_b)).alias("diff")).filter(F.col("diff").isNotNull())
    return diffs.agg(
        F.count(F.lit(1)).alias("resamples"), F.percentile("diff", F.lit(0.025)).alias("low"),
        F.percentile("diff", F.lit(0.975)).alias("high"),
        F.avg((F.col("diff") > 0).cast("double")).alias("p_a_better"))


def per_capture(df: DataFrame, score: str = "score", label: str = "y", min_class: int = 5) -> DataFrame:
    """Ranking metrics inside each capture that holds enough of both classes."""
    return auprc(df, ["capture"], score, label).filter(
        (F.col("positives") >= min_class) & (F.col("n") - F.col("positives") >= min_class))


def macro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """F1 per class present in the truth, averaged."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.inline(F.array(
        F.struct(F.col("t").alias("cls"), "n", F.lit(0).cast("bigint").alias("as_p"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("n"), F.col("n").alias("as_p"),
                 F.lit(0).cast("bigint").alias("hit")))))
    per_class = sides.groupBy("cls").agg(F.sum("n").alias("t"), F.sum("as_p").alias("p"), F.sum("hit").alias("h"))
    return per_class.filter("t > 0").agg(
        F.avg(2.0 * F.col("h") / (F.col("t") + F.col("p"))).alias("macro_f1"), F.count(F.lit(1)).alias("classes"))

