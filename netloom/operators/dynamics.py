"""Likelihood of the next states over wide rows: all features of a window are one array.

A session is cut into overlapping position blocks (``with_halo``); inside a block the count of every bin over a sliding context is a
difference of two running counts, for all features at once, so no window is copied per feature and no task holds
a whole session.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom import vocab
from netloom.functions.scalars import bin_index
from netloom.operators.alerts import KEY, POS
from netloom.operators.blocked import with_halo

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_P = 1e-4


def mask_of(name: str) -> Column:
    """1 where the feature's group was observed in the window (uses the mask columns)."""
    group = next(f.grp for f in vocab.FEATURES if f.name == name)
    return F.col(vocab.GROUP_MASK[group]) if group in vocab.GROUP_MASK else F.lit(1.0)


def binned_states(scaled: DataFrame, bins: DataFrame, names: Sequence[str] = vocab.FEATURE_NAMES) -> DataFrame:
    """Add ``z``, ``bins``, ``mask`` (arrays in the order of ``names``) and ``n_bins`` to scaled windows.

    The bins table has one row per feature and reaches the windows as one map.
    """
    edges = bins.agg(F.map_from_entries(F.collect_list(F.struct("feature", "edges"))).alias("m")).scalar()
    rows = scaled.withColumn("_m", edges)
    return rows.withColumns({
        "z": F.array(*[F.col(n).cast("double") for n in names]),
        "bins": F.array(*[bin_index(F.col(n), F.col("_m")[n]) for n in names]),
        "n_bins": F.array(*[F.size(F.col("_m")[n]) + 1 for n in names]),
        "mask": F.array(*[mask_of(n).cast("double") for n in names])}).drop("_m")


def context_counts(bins: np.ndarray, context: int) -> np.ndarray:
    """(rows + 1, features, bins) running counts; windows of counts are differences."""
    running = np.zeros((len(bins) + 1, bins.shape[1], int(bins.max(initial=0)) + 1), np.int32)
    running[1:] = bins[:, :, None] == np.arange(running.shape[2])
    return np.cumsum(running, axis=0, out=running)


def masked_nll(p: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean negative log-likelihood of every row over its observed features."""
    return -(np.log(np.clip(p, LEAST_P, 1.0)) * mask).sum(1) / np.maximum(mask.sum(1), 1.0)


def history_and_persistence(bins: np.ndarray, n_bins: np.ndarray, mask: np.ndarray, k: int, context: int, alpha: float = 0.5,
                            sharp: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """NLL of rows from ``context + k - 1`` on, under the ``context`` rows that end k before, and under the row k before."""
    first = context + k - 1
    target = bins[first:]
    running = context_counts(bins, context)
    at = np.arange(first, len(bins))
    seen = np.take_along_axis(running[at - k + 1] - running[at - k - context + 1], target[:, :, None], 2)[:, :, 0]
    history = (seen + alpha) / (context + alpha * n_bins)
    stays = np.where(bins[at - k] == target, sharp, (1 - sharp) / np.maximum(n_bins - 1, 1))
    return masked_nll(history, mask[first:]), masked_nll(stays, mask[first:])


def next_state_nll(states: DataFrame, horizons: Sequence[int], context: int, block: int = 4096) -> DataFrame:
    """(session_key, pos_in_session, k, nll_history, nll_persistence) of every window with a whole context k windows
    before, from ``binned_states``."""
    before = max(horizons) + context - 1
    cut = with_halo(states.select(KEY, POS, "bins", "n_bins", "mask"), F.col(POS), block, before=before)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS, kind="stable")
        bins, mask, n_bins = np.stack(pdf["bins"]).astype(np.int64), np.stack(pdf["mask"]), np.asarray(pdf["n_bins"].iloc[0])
        own, parts = pdf["_own"].to_numpy(), []
        for k in horizons:
            first = context + k - 1
            if len(pdf) > first:
                h, p = history_and_persistence(bins, n_bins, mask, k, context)
                keep = own[first:]
                parts.append(pd.DataFrame({KEY: pdf[KEY].iloc[0], POS: pdf[POS].to_numpy()[first:][keep], "k": k,
                                           "nll_history": h[keep], "nll_persistence": p[keep]}))
        return pd.concat(parts) if parts else pd.DataFrame({
            KEY: pd.Series(dtype=object), **{c: pd.Series(dtype="int64") for c in (POS, "k")},
            **{c: pd.Series(dtype=float) for c in ("nll_history", "nll_persistence")}})

    return cut.groupBy(KEY, "_slice").applyInPandas(
        run, f"{KEY} string, {POS} bigint, k int, nll_history double, nll_persistence double")


def surprise(states: DataFrame, context: int, block: int = 4096) -> DataFrame:
    """How unlikely each window is under its own recent history."""
    return next_state_nll(states, (1,), context, block).select(KEY, POS, F.col("nll_history").alias("surprise"))


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2.0)))


def autoregression_nll(pairs: DataFrame, params: dict[str, np.ndarray], edges: Sequence[Sequence[float]], k: int) -> DataFrame:
    """(session_key, pos_in_session, k, nll_ar): likelihood of the target's bins under a Gaussian around the ridge
    prediction, from pairs (x, target_bins, target_mask). Parameters and edges are of fixed size."""
    weights, intercept, sigma = (np.asarray(params[p], float) for p in ("weights", "intercept", "sigma"))
    widest = max((len(e) for e in edges), default=0)
    upper = np.full((len(edges), widest + 1), np.inf)
    for i, e in enumerate(edges):
        upper[i, :len(e)] = e
    lower = np.concatenate([np.full((len(edges), 1), -np.inf), upper[:, :-1]], 1)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            array = lambda name: np.array(batch.column(name).flatten()).reshape(n, -1)
            mu = array("x") @ weights + intercept
            bins, column = array("target_bins"), np.arange(len(edges))
            p = normal_cdf((upper[column, bins] - mu) / sigma) - normal_cdf((lower[column, bins] - mu) / sigma)
            yield pa.RecordBatch.from_arrays(
                [batch.column(KEY), pa.array(np.asarray(batch.column(POS)) + k), pa.array(np.full(n, k, np.int32)),
                 pa.array(masked_nll(p, array("target_mask")))], names=[KEY, POS, "k", "nll_ar"])

    return pairs.select(KEY, POS, "x", "target_bins", "target_mask").mapInArrow(
        run, f"{KEY} string, {POS} bigint, k int, nll_ar double")
