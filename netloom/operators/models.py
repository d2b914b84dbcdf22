"""Spark ML baselines on the windows table, and the ridge autoregression over scaled states."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom import vocab
from netloom.operators.alerts import KEY, POS
from netloom.operators.blocked import with_halo

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package installed


def stack_history(win: DataFrame, column: str, depth: int, block: int, out: str = "x") -> DataFrame:
    """Concatenate the arrays of the last ``depth`` windows, oldest first; short histories are NULL.

    Sessions are cut into overlapping position blocks, so no task holds a whole session.
    """
    order = W.partitionBy(KEY, "_slice").orderBy(POS)
    parts = [F.lag(column, i).over(order) for i in range(depth - 1, 0, -1)] + [F.col(column)]
    cut = with_halo(win, F.col(POS), block, before=depth - 1)
    return cut.withColumn(out, F.concat(*parts)).filter("_own").drop("_own", "_slice")


def context_tensor(win: DataFrame, columns: Sequence[str], context: int, block: int, out: str = "context") -> DataFrame:
    """The last ``context`` windows of every row as an array of feature arrays (full contexts only)."""
    frame = W.partitionBy(KEY, "_slice").orderBy(POS).rowsBetween(-(context - 1), 0)
    cut = with_halo(win, F.col(POS), block, before=context - 1)
    rows = F.collect_list(F.array(*columns)).over(frame)
    return cut.withColumn(out, rows).filter("_own").drop("_own", "_slice").filter(F.size(out) == context)


def _training_rows(rows: DataFrame, label: str) -> DataFrame:
    """Vector features, numeric label and balanced class weights (two class counts, one subquery)."""
    share = rows.agg(F.avg(F.col(label).cast("double")).alias("p")).scalar()
    y = F.col(label).cast("double")
    weight = F.when(y > 0, 0.5 / share).otherwise(0.5 / (1.0 - share))
    return rows.select(array_to_vector("x").alias("features"), y.alias("label"), weight.alias("weight"))


def fit_logistic(train: DataFrame, label: str = "y", c: float = 1.0):
    """Balanced, L2-regularised logistic regression on the array column ``x``."""
    data = _training_rows(train.filter(F.col("x").isNotNull()), label).persist()
    try:
        n = data.count()
        return LogisticRegression(weightCol="weight", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0,
                                  standardization=False, maxIter=300).fit(data)
    finally:
        data.unpersist()


def fit_boosting(train: DataFrame, label: str = "y", seed: int = 17, rounds: int = 300):
    """Balanced gradient-boosted trees: statistically close to a leaf-wise booster, not equal."""
    data = _training_rows(train.filter(F.col("x").isNotNull()), label)
    return GBTClassifier(weightCol="weight", maxIter=rounds, stepSize=0.08, maxDepth=5, seed=seed,
                         checkpointInterval=10).fit(data)


def fit_nowcast(train: DataFrame, stage: str = "stage_now"):
    """Multinomial logistic regression for the current stage."""
    data = train.select(array_to_vector("x").alias("features"), F.col(stage).cast("double").alias("label"))
    return LogisticRegression(family="multinomial", regParam=1e-3, elasticNetParam=0.0, maxIter=200).fit(data)


def predict(model: PipelineModel, rows: DataFrame, out: str = "score") -> DataFrame:
    """Probability of the positive class; rows without a full input keep a NULL score."""
    known = rows.filter(F.col("x").isNotNull()).withColumn("features", array_to_vector("x"))
    scored = model.transform(known).withColumn(out, vector_to_array("probability")[1])
    drop = [c for c in ("features", "rawPrediction", "probability", "prediction") if c not in rows.columns]
    return scored.drop(*drop)


def nowcast(model, rows: DataFrame, out: str = "nowcast") -> DataFrame:
    """Stage probabilities, padded with zeros to the full vocabulary."""
    ready = rows.withColumn("features", array_to_vector("x"))
    probs = vector_to_array("probability")
    padded = F.slice(F.concat(probs, F.array_repeat(F.lit(0.0), vocab.N_STAGES)), 1, vocab.N_STAGES)
    return model.transform(ready).withColumn(out, padded).drop(
        "features", "rawPrediction", "probability", "prediction")


# ------------------------------------------------------------------ ridge autoregression
def history_pairs(states: DataFrame, k: int, depth: int = 6, block: int = 4096) -> DataFrame:
    """Windows with the states of the last ``depth`` windows in ``x`` and the state k windows later in ``target``,
    ``target_bins`` and ``target_mask``; others are left out. Sessions are cut into overlapping position blocks."""
    order = W.partitionBy(KEY, "_slice").orderBy(POS)
    cut = with_halo(states, F.col(POS), block, before=depth - 1, after=k)
    parts = [*[F.lag("z", i).over(order) for i in range(depth - 1, 0, -1)], F.col("z")]
    ahead = {name: F.lead(column, k).over(order) for name, column in (
        ("target", "z"), ("target_bins", "bins"), ("target_mask", "mask"))}
    pairs = cut.withColumns({"x": F.concat(*parts), **ahead}).filter("_own").drop("_own", "_slice")
    return pairs.filter(F.col("x").isNotNull() & F.col("target").isNotNull())


def _partial_gram(batches):
    """One task's sum of (1, x, target) outer products."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x, y = (np.array(batch.column(c).flatten()).reshape(batch.num_rows, -1) for c in ("x", "target"))
            full = np.hstack([np.ones((len(x), 1)), x, y])
            total = full.T @ full if total is None else total + full.T @ full
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["cells"])


def _sum_cells(batches) -> np.ndarray | None:
    total = None
    for batch in batches:
        for row in batch.column("cells"):
            cells = np.asarray(row.values)
            total = cells.copy() if total is None else total + cells
    return total


def gram(rows: DataFrame, lanes: int = 16) -> DataFrame:
    """Sum of (1, x, target) outer products over all rows as one row ``cells``, through a tree of array sums.

    A task reduces its rows to one matrix, ``lanes`` tasks add those up, one adds ``lanes`` matrices of fixed size.
    """
    def added(batches):
        if (total := _sum_cells(batches)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["cells"])

    kind = "cells array<double>"
    lanes_ = rows.select("x", "target").mapInArrow(_partial_gram, kind).repartition(lanes).mapInArrow(added, kind)
    return lanes_.repartition(1).mapInArrow(added, kind)


def solve_ridge(matrix: np.ndarray, outputs: int, alpha: float = 1.0) -> dict[str, np.ndarray]:
    """Multi-output ridge with a free intercept from a Gram matrix whose last ``outputs`` columns are the targets."""
    n, split = matrix[0, 0], len(matrix) - outputs
    mean = matrix[0] / n
    centred = matrix - n * np.outer(mean, mean)
    xx, xy, yy = centred[1:split, 1:split], centred[1:split, split:], centred[split:, split:]
    weights = np.linalg.solve(xx + alpha * np.eye(split - 1), xy)
    residual = np.diag(yy) - 2 * np.sum(weights * xy, 0) + np.sum(weights * (xx @ weights), 0)
    return {"weights": weights, "intercept": mean[split:] - mean[1:split] @ weights,
            "sigma": np.maximum(np.sqrt(np.maximum(residual / n, 0)), 0.05)}


def ridge_autoregression(history: DataFrame, outputs: int, alpha: float = 1.0) -> dict[str, np.ndarray]:
    """Multi-output ridge from rows with ``x`` (inputs) and ``target`` (outputs), both arrays.

    A task solves the normal equations too (workers compute in one thread each); the driver gets the parameters.
    """
    names = ("weights", "intercept", "sigma")

    def solved(batches):
        total = _sum_cells(batches)
        if total is not None:
            size = int(round(len(total) ** 0.5))
            found = solve_ridge(total.reshape(size, size), outputs, alpha)
            yield pa.RecordBatch.from_arrays([pa.array([found[n].ravel()], pa.list_(pa.float64())) for n in names], names=names)

    row = gram(history).mapInArrow(solved, ", ".join(f"{n} array<double>" for n in names)).first()
    if row is None:
        raise ValueError("no rows to fit")
    found = {n: np.array(row[n]) for n in names}
    return found | {"weights": found["weights"].reshape(-1, outputs)}
