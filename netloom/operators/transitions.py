"""Kill-chain transitions: counted tables, multi-step propagation, next-stage forecasts.

The only driver-side values are model parameters of fixed size (7 x 7 x 7 probabilities).
Counting and scoring run on the windows table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom import vocab
from netloom.functions.scalars import arg_max
from netloom.operators.alerts import KEY, POS

S = vocab.N_STAGES


def _order():
    return W.partitionBy(KEY).orderBy(POS)


def progress(win: DataFrame, context: int, stage: str = "stage_now", out: str = "progress") -> DataFrame:
    """Furthest stage in the last ``context`` windows."""
    return win.withColumn(out, F.max(F.col(stage).cast("int")).over(_order().rowsBetween(-(context - 1), 0)))


def nowcast_progress(win: DataFrame, context: int, nowcast: str = "nowcast", confidence: float = 0.5,
                     out: str = "progress") -> DataFrame:
    """Furthest stage the nowcast was confident about in the context."""
    sure = F.array_max(nowcast) >= confidence
    seen = F.when(sure, arg_max(F.col(nowcast))).otherwise(F.lit(0))
    return win.withColumn(out, F.max(seen).over(_order().rowsBetween(-(context - 1), 0)))


def step_counts(train: DataFrame, context: int) -> DataFrame:
    """Counts of (stage, progress) -> next window's stage; ``split`` marks the counted rows."""
    with_next = progress(train, context).withColumn("next_stage", F.lead("stage_now").over(_order()))
    return with_next.filter((F.col("split") == "train") & F.col("next_stage").isNotNull()).groupBy(
        F.col("stage_now").cast("int").alias("stage"), "progress",
        F.col("next_stage").cast("int").alias("next_stage")).agg(F.count(F.lit(1)).alias("n"))


def prior_table(spark: SparkSession) -> DataFrame:
    """Kill-chain prior with the forward-progress bonus: 7 x 7 x 7 probabilities."""
    base = np.array(vocab.TRANSITION_PRIOR)
    base = base / base.sum(1, keepdims=True)
    rows = []
    for z in range(S):
        for p in range(S):
            lifted = base[z] * np.exp([vocab.FORWARD_BONUS if p >= 1 and s > p else 0.0 for s in range(S)])
            lifted = lifted / lifted.sum()
            rows += [(z, p, s, float(lifted[s])) for s in range(S)]
    return spark.createDataFrame(rows, "stage int, progress int, next_stage int, prior double")


def transition_table(counts: DataFrame, strength: float = 20.0) -> DataFrame:
    """Smoothed P(next stage | stage, progress): counts plus ``strength`` prior pseudo-counts."""
    prior = prior_table(counts.sparkSession)
    keys = ["stage", "progress", "next_stage"]
    mass = F.coalesce("n", F.lit(0)) + F.lit(strength) * F.col("prior")
    return prior.join(counts, keys, "left").withColumn(
        "p", mass / F.sum(mass).over(W.partitionBy("stage", "progress"))).select(*keys, "p")


def propagate(table: DataFrame, horizon: int) -> dict[str, np.ndarray]:
    """Exact k-step forecasts from every (stage, progress) start.

    ``hit[k, z, p]``: probability of a compromise arrival within k steps (being compromised now
    is not an arrival). ``stage[k, z, p, s]``: stage distribution after k steps.
    """
    t = np.zeros((S, S, S))
    for r in table.collect():  # 343 rows by construction
        t[r["stage"], r["progress"], r["next_stage"]] = r["p"]
    reach = np.maximum(np.arange(S)[:, None], np.arange(S)[None, :])  # [p, z'] -> progress
    quiet = (np.arange(S) < vocab.FIRST_COMPROMISE_STAGE).astype(float)
    later, miss = t, np.ones((S, S))
    hits, stages = [], []
    cols = np.arange(S)
    dist = np.broadcast_to(np.eye(S)[:, None, :], (S, S, S))  # stage distribution after 0 steps
    for _ in range(horizon):
        # Value recursion over the first step: after moving to z', continue from (z', max(p, z')).
        cont_miss = miss[cols[None, :], reach]                   # [p, z']
        miss = np.einsum("zps,ps->zp", later * quiet, cont_miss)
        cont_dist = dist[cols[None, :], reach]                   # [p, z', s]
        dist = np.einsum("zpn,pns->zps", later, cont_dist)
        hits.append(1.0 - miss)
        stages.append(dist)
    return {"hit": np.clip(np.array(hits), 0, 1), "stage": np.array(stages)}


def _constant(values: np.ndarray) -> Column:
    """A nested array literal (folded once at planning time)."""
    kind = "array<" * values.ndim + "double" + ">" * values.ndim
    return F.from_json(F.lit(json.dumps(values.tolist())), kind)


def _starts(values: np.ndarray) -> np.ndarray:
    """Re-index [z, p, ...] as [progress, z, ...], starting each z at max(progress, z)."""
    z = np.arange(S)
    return np.array([values[z, np.maximum(z, p)] for p in range(S)])


def _weighted(belief: Column, rows: Column) -> Column:
    """Sum over stages z of belief[z] * rows[z], each row an array over stages."""
    zeros = F.array_repeat(F.lit(0.0), S)
    scaled = F.zip_with(belief, rows, lambda b, row: F.transform(row, lambda v: v * b))
    return F.aggregate(scaled, zeros, lambda acc, row: F.zip_with(acc, row, lambda x, y: x + y))


def rollout_risk(win: DataFrame, forecast: dict[str, np.ndarray], horizons: Sequence[int],
                 belief: str = "nowcast", prog: str = "progress") -> DataFrame:
    """P(compromise within k) per window for each requested k, mixing starts by the nowcast."""
    def risk(k: int) -> Column:
        start = F.element_at(_constant(_starts(forecast["hit"][k - 1])), F.col(prog) + 1)
        return F.aggregate(F.zip_with(F.col(belief), start, lambda b, h: b * h), F.lit(0.0), lambda a, v: a + v)
    return win.withColumns({f"p_within_{k}": risk(k) for k in horizons})


def rollout_steps(win: DataFrame, forecast: dict[str, np.ndarray], horizon: int, belief: str = "nowcast", prog: str = "progress",
                  risk: str = "risk_steps", stage: str = "stage_steps") -> DataFrame:
    """The whole forecast as arrays over steps 1..horizon: P(compromise within k), and the stage distribution at k."""
    hits = _constant(np.array([_starts(forecast["hit"][k]) for k in range(horizon)]))
    stages = _constant(np.array([_starts(forecast["stage"][k]) for k in range(horizon)]))
    at = F.col(prog) + 1
    mixed = lambda start: F.aggregate(
        F.zip_with(F.col(belief), F.element_at(start, at), lambda b, h: b * h), F.lit(0.0), lambda a, v: a + v)
    return win.withColumns({risk: F.transform(hits, mixed),
                            stage: F.transform(stages, lambda start: _weighted(F.col(belief), F.element_at(start, at)))})


def horizon_stage_mass(win: DataFrame, forecast: dict[str, np.ndarray], horizon: int,
                       belief: str = "nowcast", prog: str = "progress", out: str = "stage_mass") -> DataFrame:
    """Expected number of windows spent in each stage over the horizon, as an array."""
    mass = _constant(_starts(forecast["stage"][:horizon].sum(0)))
    return win.withColumn(out, _weighted(F.col(belief), F.element_at(mass, F.col(prog) + 1)))


def step_stage_argmax(win: DataFrame, forecast: dict[str, np.ndarray], horizon: int,
                      belief: str = "nowcast", prog: str = "progress", out: str = "step_stage") -> DataFrame:
    """Most likely attack stage at each step 1..horizon, as an array of stage numbers."""
    steps = _constant(np.array([_starts(forecast["stage"][k]) for k in range(horizon)]))
    best = F.transform(steps, lambda start: arg_max(
        F.slice(_weighted(F.col(belief), F.element_at(start, F.col(prog) + 1)), 2, S - 1)) + 1)
    return win.withColumn(out, best)


# ------------------------------------------------------------------ stage onsets
def onset_counts(win: DataFrame, context: int) -> DataFrame:
    """(stage before, progress before) -> new stage, at stage onsets of training rows, plus one
    pseudo-count for each of the 343 combinations."""
    order = _order()
    before = progress(win, context).withColumns({
        "_stage": F.lag("stage_now").over(order).cast("int"), "_progress": F.lag("progress").over(order)})
    seen = before.filter(F.col("is_stage_onset") & (F.col("split") == "train") & F.col("_stage").isNotNull())
    counted = seen.groupBy(F.col("_stage").alias("stage"), F.col("_progress").alias("progress"),
                           F.col("stage_now").cast("int").alias("next_stage")).agg(F.count(F.lit(1)).alias("n"))
    grid = win.sparkSession.range(S * S * S).select(
        F.floor(F.col("id") / (S * S)).cast("int").alias("stage"),
        (F.floor(F.col("id") / S) % S).cast("int").alias("progress"), (F.col("id") % S).cast("int").alias("next_stage"))
    keys = ["stage", "progress", "next_stage"]
    return grid.join(counted, keys, "left").select(*keys, (F.coalesce("n", F.lit(0)) + 1).alias("n"))


def onset_rows(counts: DataFrame) -> DataFrame:
    """One row per (stage, progress): the counts over next stages as an array (49 rows)."""
    packed = F.array_sort(F.collect_list(F.struct("next_stage", "n")))
    return counts.groupBy("stage", "progress").agg(F.transform(packed, lambda x: x["n"].cast("double")).alias("row"))


def exclude(weights: Column, current: Column) -> Column:
    """Zero the benign stage and, if an attack is on, the current stage."""
    return F.transform(weights, lambda v, i: F.when((i == 0) | ((current > 0) & (i == current)), 0.0).otherwise(v))


def normalised(weights: Column) -> Column:
    total = F.greatest(F.aggregate(weights, F.lit(0.0), lambda a, v: a + v), F.lit(1e-12))
    return F.transform(weights, lambda v: v / total)


def blend(mass: Column, row: Column, weight: float) -> Column:
    """mass^w * row^(1-w), with both floored at 1e-6."""
    def log_floor(v: Column) -> Column:
        return F.log(F.greatest(v, F.lit(1e-6)))
    return F.zip_with(mass, row, lambda m, r: F.exp(weight * log_floor(m) + (1 - weight) * log_floor(r)))


def next_stage(win: DataFrame, counts: DataFrame, weight: float, mass: str = "stage_mass",
               current: str = "current", prog: str = "progress") -> DataFrame:
    """Distribution of the next new attack stage: rollout mass blended with the onset table."""
    table = onset_rows(counts).withColumn("row", normalised(F.col("row")))
    reached = F.greatest(F.col(prog), F.col(current))
    keyed = _lookup(win, table, F.col(current), reached, "row")
    probs = normalised(exclude(blend(F.col(mass), F.col("row"), weight), F.col(current)))
    return keyed.withColumn("next_probs", probs).drop("row").withColumns({
        "heading_to": arg_max(F.col("next_probs")), "heading_to_p": F.array_max("next_probs")})


def _lookup(win: DataFrame, table: DataFrame, stage: Column, prog: Column, out: str) -> DataFrame:
    """Add the table row at (stage, progress). The table has 49 rows, so it is broadcast."""
    small = table.select(F.col("stage").alias("_s"), F.col("progress").alias("_q"), F.col("row").alias(out))
    keyed = win.withColumns({"_s": stage.cast("int"), "_q": prog.cast("int")})
    return keyed.join(F.broadcast(small), ["_s", "_q"], "left").drop("_s", "_q")


def transition_accuracy(forecast: DataFrame, counts: DataFrame, lead: int) -> DataFrame:
    """Top-1 accuracy of the next new stage at test onsets, forecast ``lead`` windows earlier.

    ``forecast`` needs stage_now, is_stage_onset, split, nowcast, progress and stage_mass.
    """
    order = _order()
    cur = arg_max(F.col("nowcast"))
    table = onset_rows(counts)
    marginal = counts.groupBy("next_stage").agg(F.sum("n").alias("n")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("next_stage", "n"))), lambda x: x["n"].cast("double"))
        .alias("row")).scalar()
    anchors = forecast.withColumns({
        "_cur": cur, "_truth": F.lead("stage_now", lead).over(order).cast("int"),
        "_onset": F.lead("is_stage_onset", lead).over(order),
        "_stage": F.col("stage_now").cast("int"),
    }).filter(F.col("_onset") & (F.col("split") == "test"))
    looked = _lookup(anchors, table, F.col("_stage"), F.col("progress"), "_row")

    def right(weights: Column, current: Column) -> Column:
        return (arg_max(exclude(weights, current)) == F.col("_truth")).cast("double")

    return looked.withColumn("_marginal", marginal).agg(
        F.count(F.lit(1)).alias("n_transitions"),
        F.avg(right(F.col("stage_mass"), F.col("_cur"))).alias("model"),
        F.avg(right(F.col("_row"), F.col("_stage"))).alias("markov"),
        F.avg((arg_max(F.transform(exclude(F.col("_marginal"), F.lit(0)),
                                   lambda v, i: F.when(i == F.col("_stage"), 0.0).otherwise(v)))
               == F.col("_truth")).cast("double")).alias("marginal"))


def predictor_comparison(forecast: DataFrame, counts: DataFrame, lead: int,
                         weights: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Top-1 accuracy of every next-stage predictor at test onsets, in one pass."""
    order = _order()
    table = onset_rows(counts)
    anchors = forecast.withColumns({
        "_cur": arg_max(F.col("nowcast")), "_truth": F.lead("stage_now", lead).over(order).cast("int"),
        "_onset": F.lead("is_stage_onset", lead).over(order), "_stage": F.col("stage_now").cast("int"),
    }).filter(F.col("_onset") & (F.col("split") == "test"))
    own = _lookup(anchors, table, F.col("_cur"), F.greatest("progress", "_cur"), "_row")
    both = _lookup(own, table, F.col("_stage"), F.greatest("progress", "_stage"), "_true_row")
    cur, stage = F.col("_cur"), F.col("_stage")
    wm = normalised(exclude(F.col("stage_mass"), cur))
    tab = normalised(exclude(F.col("_row"), cur))

    def hit(w: Column) -> Column:
        return F.avg((arg_max(w) == F.col("_truth")).cast("double"))

    ready = both.withColumns({"_wm": wm, "_tab": tab})
    blends = {f"blend_{int(100 * w)}": hit(F.transform(
        blend(F.col("_wm"), F.col("_tab"), w), lambda v, i: F.when(i == 0, 0.0).otherwise(v))) for w in weights}
    return ready.agg(
        F.count(F.lit(1)).alias("n"), hit(F.col("_wm")).alias("wm"), hit(F.col("_tab")).alias("table_now"),
        hit(exclude(F.col("_true_row"), stage)).alias("markov_true"),
        *[c.alias(n) for n, c in blends.items()],
        F.avg((cur == stage).cast("double")).alias("current_stage_correct"))


def attack_step_accuracy(forecast: DataFrame, horizon: int) -> DataFrame:
    """Share of future attack windows whose stage the forecast, or the carried nowcast, names.

    Needs ``step_stage`` (from ``step_stage_argmax``) and ``nowcast`` on test anchors.
    """
    carried = arg_max(F.slice("nowcast", 2, S - 1)) + 1
    anchors = forecast.filter(F.col("split") == "test").select(
        KEY, POS, carried.alias("carried"), F.posexplode("step_stage").alias("k", "named"))
    future = forecast.filter(F.col("stage_now") > 0).select(
        KEY, F.col(POS).alias("_at"), F.col("stage_now").cast("int").alias("truth"))
    steps = anchors.withColumn("_at", F.col(POS) + F.col("k") + 1).join(future, [KEY, "_at"])
    return steps.agg(
        F.count(F.lit(1)).alias("n_attack_steps"),
        F.avg((F.col("named") == F.col("truth")).cast("double")).alias("model"),
        F.avg((F.col("carried") == F.col("truth")).cast("double")).alias("nowcast_carried_forward"))
