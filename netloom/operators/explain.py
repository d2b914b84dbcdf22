"""Explanations of a logistic score: contributions, counterfactuals, deletion and occlusion.

The explained score is ``sigmoid(intercept + sum(weight * x))`` on scaled features, for which
``weight * x`` is the exact path-integral attribution against the all-zero baseline. Input is
long: one row per (anchor, feature[, lag]) with ``value``; ``weights`` has one row per feature
(and lag). Work stays per anchor; nothing pairs anchors with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom import vocab
from netloom.config import EngineConfig
from netloom.functions.scalars import sigmoid, stable_uniform
from netloom.operators.features import assign_windows

ANCHOR = ("session_key", "pos_in_session")


def feature_group(feature: Column) -> Column:
    out = F.lit(None).cast("string")
    for g in vocab.GROUPS:
        out = F.when(feature.isin(*[f.name for f in vocab.FEATURES if f.grp == g]), g).otherwise(out)
    return out


def contributions(long: DataFrame, weights: DataFrame, on: Sequence[str] = ("feature",)) -> DataFrame:
    """Per (anchor, feature) contribution to the logit. Weights have at most one row per input."""
    return long.join(F.broadcast(weights), list(on)).withColumn("contribution", F.col("weight") * F.col("value"))


def top_contributions(contrib: DataFrame, k: int, anchor: Sequence[str] = ANCHOR) -> DataFrame:
    order = W.partitionBy(*anchor).orderBy(F.abs("contribution").desc(), "feature")
    return contrib.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def group_contributions(contrib: DataFrame, anchor: Sequence[str] = ANCHOR) -> DataFrame:
    return contrib.groupBy(*anchor, feature_group(F.col("feature")).alias("grp")).agg(
        F.sum("contribution").alias("contribution"))



def group_counterfactual(contrib: DataFrame, intercept: float, threshold: float, max_groups: int = 4,
                         anchor: Sequence[str] = ANCHOR) -> DataFrame:
    """Feature groups reset one after the other, largest drop first, until the risk is below the
    threshold. For a logistic score the greedy order is the order of group contributions, so a
    running sum replaces the rounds of rescoring."""
    groups = group_contributions(contrib, anchor)
    order = W.partitionBy(*anchor).orderBy(F.desc("contribution"), "grp")
    whole = W.partitionBy(*anchor)
    removed = F.sum("contribution").over(order.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("contribution").over(whole) + F.lit(intercept)
    steps = groups.select(*anchor, "grp", F.row_number().over(order).alias("step"), sigmoid(total).alias("risk"),
                          sigmoid(total - removed).alias("risk_after"))
    done_before = F.coalesce(F.min("risk_after").over(
        W.partitionBy(*anchor).orderBy("step").rowsBetween(W.unboundedPreceding, -1)) < threshold, F.lit(False))
    return steps.withColumn("_done", done_before).filter((F.col("step") <= max_groups) & ~F.col("_done")).drop("_done")


def deletion_test(contrib: DataFrame, intercept: float, k: int = 5, seed: int = 0,
                  anchor: Sequence[str] = ANCHOR) -> DataFrame:
    """Mean risk drop from deleting the k strongest positive features against k hash-chosen ones."""
    best = F.row_number().over(W.partitionBy(*anchor).orderBy(F.desc("contribution"), "feature"))
    draw = F.row_number().over(W.partitionBy(*anchor).orderBy(
        stable_uniform([*[F.col(a) for a in anchor], F.col("feature")], seed), "feature"))
    ranked = contrib.withColumns({"_best": best, "_draw": draw})
    per_anchor = ranked.groupBy(*anchor).agg(
        (F.sum("contribution") + F.lit(intercept)).alias("z"),
        F.sum(F.when(F.col("_best") <= k, F.col("contribution"))).alias("top"),
        F.sum(F.when(F.col("_draw") <= k, F.col("contribution"))).alias("rnd"))
    z = F.col("z")
    drops = per_anchor.agg(
        F.count(F.lit(1)).alias("n"), F.avg(sigmoid(z) - sigmoid(z - F.col("top"))).alias("mean_drop_top"),
        F.avg(sigmoid(z) - sigmoid(z - F.col("rnd"))).alias("mean_drop_random"))
    return drops.withColumn("ratio", F.when(F.abs("mean_drop_random") > 1e-9,
                                            F.col("mean_drop_top") / F.col("mean_drop_random")))


def temporal_occlusion(contrib: DataFrame, intercept: float, block: int = 4, lag: str = "lag",
                       anchor: Sequence[str] = ANCHOR) -> DataFrame:
    """Risk drop when each block of past windows is reset to the baseline."""
    per_block = contrib.groupBy(*anchor, F.floor(F.col(lag) / block).alias("block")).agg(
        F.sum("contribution").alias("part"))
    total = F.sum("part").over(W.partitionBy(*anchor)) + F.lit(intercept)
    return per_block.select(*anchor, "block", (sigmoid(total) - sigmoid(total - F.col("part"))).alias("drop"))


# ------------------------------------------------------------------ hosts
def recent_hosts(flows: DataFrame, targets: DataFrame, cfg: EngineConfig, recent: int = 12,
                 top: int = 8) -> DataFrame:
    """Busiest hosts (either end) of the windows just before each target: the top-k report."""
    span = _flows_near(flows, targets, cfg, recent - 1)
    ends = span.select("target", F.explode(F.array("src_ip", "dst_ip")).alias("host"))
    counted = ends.groupBy("target", "host").agg(F.count(F.lit(1)).alias("recent_flows"))
    order = W.partitionBy("target").orderBy(F.desc("recent_flows"), "host")
    return counted.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top).drop("_r")


def _flows_near(flows: DataFrame, targets: DataFrame, cfg: EngineConfig, before: int) -> DataFrame:
    """Flows in the ``before`` windows up to and including each target window.

    Targets are expanded to their windows, so this is an equi join on (capture, window).
    """
    spans = targets.select("target", "capture", F.col("window").alias("target_window"),
                           F.explode(F.sequence(F.col("window") - before, F.col("window"))).alias("window"))
    return assign_windows(flows, cfg).join(spans, ["capture", "window"])


def host_attribution(flows: DataFrame, targets: DataFrame, cfg: EngineConfig,
                     featurise: Callable[[DataFrame, EngineConfig, Sequence[str]], DataFrame], risk: Column,
                     recent: int = 12, top: int = 8) -> DataFrame:
    """Risk at each target with and without each busy host's recent flows.

    ``targets(target, capture, window)``. Every (target, removed host) pair is one more time line
    for the ordinary feature job; older flows of the host stay. Replication is at most ``top + 1``
    per flow near a target.
    """
    near = _flows_near(flows, targets, cfg, 2 * cfg.context + 1)
    hosts = recent_hosts(flows, targets, cfg, recent, top)
    variants = hosts.select("target", "host").unionByName(
        targets.select("target", F.lit("").alias("host")).distinct())
    is_recent = F.col("window") > F.col("target_window") - recent
    involved = (F.col("src_ip") == F.col("host")) | (F.col("dst_ip") == F.col("host"))
    kept = near.join(variants, "target").filter(~(is_recent & involved))
    series = ["target", "host"]
    at = featurise(kept, cfg, series).join(
        targets.select("target", F.col("window").alias("_w")), "target").filter(F.col("window") == F.col("_w"))
    scored = variants.join(at, series, "left").select(*series, F.coalesce(risk, F.lit(0.0)).alias("risk"))
    base = scored.filter("host = ''").select("target", F.col("risk").alias("base"))
    return (scored.filter("host <> ''").join(base, "target").join(hosts, ["target", "host"])
            .select("target", "host", "recent_flows", F.col("risk").alias("risk_without"),
                    (F.col("base") - F.col("risk")).alias("contribution"), F.col("base").alias("risk")))


FLAGGED_COLUMNS = ("flow_id", "ts", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "duration", "fwd_packets",
                   "bwd_packets", "fwd_bytes", "bwd_bytes", "syn_count", "ack_count", "rst_count", "label", "stage")


def flagged_flows(flows: DataFrame, hosts: DataFrame, targets: DataFrame, cfg: EngineConfig, recent: int = 12,
                  limit: int = 200) -> DataFrame:
    """First flows, by time, of the named hosts before each target (``limit`` per target).

    ``hosts(target, host)``; a flow that matches at both ends is listed once.
    """
    near = _flows_near(flows, targets, cfg, recent - 1)
    ends = near.withColumn("host", F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))))
    hit = ends.join(hosts.select("target", "host"), ["target", "host"], "left_semi")
    listed = hit.dropDuplicates(["target", "flow_id"])
    order = W.partitionBy("target").orderBy("ts", "flow_id")
    return listed.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit).select(
        "target", *[c for c in FLAGGED_COLUMNS if c in flows.columns])
