"""Attack snippets, benign backgrounds, and campaigns injected from a plan table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.config import EngineConfig
from netloom.functions.scalars import in_networks, stage_index, window_index
from netloom.operators.blocked import BLOCK_ROWS, look_back


def snippets(flows: DataFrame, gap: float = 300.0, max_len: float = 900.0, min_flows: int = 3,
             block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Attack bursts of one stage, cut at pauses and at ``max_len``.

    Returns (table, members): one row per snippet, and the flows inside it. The pause before a
    flow is found in blocks of rows; numbering runs over (second-level) burst starts only, so a
    capture full of attack flows never becomes one sort.
    """
    keys = ["capture", "stage"]
    attack = flows.filter("is_attack")
    order = ["ts", "flow_id"]
    marked = look_back(attack, keys, order, 1, lambda w: {"_prev": F.lag("ts").over(w)}, block_rows)
    starts = marked.filter(F.col("_prev").isNull() | (F.col("ts") - F.col("_prev") > gap)).select(
        *keys, F.col("ts").alias("t0"), "_prev")
    last = attack.groupBy(*keys).agg(F.max("ts").alias("_last"))
    order_t0 = W.partitionBy(*keys).orderBy("t0")
    spans = starts.withColumns({
        "snippet": F.row_number().over(order_t0) - 1, "_stop": F.lead("_prev").over(order_t0),
    }).join(last, keys).select(
        *keys, "snippet", "t0", F.least(F.coalesce("_stop", "_last"), F.col("t0") + F.lit(float(max_len))).alias("t1"))
    # Burst starts are more than ``gap`` apart; each burst keeps ``max_len`` seconds, cut into slots
    # so that flows meet their burst by an equi join.
    slot = F.lit(float(max_len))
    slotted = spans.withColumn("_slot", F.explode(F.array_distinct(F.array(
        F.floor(F.col("t0") / slot), F.floor((F.col("t0") + slot) / slot)))))
    members = attack.withColumn("_slot", F.floor(F.col("ts") / slot)).join(slotted, [*keys, "_slot"]).filter(
        F.col("ts").between(F.col("t0"), F.col("t1"))).drop("_slot")
    table = members.groupBy(*keys, "snippet", "t0", "t1").agg(
        F.count(F.lit(1)).alias("n_flows"), F.mode("family", True).alias("family"),
    ).filter(F.col("n_flows") >= min_flows)
    return table, members


def with_split(table: DataFrame, spans: DataFrame, seconds: float, time: str = "t0") -> DataFrame:
    """Attach the span (``campaign_split``) of the window a time falls in."""
    keyed = table.withColumn("window", window_index(F.col(time), seconds))
    lookup = spans.select("capture", "window", "campaign_split")
    return keyed.join(lookup, ["capture", "window"], "left").drop("window")


def backgrounds(win: DataFrame, length: float, seconds: float) -> DataFrame:
    """Attack-free stretches of ``length`` seconds inside one session and split.

    Each benign stretch is tiled from its left end. ``win`` needs ``campaign_split``.
    """
    n = int(length // seconds)
    benign = win.filter(F.col("n_attack_flows") == 0)
    keys = ["capture", "session", "campaign_split"]
    order = W.partitionBy(*keys).orderBy("window")
    island = benign.withColumn("_island", F.col("window") - F.row_number().over(order))
    tile = F.floor((F.row_number().over(W.partitionBy(*keys, "_island").orderBy("window")) - 1) / n)
    tiled = island.withColumn("_tile", tile).groupBy(*keys, "_island", "_tile").agg(
        F.min("window").alias("first"), F.count(F.lit(1)).alias("size"))
    return tiled.filter(F.col("size") == n).select(
        "capture", "session", "campaign_split", (F.col("first") * F.lit(float(seconds))).alias("t0"),
        ((F.col("first") + n) * F.lit(float(seconds))).alias("t1"))


def pivot_hosts(members: DataFrame, cidrs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The internal party of each snippet: busiest internal source, else busiest internal target."""
    sides = members.select(*keys, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("src_ip").alias("ip")),
        F.struct(F.lit(1).alias("side"), F.col("dst_ip").alias("ip")))).alias("e")).select(*keys, "e.side", "e.ip")
    counted = sides.filter(in_networks(F.col("ip"), cidrs)).groupBy(*keys, "side", "ip").agg(
        F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(W.partitionBy(*keys).orderBy("side", F.desc("n"), "ip"))
    return counted.withColumn("_r", best).filter("_r = 1").select(*keys, F.col("ip").alias("pivot"))


def _remap(ip: Column, cidrs: Sequence[str]) -> Column:
    """Pivot -> victim; any other internal host -> a pool host fixed by its hash; outsiders stay."""
    others = F.filter("pool", lambda h: h != F.col("victim"))
    pick = F.get(others, F.pmod(F.xxhash64(ip, F.col("campaign")), F.size(others)).cast("int"))
    return (F.when(ip == F.col("pivot"), F.col("victim"))
            .when(in_networks(ip, cidrs), F.when(F.size(others) > 0, pick).otherwise(F.col("victim")))
            .otherwise(ip))


def inject(flows: DataFrame, members: DataFrame, plan: DataFrame, cidrs: Sequence[str],
           slot_seconds: float = 3600.0) -> DataFrame:
    """Campaign flows from a plan: each background's flows plus its shifted, remapped snippets.

    ``plan(campaign, bg_capture, bg_t0, bg_t1, capture, stage, snippet, t0, at, length, victim,
    pool)``: one row per injected snippet. ``pool`` lists the background's internal hosts. Rows
    without a snippet (NULL stage) are benign-only campaigns. The campaign becomes the capture.
    """
    grounds = plan.select("campaign", "bg_capture", "bg_t0", "bg_t1").distinct()
    slot = F.lit(float(slot_seconds))
    spans = grounds.withColumn("_slot", F.explode(F.sequence(
        F.floor(F.col("bg_t0") / slot), F.floor(F.col("bg_t1") / slot)))).withColumnRenamed("bg_capture", "capture")
    base = flows.withColumn("_slot", F.floor(F.col("ts") / slot)).join(spans, ["capture", "_slot"]).filter(
        F.col("ts").between(F.col("bg_t0"), F.col("bg_t1")))
    columns = [c for c in flows.columns if c != "capture"]
    base = base.select(F.col("campaign").alias("capture"), *columns)

    keys = ["capture", "stage", "snippet"]
    used = plan.filter(F.col("stage").isNotNull())
    pivots = pivot_hosts(members, cidrs, keys)
    joined = members.join(used.drop("t0"), keys).filter(F.col("ts") <= F.col("t0") + F.col("length"))
    joined = joined.join(pivots, keys, "left")
    shift = F.col("at") - F.col("t0")
    moved = joined.withColumns({"ts": F.col("ts") + shift, "te": F.col("te") + shift,
                                "src_ip": _remap(F.col("src_ip"), cidrs), "dst_ip": _remap(F.col("dst_ip"), cidrs)})
    return base.unionByName(moved.select(F.col("campaign").alias("capture"), *columns))



def campaign_windows(campaign_flows: DataFrame, cfg: EngineConfig, splits: DataFrame, build) -> DataFrame:
    """Windows of injected campaigns through the ordinary build job, tagged as synthetic."""
    win = build(campaign_flows, cfg)
    return win.join(splits.select(F.col("campaign").alias("capture"), "campaign_split").distinct(), "capture", "left") \
        .withColumn("synthetic", F.lit(True))
