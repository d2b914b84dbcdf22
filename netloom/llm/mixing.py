"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

Targets. Every source asks for a share of all words in proportion to its weight and stops at ``max_epochs`` times its
own size. The excess goes to the others by weight, again and again, until none is above its cap: the result is
``min(cap, level * weight)`` for one common level. Each round is one small aggregate; two numbers reach the driver.

Sampling. A source whose target is r times its size takes every document floor(r) times and the documents with the
smallest seeded md5 once more, up to the document at which the remaining words are nearest. Totals per 1/4096 of the
md5 range find the slice that the border falls into, so only that slice of a source is ever put in order.

Defined results: null or blank text has size 0; null is a source of its own; repeated rows are repeated documents (rows
of one doc_id are taken alike); a null doc_id counts as an id; a source without words has target 0 and its rows are
taken 0 words (``mix`` drops them); an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.llm.common import fresh, join_small, materialise, same, words

MAX_EPOCHS = 3
SEED = "mix-1"
SLICE = 3  # hex digits: 4096 slices


def by_rank(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Give the sources, by code point and null last, the weights in turn. One row per source is put in order."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to rows (source_size, weight > 0)."""
    cap, weight = F.col("source_size") * F.lit(max_epochs), F.col("weight")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = cap < F.lit(level) * weight
        now, held, open_weight = sources.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)).cast("double"),
            F.coalesce(F.sum(F.when(~over, weight)), F.lit(0.0))).first()
        if now == full or open_weight == 0:
            break
        full, level = now, (total - held) / open_weight
    if not math.isfinite(level):
        raise ValueError("weights must be positive and finite")
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * weight))


def _draw(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"/{seed}")))


def plan(docs: DataFrame, weigh=by_rank, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(sizes, sources): stored rows (doc_id, source, size) and per source its size, target, whole epochs and border.

    A document is taken ``epochs`` times, and once more if its md5 is at most ``border``.
    """
    sizes = materialise(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size")), "mix-sizes")
    totals = materialise(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = materialise(
        water_fill(materialise(weigh(totals), "mix-weights"), max_epochs)
        .withColumn("epochs", F.floor(ratio).cast("int"))
        .withColumn("goal", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("key", same(F.col("source"))), "mix-targets")

    drawn = sizes.select(same(F.col("source")).alias("key"), _draw(F.col("doc_id"), seed).alias("draw"), "size")
    slices = (drawn.groupBy("key", F.substring("draw", 1, SLICE).alias("slice")).agg(F.sum("size").alias("held"))
              .join(sources.filter("goal > 0").select("key", "goal"), "key"))
    upto = F.sum("held").over(Window.partitionBy("key").orderBy("slice"))
    border = materialise(slices.withColumn("before", upto - F.col("held"))
                         .filter((F.col("before") < F.col("goal")) & (F.col("before") + F.col("held") >= F.col("goal"))
                                 & (F.col("held") > 0)), "mix-slices")
    inside = (join_small(drawn, border.select("key", "slice", "before", "goal"), "key")
              .filter(F.substring("draw", 1, SLICE) == F.col("slice"))
              .groupBy("key", "slice", "before", "goal", "draw").agg(F.sum("size").alias("size")))
    middle = (F.col("before") + F.sum("size").over(Window.partitionBy("key").orderBy("draw")) - F.col("size") / 2)
    cut = (inside.withColumn("middle", middle).groupBy("key", "slice")
           .agg(F.max(F.when(F.col("middle") < F.col("goal"), F.col("draw"))).alias("last"))
           .select("key", F.coalesce("last", "slice").alias("border")))
    return sizes, materialise(sources.join(cut, "key", "left").na.fill({"border": ""}), "mix-plan")


def repetitions(doc_id: Column, seed: str = SEED) -> Column:
    return F.col("epochs") + F.when(_draw(doc_id, seed) <= F.col("border"), 1).otherwise(0)


def decisions(docs: DataFrame, weigh=by_rank, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, repeats."""
    sizes, sources = plan(docs, weigh, max_epochs, seed)
    looked_up = sources.select("key", "source_size", "target", "epochs", "border")
    return (join_small(sizes.withColumn("key", same(F.col("source"))), looked_up, "key")
            .select("doc_id", "source", "size", "source_size", "target",
                    repetitions(F.col("doc_id"), seed).alias("repeats")))


def mix(docs: DataFrame, weigh=by_rank, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    _, sources = plan(docs, weigh, max_epochs, seed)
    key, times = fresh(docs, "mix_key"), fresh(docs, "mix_times")
    lookup = sources.filter("source_size > 0").select(
        F.col("key").alias(key), F.struct("epochs", "border").alias(times))
    draw = _draw(F.col("doc_id"), seed)
    taken = F.coalesce(F.col(f"{times}.epochs") + F.when(draw <= F.col(f"{times}.border"), 1).otherwise(0), F.lit(0))
    joined = join_small(docs.withColumn(key, same(F.col("source"))), lookup, key)
    return (joined.withColumn(times, F.explode(F.array_repeat(F.lit(1), taken))).select(*docs.columns))
