"""Exact order statistics and prefix sums without one global sort task.

Values are first grouped, so a score shared by a third of all rows is one row. Bounded
``percentile_approx`` sketches then give bucket borders, for the groups with many values; sums run inside a bucket and bucket
totals (at most ``buckets`` rows per group) carry the offsets. Only the borders are approximate,
so they affect balance and never results. No step gathers a group: rows meet on (group, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.scalars import stable_uniform

BUCKETS = 64
#: Groups of up to so many values are one bucket.
BUCKET_ROWS = 100_000
#: At most so many groups are cut into buckets, so their borders may be broadcast.
MAX_CUT = 8_192


def bucketed(df: DataFrame, by: Sequence[str], value: str, weights: Sequence[str], buckets: int = BUCKETS,
             rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``_bucket``: a non-decreasing function of ``value`` with even buckets per group.

    Without groups there is one set of borders. With groups only those of more than ``rows`` rows are cut (more than a
    ``MAX_CUT``-th of all rows, if that is more): a group's borders are looked up by a hash of its key in a small
    broadcast table, so groups are not shuffled together. Sketches and counts look at the weights too, so that
    they read the same columns as the later passes and Spark reuses one shuffle of the grouped values for all of them.
    """
    points = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    weight = F.greatest(*[F.col(w) for w in weights], F.lit(0))
    sketch = F.percentile_approx(F.when(weight > 0, F.col(value)), points, F.lit(20 * buckets)).alias("_borders")
    if by:
        held = F.xxhash64(*[F.col(k) for k in by]).alias("_held")  # groups that share a hash share borders: still exact
        keyed = df.select("*", held)
        sizes = keyed.groupBy("_held").agg(F.count(weight).alias("_n"))
        least = F.greatest(F.lit(rows), F.ceil(sizes.agg(F.sum("_n")).scalar() / MAX_CUT))
        many = sizes.filter(F.col("_n") > least).select("_held")
        borders = keyed.join(F.broadcast(many), "_held", "left_semi").groupBy("_held").agg(sketch)
        joined = keyed.join(F.broadcast(borders), "_held", "left")
    else:
        joined = df.withColumn("_borders", df.agg(sketch).scalar())
    below = F.size(F.filter("_borders", lambda b: b < F.col(value)))
    return joined.withColumn("_bucket", F.when(F.col("_borders").isNull(), F.lit(0)).otherwise(below)).drop("_borders", "_held")


def cumulate(df: DataFrame, by: Sequence[str], value: str, weights: Sequence[str], *,
             descending: bool = False, buckets: int = BUCKETS, rows: int = BUCKET_ROWS) -> DataFrame:
    """Per (group, value) row: ``cum_w`` (running, inclusive) and ``total_w`` of every weight.

    ``df`` must hold one row per (group, value). Groups may be NULL.
    """
    cut = bucketed(df, by, value, weights, buckets, rows)
    way = F.desc if descending else F.asc
    before = W.partitionBy(*by).orderBy(way("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    totals = cut.groupBy(*by, "_bucket").agg(*[F.sum(w).alias(w) for w in weights])
    offsets = totals.select(
        *[F.col(k).alias(f"_of_{k}") for k in by], F.col("_bucket").alias("_of"),
        *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"_off_{w}") for w in weights],
        *[F.sum(w).over(whole).alias(f"total_{w}") for w in weights],
    )
    inside = W.partitionBy(*by, "_bucket").orderBy(way(value)).rowsBetween(W.unboundedPreceding, 0)
    out = cut.withColumns({f"_run_{w}": F.sum(w).over(inside) for w in weights})
    meets = F.col("_bucket") == F.col("_of")
    for k in by:
        meets = meets & out[k].eqNullSafe(F.col(f"_of_{k}"))
    out = out.join(offsets if by else F.broadcast(offsets), meets)  # without groups: one row per bucket
    out = out.withColumns({f"cum_{w}": F.col(f"_run_{w}") + F.col(f"_off_{w}") for w in weights})
    return out.drop("_bucket", "_of", *[f"_of_{k}" for k in by], *[f"_run_{w}" for w in weights], *[f"_off_{w}" for w in weights])


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float],
              buckets: int = BUCKETS, rows: int = BUCKET_ROWS) -> DataFrame:
    """Exact linear-interpolation quantiles, one ``q`` array per group (NULLs ignored). Without groups there is always one
    row; without values it has ``n`` 0 and NULLs in ``q``.

    Every distinct value knows the ranks it covers, so it emits only the requested quantiles it
    takes part in: at most two short rows per quantile and group reach the last aggregate.
    """
    return quantiles_of_counts(value_counts(df, by, value), by, value, qs, buckets, rows)


def quantiles_of_counts(counts: DataFrame, by: Sequence[str], value: str, qs: Sequence[float],
                        buckets: int = BUCKETS, rows: int = BUCKET_ROWS) -> DataFrame:
    """``quantiles`` of values that are counted already: one row per (group, value) with its number ``n``."""
    ranked = cumulate(counts, by, value, ["n"], buckets=buckets, rows=rows)
    points = F.array(*[F.lit(float(q)) for q in qs])
    start, end = F.col("cum_n") - F.col("n"), F.col("cum_n")

    def covers(rank: Column) -> Column:
        return (rank >= start) & (rank < end)

    def spot(i: Column) -> Column:
        return F.element_at(points, i) * (F.col("total_n") - 1)

    wanted = F.filter(F.sequence(F.lit(1), F.lit(len(qs))),
                      lambda i: covers(F.floor(spot(i))) | covers(F.ceil(spot(i))))
    held = ranked.withColumn("_i", F.explode(wanted)).withColumn("_spot", spot(F.col("_i")))
    low, high = F.floor("_spot"), F.ceil("_spot")
    ends = held.groupBy(*by, "_i").agg(
        F.max(F.when(covers(low), F.col(value))).alias("_lo"), F.max(F.when(covers(high), F.col(value))).alias("_hi"),
        F.max("_spot").alias("_spot"), F.max("total_n").alias("n"))
    blend = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_spot") - F.floor("_spot"))
    packed = F.array_sort(F.collect_list(F.struct("_i", blend.alias("v"))))
    found = ends.groupBy(*by).agg(F.max("n").alias("n"), F.transform(packed, lambda x: x["v"]).alias("q"))
    if by:
        return found
    none = F.array_repeat(F.lit(None).cast(found.schema["q"].dataType.elementType), len(qs))
    return found.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(F.size("q") > 0, F.col("q")).otherwise(none).alias("q"))


def order_statistic(df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """The r-th smallest value per group; each rank is an expression over ``total_n``."""
    ranked = cumulate(value_counts(df, by, value), by, value, ["n"])
    picks = [F.min(F.when(F.col("cum_n") >= r, F.col(value))).alias(name) for name, r in ranks.items()]
    return ranked.groupBy(*by).agg(F.max("total_n").alias("n"), *picks)


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, chosen by key hash: each task keeps its own best ``n``."""
    u = stable_uniform([F.col(k) for k in keys], seed)
    return df.orderBy(u, *keys).limit(n)
