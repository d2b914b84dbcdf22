"""Ordered look-back that never needs one whole key in one task.

A single host, channel or session may hold a large share of all rows, so a plain window over it
would sort that share in one task. Two exact forms cut a key into blocks:

* ``look_back``: any ordering; keys with many rows are cut at row ranks (``row_blocks``). Rows deep
  inside a block are finished there, the few rows near a border in a small second window.
* ``with_halo``: contiguous integer positions; rows near an edge are copied into the next block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 1_000_000
#: All keys together are cut at no more borders than this, so the border table may be broadcast.
MAX_BORDERS = 16_384
#: Sampled rows per block. The share of a block of m sampled rows varies by about 1 / sqrt(m).
POINTS = 64


def _at_most(borders: Column, x: Column) -> Column:
    """Number of sorted ``borders`` that do not exceed ``x``, by halving: the plain form of ``_count_borders`` for one expression."""
    state = F.struct(F.lit(0).alias("lo"), F.size(borders).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.element_at(borders, F.least(middle + 1, F.size(borders))) <= x
        return F.when(s["lo"] >= s["hi"], s).when(right, F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
            F.struct(s["lo"].alias("lo"), middle.alias("hi")))

    halvings = F.greatest(F.ceil(F.log2(F.size(borders) + 1)).cast("int"), F.lit(1))
    return F.aggregate(F.sequence(F.lit(1), halvings), state, step, lambda s: s["lo"])


def _count_borders(df: DataFrame, out: str) -> DataFrame:
    """Add the number of sorted ``_borders`` that do not exceed ``_spot``, by halving (0 where there are none).

    One plain expression per halving, so that all of it is generated code; a higher-order function would be interpreted.
    """
    df = df.withColumn(out, F.lit(0))
    for step in reversed([1 << i for i in range(MAX_BORDERS.bit_length() + 1)]):  # hash samples may hold twice as many
        below = F.get("_borders", F.col(out) + (step - 1)) <= F.col("_spot")
        df = df.withColumn(out, F.when(below, F.col(out) + step).otherwise(F.col(out)))
    return df


def row_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = BLOCK_ROWS, out: str = "_block") -> DataFrame:
    """Add a block number that does not decrease along ``order`` and holds about ``rows`` rows of a key.

    Only keys with more rows than that are cut. Their borders are every ``POINTS``-th of the rows that a
    hash of ``order`` picks, so they follow row ranks however many rows share a time, and are the same on
    every layout and retry. ``order`` must end with a column that tells the rows of a key apart. Blocks grow
    beyond ``rows`` where all keys together would need more than ``MAX_BORDERS`` of them: the border table,
    of that many short rows at most, is all that is broadcast. ``_cut`` tells whether the key has borders.
    """
    held = F.xxhash64(*[F.col(k) for k in keys]).alias("_held")  # keys that share a hash share borders: still exact
    spot = F.struct(*[F.col(c) for c in order])
    sizes = df.select(held).groupBy("_held").agg(F.count(F.lit(1)).alias("_n"))
    size = F.greatest(F.lit(rows), F.ceil(sizes.agg(F.sum("_n")).scalar() / MAX_BORDERS))
    many = sizes.filter(F.col("_n") > size).select(
        "_held", F.greatest(F.floor(size / POINTS), F.lit(1)).alias("_rate"))
    picked = df.select(held, spot.alias("_spot")).join(F.broadcast(many), "_held").filter(
        F.pmod(F.xxhash64("_spot", F.lit(1)), F.col("_rate")) == 0)
    points = picked.groupBy("_held").agg(F.sort_array(F.collect_list("_spot")).alias("_points"))
    borders = points.select("_held", F.filter("_points", lambda x, i: (i + 1) % POINTS == 0).alias("_borders"))
    found = df.withColumns({"_held": held, "_spot": spot}).join(F.broadcast(borders), "_held", "left")
    return _count_borders(found, out).withColumn("_cut", F.col("_borders").isNotNull()).drop("_held", "_borders", "_spot")


def look_back(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    depth: int,
    values: Callable[[WindowSpec], dict[str, Column]],
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``values(window)`` where each value looks at most ``depth`` rows back within ``keys``.

    A row with at least ``depth`` rows before it in its own block needs nothing else. The others, and the
    last ``depth`` rows of every block, form a small table (2 * depth rows per border) in which each of
    them still finds exactly its predecessors. Keys of one block, nearly all, do not take part in it.

    Both branches read the same columns under the same filters, so Spark shuffles the blocks once: keys that are not cut
    are block -1 instead of carrying a flag, and no condition on the block alone can move below the shuffle.
    """
    inner = W.partitionBy(*keys, "_block").orderBy(*order)
    blocks = row_blocks(df, keys, order, rows)
    ranked = blocks.withColumn("_block", F.when(F.col("_cut"), F.col("_block")).otherwise(-1)).drop("_cut").select(
        "*",
        F.row_number().over(inner).alias("_rn"),
        F.lead(F.lit(1), depth).over(inner).isNull().alias("_last"),
        *[c.alias(n) for n, c in values(inner).items()],
    )
    helper = ("_block", "_rn", "_last")
    block = F.col("_block")
    deep = ranked.filter((F.col("_rn") > depth) | (block <= 0)).drop(*helper)
    edge = ranked.filter(((F.col("_rn") <= depth) & (block > 0)) | (F.col("_last") & (block >= 0)))
    outer = W.partitionBy(*keys).orderBy(*order)
    names = list(values(outer))
    finished = (
        edge.drop(*names)
        .select("*", *[c.alias(n) for n, c in values(outer).items()])
        .filter((F.col("_rn") <= depth) & (F.col("_block") > 0))
        .drop(*helper)
    )
    return deep.unionByName(finished)


def with_halo(df: DataFrame, position: Column, block: int, before: int = 0, after: int = 0) -> DataFrame:
    """Copy rows into every block whose frames reach them; ``_own`` marks the original copy.

    A frame of ``rows(-before, after)`` over ``(key, _slice)`` is then exact for owned rows,
    provided positions are contiguous inside the key.
    """
    own = F.floor(position / F.lit(block)).cast("bigint")
    first = F.floor((position - F.lit(after)) / F.lit(block)).cast("bigint")
    last = F.floor((position + F.lit(before)) / F.lit(block)).cast("bigint")
    return (
        df.withColumn("_home", own)
        .withColumn("_slice", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
        .withColumn("_own", F.col("_slice") == F.col("_home"))
        .drop("_home")
    )
