"""Vector code compression: a codebook per part of the vector, fitted by rounds that norm-of-sum bounds keep short.

Vectors become whole numbers floor(scale * x) and are cut into equal consecutive parts. Each part position has its own
codebook; a round assigns every part to its nearest entry and moves every entry to the mean of its parts. All of it is
exact: distances, sums and means are whole numbers, ties go to the lower index.

Bounds. The codebooks of all rounds are kept (a few hundred entries each). Every part carries the distance to its own
entry and, for each group of entries, a lower bound on the distance to the others of the group, each with the round in
which it was measured. Moved to the present, the own distance grows by at most the entry's net displacement since its
stamp, |c_now - c_then|, and a group's bound shrinks by at most the largest net displacement of its entries: the norm of
a sum of moves, never more than the sum of their norms that accumulated drifts would charge. A part whose own distance
stays under a group's bound cannot go there. What is left is measured: first the own entry, then, exactly, the groups that
may still hold a nearer entry; these get new bounds and stamps. Bounds are stored as whole numbers, rounded to the safe side.

Work. One pass over the vectors a round: it reads the state that the round before has stored and stores its own (shared
folder; the older one is deleted). New sums come from the parts that changed entry, added to one and taken from the other,
summed per task and then per (part, entry); at most parts x entries rows reach the driver, which divides.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are dropped, and so are vectors
of another length than most have (of equally frequent lengths the longer stays). Repeated rows are rows of their own. A
codebook starts from the rows with the smallest ids (then the smallest vectors; null ids come last) and is shorter if
there are fewer rows. Where the length is no multiple of ``parts``, parts differ by one component. Components must lie
within ``LIMIT`` after scaling, so that all sums of squares are exact; others raise an error that says so. An empty table
gives an empty result and empty codebooks. The vector column is left out; other columns pass through every round (select
what you need), and one named like an added column (in any case) is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import fresh, materialise, release, replaced, ship

ship(__name__)

PARTS, ENTRIES, ROUNDS, GROUP = 4, 256, 4, 16
LIMIT = 1 << 24  # largest scaled component: sums of squares of up to 2^12 components stay under 2^63
ROOM = 1e-9  # relative room for the rounding of square roots
FAR = (1 << 31) - 1  # bound of a group without other entries

INTS, BYTES, SHORTS = (T.ArrayType(t()) for t in (T.IntegerType, T.ByteType, T.ShortType))
#: What a part carries: entry now and in the round before; distance to it and its round; per group, bound and its round.
STATE = {"codes": SHORTS, "was": SHORTS, "reach": INTS, "stamp": BYTES, "low": INTS, "stamps": BYTES}
NUMBERS = {SHORTS: np.int16, INTS: np.int32, BYTES: np.int8}


@dataclass(frozen=True)
class Codes:
    """``rows``: the vectors' other columns with ``codes`` and ``error``; ``codebooks``: (entries, width) per part."""
    rows: DataFrame
    codebooks: list[np.ndarray]


def whole_vectors(vectors: DataFrame, vector_col: str, scale: int) -> tuple[Column, DataFrame, int]:
    """(column of whole components, rows whose vectors are finite and of the table's length, that length)."""
    x = F.col(vector_col).cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.filter(F.coalesce(fine, F.lit(False)))
    most = kept.groupBy(F.size(vector_col).alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    length = most["d"] if most else 0
    return F.transform(x, lambda c: F.floor(c * scale)), kept.filter(F.size(vector_col) == length), length


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, entries)."""
    top = 2 * max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if top * top * max(x.shape[1], 1) < 1 << 52:  # whole numbers that doubles hold, in every order of addition
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


def roots(values: np.ndarray, up: bool = False) -> np.ndarray:
    """Whole numbers at most (up: at least) the square roots."""
    r = np.sqrt(values.astype(float))
    return np.ceil(r * (1 + ROOM)) if up else np.floor(r * (1 - ROOM))


def displacement(history: list[np.ndarray]) -> np.ndarray:
    """(stamp, entry): net distance of every entry between the round of the stamp and now, rounded up."""
    return np.stack([roots(((history[-1] - then) ** 2).sum(1), up=True) for then in history])


def assign(x: np.ndarray, history: list[np.ndarray], own: np.ndarray, reach: np.ndarray, stamp: np.ndarray,
           low: np.ndarray, stamps: np.ndarray) -> int:
    """Bring the state of one part up to the newest of ``history``; arrays are changed in place.

    own -1 stands for no entry yet. Returns the number of exact distances taken.
    """
    entries, now = history[-1], len(history) - 1
    groups = [(g, min(g + GROUP, len(entries))) for g in range(0, len(entries), GROUP)]
    moved = displacement(history)
    largest = np.stack([moved[:, a:b].max(1) for a, b in groups], 1)  # (stamp, group)
    first = own < 0
    lower = np.where(first[:, None], -1.0, low - largest[stamps, np.arange(len(groups))])
    upper = np.where(first, np.inf, reach + moved[stamp, np.maximum(own, 0)])
    rows = np.flatnonzero((lower <= upper[:, None]).any(1))
    if len(rows) == 0:
        return 0
    x, lower, before = x[rows], lower[rows], own[rows]
    met = before >= 0
    taken = int(met.sum())
    start = np.full(len(rows), np.iinfo(np.int64).max)
    start[met] = ((x[met] - entries[before[met]]) ** 2).sum(1)
    best, value = np.where(met, before, len(entries)), start.copy()
    look = lower <= np.where(met, np.sqrt(start.astype(float)) * (1 + ROOM), np.inf)[:, None]
    found = []
    for g, (a, b) in enumerate(groups):
        some = np.flatnonzero(look[:, g])
        if len(some):
            d = squared(x[some], entries[a:b])
            at = d.argmin(1)  # the first of equals
            near, at = d[np.arange(len(some)), at], a + at
            better = (near < value[some]) | ((near == value[some]) & (at < best[some]))
            best[some[better]], value[some[better]] = at[better], near[better]
            found.append((g, some, d))
            taken += d.size
    own[rows], reach[rows], stamp[rows] = best, roots(value, up=True), now
    # Whoever left an entry: it is one of the others of its group now. (Where that group is measured, it is counted below.)
    gone = np.flatnonzero(met & (best != before))
    if len(gone):
        r, g = rows[gone], before[gone] // GROUP
        low[r, g] = np.minimum(lower[gone, g], roots(start[gone]))
        stamps[r, g] = now
    for g, some, d in found:
        a, b = groups[g]
        inside = np.flatnonzero((best[some] >= a) & (best[some] < b))
        d[inside, best[some][inside] - a] = np.iinfo(np.int64).max
        low[rows[some], g], stamps[rows[some], g] = np.minimum(roots(d.min(1)), FAR), now
    return taken


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return np.array(column.flatten()).reshape(len(column), width)


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def _round(history: list[list[np.ndarray]], cuts: list[int], x_col: str, state: dict[str, str], schema: T.StructType,
           started: bool, error_col: str | None):
    """The pass of one round; with ``error_col`` it is the last one."""
    groups = -(-len(history[0][0]) // GROUP)
    widths = {"low": groups, "stamps": groups}
    span, parts = list(zip(cuts, cuts[1:])), len(cuts) - 1

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            wide = _numbers(batch.column(x_col), cuts[-1]).astype(np.int64)
            if wide.size and max(int(wide.max()), -int(wide.min())) > LIMIT:
                raise ArithmeticError(f"a vector component exceeds {LIMIT} after scaling; scale the vectors down")
            now = {}
            for k, kind in STATE.items():
                width = parts * widths.get(k, 1)
                now[k] = (_numbers(batch.column(state[k]), width) if started
                          else np.full((n, width), -1 if k in ("codes", "was") else 0, NUMBERS[kind]))
            now["was"] = now["codes"].copy()
            error = np.zeros(n, np.int64)
            for p, (a, b) in enumerate(span):
                at = slice(p * groups, (p + 1) * groups)
                own = now["codes"][:, p].astype(np.int64)
                assign(wide[:, a:b], history[p], own, now["reach"][:, p], now["stamp"][:, p], now["low"][:, at], now["stamps"][:, at])
                now["codes"][:, p] = own
                error += ((wide[:, a:b] - history[p][-1][own]) ** 2).sum(1)
            made = {x_col: _lists(wide.astype(np.int32)), error_col: pa.array(error)}
            made |= {state[k]: _lists(v) for k, v in now.items()}
            yield pa.RecordBatch.from_arrays([made[f] if f in made else batch.column(f) for f in schema.names], names=schema.names)

    return run


def _changes(x_col: str, was_col: str, codes_col: str, cuts: list[int], entries: int):
    """(part, entry, n, s) of one task: how counts and sums change."""
    span = list(zip(cuts, cuts[1:]))
    width = max((b - a for a, b in span), default=0)

    def run(batches):
        n = np.zeros((len(span), entries), np.int64)
        s = np.zeros((len(span), entries, width), np.int64)
        for batch in batches:
            x = _numbers(batch.column(x_col), cuts[-1]).astype(np.int64)
            was, codes = (_numbers(batch.column(c), len(span)).astype(np.int64) for c in (was_col, codes_col))
            for p, (a, b) in enumerate(span):
                moved = was[:, p] != codes[:, p]
                for column, sign in ((codes, 1), (was, -1)):
                    some = np.flatnonzero(moved & (column[:, p] >= 0))
                    np.add.at(n[p], column[some, p], sign)
                    np.add.at(s[p, :, :b - a], column[some, p], sign * x[some, a:b])
        part, entry = np.nonzero((n != 0) | (s != 0).any(2))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)),
                                          pa.array(n[part, entry]), _lists(s[part, entry])], names=["part", "entry", "n", "s"])

    return run, width


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024,
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, codes: str = "codes",
             error: str = "error") -> Codes:
    """Fit codebooks over all vectors and encode all of them: ``codes`` (0-based, one per part) and ``error``, the sum
    of squared distances of the parts to their entries. At most 2^15 entries and 100 rounds."""
    whole, usable, length = whole_vectors(vectors, vector_col, scale)
    cuts = [length * p // parts for p in range(parts + 1)]
    x_col = fresh(vectors, "whole")
    state = {k: fresh(vectors, k) for k in STATE}
    if x_col in (codes, error) or {codes, error} & set(state.values()) - {state["codes"]}:
        raise ValueError("codes and error must not be named like the state")
    base = usable.withColumn(x_col, whole)
    seeds = [r[0] for r in base.orderBy(F.col(id_col).asc_nulls_last(), x_col).limit(entries).select(x_col).collect()]
    seeds = np.array(seeds, np.int64).reshape(len(seeds), length)
    history = [[seeds[:, a:b]] for a, b in zip(cuts, cuts[1:])]
    counts = [np.zeros(len(seeds), np.int64) for _ in history]
    sums = [np.zeros_like(h[0]) for h in history]
    current, stored = base.drop(vector_col), False
    kept = [f for f in current.schema.fields if f.name != x_col and f.name.lower() not in (codes.lower(), error.lower())]
    carried = T.StructType([*kept, T.StructField(x_col, INTS), *[T.StructField(state[k], v) for k, v in STATE.items()]])
    for turn in range(rounds if len(seeds) else 0):
        step = _round(history, cuts, x_col, state, carried, stored, None)
        following = materialise(current.mapInArrow(step, carried), f"codes-{turn}")
        if stored:
            release(current)
        current, stored = following, True
        run, width = _changes(x_col, state["was"], state["codes"], cuts, len(seeds))
        told = (current.filter(F.col(state["was"]) != F.col(state["codes"])).select(x_col, state["was"], state["codes"])
                .mapInArrow(run, "part int, entry int, n bigint, s array<bigint>").groupBy("part", "entry")
                .agg(F.sum("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)])))
        for part, entry, n, s in told.collect():
            counts[part][entry] += n
            sums[part][entry] += np.array(s[:sums[part].shape[1]], np.int64)
        for p, h in enumerate(history):
            used = counts[p] > 0
            h.append(np.where(used[:, None], sums[p] // np.maximum(counts[p], 1)[:, None], h[-1]))
    last = T.StructType([*kept, T.StructField(state["codes"], SHORTS), T.StructField(error, T.LongType())])
    step = _round(history, cuts, x_col, state, last, stored, error)
    done = materialise(current.mapInArrow(step, last), "codes")
    if stored:
        release(current)
    return Codes(done.withColumnRenamed(state["codes"], codes), [h[-1] for h in history])


def decode(rows: DataFrame, codebooks: list[np.ndarray], codes: str = "codes", decoded: str = "decoded", scale: int = 1024) -> DataFrame:
    """Add ``decoded``, the vectors that codes stand for (null codes: null)."""
    rest, schema = replaced(rows, **{decoded: T.ArrayType(T.DoubleType())})

    def run(batches):
        for batch in batches:
            given = batch.column(codes)
            full = given.filter(given.is_valid())
            wide = np.concatenate([book[_numbers(full, len(codebooks))[:, p]] for p, book in enumerate(codebooks)], 1) / scale
            row = iter(wide.tolist())
            out = pa.array([next(row) if ok else None for ok in given.is_valid().to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=schema.names)

    return rest.mapInArrow(run, schema)
