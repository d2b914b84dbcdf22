"""Embedding whitening: principal components from float32, corrected to double precision by matrix multiplications.

Covariance. Vectors become whole numbers x = floor(scale * c). The fit list holds each distinct x once. One pass counts and
sums it, a second adds the products of x less the rounded mean: all sums are whole numbers of any size, so the
covariance is exact until it is rounded once (to the widest float of numpy). Tasks send one array each; a level of
``LANES`` tasks adds them before the driver does, so d * d numbers meet the driver ``LANES`` times at most.

Eigenvectors. ``numpy.linalg.eigh`` solves the float32 covariance. Rounds of Ogita and Aishima's refinement then take
R = I - X'X and S = X'AX in the wide float, and correct X by X(I + E), where E_ij = (S_ij + l_j R_ij) / (l_j - l_i) for
eigenvalues that are further apart than what R and S leave open, and R_ij / 2 otherwise. Eigenvalues that stay closer
form clusters: their columns span the right space but may be turned inside it. For each cluster the shifted block
X_c'AX_c - mI is solved on its own, scaled to its spread, and its columns are turned; the next rounds go on from
there. Rounds end when corrections stop falling.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are left out, and so are vectors of
another length than most have (of equally frequent lengths the longer stays). Repeated rows give a result each and
count once in the fit list. Components beyond the range of a long saturate. Where an eigenvalue is zero (constant
dimensions, fewer distinct vectors than components) its whitened values are null, as they have no scale; with one
distinct vector all are. Deviations beyond 38 digits are null. Where eigenvalues are equal the components are one basis of their
space. An empty table gives an empty result. The vector column stays; other columns pass through, and one named like an
added column (in any case) is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import fresh, materialise, replaced, ship
from netloom.llm.vector_codes import whole_vectors

ship(__name__)

SCALE, COMPONENTS = 256, 4
LANES = 32  # tasks that add up the arrays of all other tasks
ROUNDS = 30  # refinement rounds at most; 3 to 6 are usual
WIDE = np.longdouble


@dataclass(frozen=True)
class Fitted:
    """``points``: the fit list (x); ``count`` and ``sums`` of it; ``vectors`` (d, k) unit columns; eigen``values`` falling;
    ``explained`` shares of the trace; ``scaled``: vectors over the roots of their values (NaN where the value is zero)."""
    points: DataFrame
    count: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    scaled: np.ndarray


def folded(rows: DataFrame, kind: T.DataType, task: Callable[[Iterable[pa.RecordBatch]], list | None],
           merge: Callable[[list, list], list]) -> list | None:
    """One array from all rows: ``task`` reduces a task's batches, ``merge`` joins two of its results."""
    schema, name = T.StructType([T.StructField("part", T.ArrayType(kind))]), "part"
    arrow = pa.list_(pa.string() if isinstance(kind, T.StringType) else pa.float64())

    def reduced(parts: Iterable[list]) -> list | None:
        total = None
        for part in parts:
            total = part if total is None else merge(total, part)
        return total

    def write(total):
        return [pa.RecordBatch.from_arrays([pa.array([total], arrow)], names=[name])] if total is not None else []

    def first(batches):
        yield from write(task(b for b in batches if b.num_rows))

    def second(batches):
        yield from write(reduced(part for b in batches for part in b.column(0).to_pylist()))

    lanes = rows.mapInArrow(first, schema).repartition(LANES).mapInArrow(second, schema)
    return reduced(r[0] for r in lanes.collect())


def add(a: list[str], b: list[str]) -> list[str]:
    """Sums of whole numbers of any size, as decimal text."""
    return [str(int(x) + int(y)) for x, y in zip(a, b)]


def numbers(column: pa.Array, width: int) -> np.ndarray:
    return np.array(column.flatten()).reshape(len(column), width)


def gram(y: np.ndarray) -> np.ndarray:
    """Exact Y'Y of whole numbers, as Python integers."""
    top = int(np.abs(y).max(initial=0)) if y.dtype != object else max((abs(v) for v in y.ravel()), default=0)
    if top * top * len(y) < 1 << 52:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    exact = y.astype(object)
    return exact.T @ exact


def less(x: np.ndarray, times: int, minus: list[int]) -> np.ndarray:
    """times * x - minus: in 64 bits where that is safe, with Python integers otherwise."""
    top = int(max(-int(x.min()), int(x.max()))) if x.size else 0
    if top * times + max(map(abs, minus), default=0) < 1 << 62:
        return x * times - np.array(minus, np.int64)
    return x.astype(object) * times - np.array(minus, object)


def covariance(points: DataFrame, length: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, covariance in the wide float) of the fit list."""
    def sums(batches):
        total = None
        for b in batches:
            x = numbers(b.column(0), length)
            got = [len(x), *(x.sum(0, dtype=object) if len(x) else [])]
            total = got if total is None else [p + int(q) for p, q in zip(total, got)]
        return None if total is None else [str(v) for v in total]

    n, *sums_ = map(int, folded(points, T.StringType(), sums, add) or [0] + [0] * length)
    middle = [(2 * s + n) // (2 * n) if n else 0 for s in sums_]  # rounded means
    upper = np.triu_indices(length)

    def products(batches):
        total = None
        for b in batches:
            got = gram(less(numbers(b.column(0), length), 1, middle))[upper]
            total = got if total is None else total + got
        return None if total is None else [str(v) for v in total]

    cells = folded(points, T.StringType(), products, add) or ["0"] * len(upper[0])
    rest = [s - n * m for s, m in zip(sums_, middle)]  # what rounding the means left
    a = np.zeros((length, length), WIDE)
    for i, j, cell in zip(*upper, cells):
        a[i, j] = a[j, i] = WIDE(str(n * int(cell) - rest[i] * rest[j])) / WIDE(str(n * n)) if n else 0
    return n, sums_, a


def norm2(m: np.ndarray) -> float:
    return float(np.linalg.norm(m.astype(float), 2)) if m.size else 0.0


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Groups of two or more positions whose values follow each other within ``gap``."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One round of refinement: (vectors, eigenvalues, largest correction, distance under which eigenvalues are open)."""
    r = np.eye(len(a), dtype=WIDE) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # unequal rounding of mirrored entries would grow by 1 / gap and break orthogonality
    values = np.diag(s) / (1 - np.diag(r))
    open_ = 2 * (norm2(s - np.diag(values)) + norm2(a) * norm2(r))
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > open_
    e = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
    return x + x @ e, values, float(np.abs(e).max(initial=0)), open_


def turned(a: np.ndarray, x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Columns of one cluster, turned by the eigenvectors of its shifted and scaled block."""
    block = x[:, group].T @ (a @ x[:, group])
    block = (block + block.T) / 2
    block = block - np.trace(block) / len(group) * np.eye(len(group), dtype=WIDE)
    spread = np.abs(block).max()
    if spread == 0:
        return x
    x = x.copy()
    x[:, group] = x[:, group] @ np.linalg.eigh((block / spread).astype(float))[1].astype(WIDE)
    return x


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors in columns) of a symmetric wide matrix, from its float32 solution."""
    top = np.abs(a).max(initial=0)
    if top == 0:
        return np.zeros(len(a), WIDE), np.eye(len(a), dtype=WIDE)
    a = a / top
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    least, stuck = np.inf, 0
    for _ in range(ROUNDS):
        x, values, change, open_ = refined(a, x)
        for group in clusters(values, open_):
            x = turned(a, x, group)
        least, stuck = (change, 0) if change < least / 2 else (least, stuck + 1)
        if change < np.finfo(WIDE).eps or stuck == 3:
            break
    x = x @ (1.5 * np.eye(len(a), dtype=WIDE) - x.T @ x / 2)
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt(np.einsum("ij,ij->j", x, x))[order]
    heaviest = np.abs(x).argmax(0)
    return values[order] * top, x * np.where(x[heaviest, np.arange(len(a))] < 0, -1, 1)


def fit(vectors: DataFrame, vector_col: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> Fitted:
    whole, usable, length = whole_vectors(vectors, vector_col, scale)
    points = materialise(usable.select(whole.alias("x")).distinct(), "whitening-points")
    n, sums, a = covariance(points, length)
    values, x = eigen(a)
    values, x = values[:components], x[:, :components]
    trace = np.trace(a) if length else WIDE(0)
    noise = len(a) * 4 * np.finfo(WIDE).eps * (values[0] if length else 0)
    sound = values > noise
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = np.where(sound, x / np.sqrt(np.where(sound, values, 1)), np.nan).astype(float)
        explained = np.where(sound, values / trace, 0).astype(float) if trace > 0 else np.zeros(len(values))
    return Fitted(points, n, sums, x.astype(float), np.where(sound, values, 0).astype(float), explained, scaled)


def projected(x: np.ndarray, fitted: Fitted) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - sums, whitened values)."""
    off = less(x, fitted.count, fitted.sums)
    return off, (off.astype(float) / max(fitted.count, 1)) @ fitted.scaled


def _plain(fitted: Fitted) -> Fitted:
    """What workers need of it."""
    return Fitted(None, *[getattr(fitted, f) for f in ("count", "sums", "vectors", "values", "explained", "scaled")])


def whiten(vectors: DataFrame, fitted: Fitted, vector_col: str = "embedding", scale: int = SCALE,
           whitened: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """Add ``whitened`` (one value per component) and ``deviation``, the exact squared length of n * x - sums."""
    whole, usable, _ = whole_vectors(vectors, vector_col, scale)
    x_col = fresh(vectors, "whole")
    rest, schema = replaced(usable.withColumn(x_col, whole), **{
        whitened: T.ArrayType(T.DoubleType()), deviation: T.DecimalType(38, 0)})
    out, length, plain = T.StructType([f for f in schema.fields if f.name != x_col]), len(fitted.sums), _plain(fitted)

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            off, values = projected(numbers(batch.column(x_col), length), plain)
            if off.dtype != object and float(np.abs(off).max(initial=0)) ** 2 * length < 2.0 ** 62:
                squares = pa.array((off * off).sum(1)).cast(pa.decimal128(38, 0))
            else:
                exact = [sum(int(v) ** 2 for v in row) for row in off]
                squares = pa.array([Decimal(v) if v < 10 ** 38 else None for v in exact], pa.decimal128(38, 0))
            flat = pa.array(values.ravel(), pa.float64(), mask=np.isnan(values.ravel()))
            width = values.shape[1]
            made = {deviation: squares,
                    whitened: pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), flat)}
            yield pa.RecordBatch.from_arrays([made[f] if f in made else batch.column(f) for f in out.names], names=out.names)

    return rest.mapInArrow(run, out)


def identity_error(fitted: Fitted) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance less the identity (None without components)."""
    plain, length = _plain(fitted), len(fitted.sums)
    sound = ~np.isnan(fitted.scaled).any(0) if fitted.scaled.size else np.zeros(fitted.scaled.shape[1], bool)
    k = int(sound.sum())
    if k == 0:
        return None

    def merge(a: list[float], b: list[float]) -> list[float]:
        """Join (count, means, products about the means)."""
        n, m, total = a[0], b[0], a[0] + b[0]
        gap = np.subtract(b[1:k + 1], a[1:k + 1])
        return [total, *(np.array(a[1:k + 1]) + gap * (m / total)),
                *(np.add(a[k + 1:], b[k + 1:]) + (np.outer(gap, gap) * (n * m / total)).ravel())]

    def task(batches):
        total = None
        for b in batches:
            w = projected(numbers(b.column(0), length), plain)[1][:, sound]
            mean = w.mean(0)
            part = [float(len(w)), *mean, *((w - mean).T @ (w - mean)).ravel()]
            total = part if total is None else merge(total, part)
        return None if total is None else [float(v) for v in total]

    total = folded(fitted.points, T.DoubleType(), task, lambda a, b: [float(v) for v in merge(a, b)])
    return float(np.abs(np.reshape(total[k + 1:], (k, k)) / total[0] - np.eye(k)).max())
