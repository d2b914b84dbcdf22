"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Every dimension of a block of candidates is a list sorted by value; a query reads it from its good end (descending for a
positive weight, ascending for a negative one). After each round of reads all lists stand at one depth, and

* a candidate's upper bound takes its value where its list has shown it and the list's last read value elsewhere,
* its lower bound takes the list's worst value elsewhere,
* nobody unseen can beat the sum of the last read values.

A query stops as soon as no outsider can reach its k-th lower bound; the few that still can are the ones whose final
scores are resolved, in whole numbers. A list's last read value f turns "seen or not" into max(x, f) or min(x, f), so the
bounds of all queries and candidates of a block are two matrix products. Blocks are read one after the other, and the
k-th score of earlier blocks counts as a lower bound in later ones.

Work is dealt as (block of queries, block of candidates); a query sends k rows per candidate block to the final ranking.

Defined results: vectors that are null, empty, or hold a null, NaN or infinite component take no part; only vectors of
equal length are compared; vec_id names a row: rows with the query's own vec_id are not its candidates, repeated rows
of one vec_id and vector count once, and rows with a null vec_id take no part; ties go to the smaller vec_id; empty
tables give empty results; other columns are not used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.llm.common import materialise, ship

ship(__name__)

QUERY_ROWS, BLOCK_ROWS = 2048, 16384  # rows of a query block and of a candidate block, on average
CHUNK = 2048  # candidates whose lists are read together
DEPTHS = (0.3, 0.4, 0.5, 0.65, 1.0)  # shares of the lists read by the end of each round
EXACT = 2.0 ** 52


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): components floor(scale * x) as whole numbers in doubles."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.col(vector_col).isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.filter(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False)))
            .select(F.col(id_col).cast("bigint").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v")))


def resolve(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whole-number inner products; sums beyond the exact range of doubles are taken with Python's integers."""
    if np.abs(query) @ np.abs(rows).max(axis=0, initial=0) < EXACT:
        return (rows @ query).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(query, r)) for r in rows], np.int64)


def frontier(columns: np.ndarray, depth: float) -> tuple[np.ndarray, np.ndarray]:
    """Last values read from the good ends of ascending sorted ``columns``: (descending lists, ascending lists)."""
    read = min(len(columns), max(1, int(np.ceil(depth * len(columns)))))
    return columns[-read], columns[read - 1]


def bounds(gain: np.ndarray, loss: np.ndarray, x: np.ndarray, columns: np.ndarray, depth: float):
    """(lower, upper) per query and candidate, once the lists of x are read to ``depth``. gain, loss: weights > 0, < 0."""
    high, low = frontier(columns, depth)
    upper = gain @ np.maximum(x, high).T + loss @ np.minimum(x, low).T
    lower = (gain @ np.where(x >= high, x, columns[0]).T + loss @ np.where(x <= low, x, columns[-1]).T)
    return lower, upper


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of every query among ``rows``."""
    best = [[] for _ in query_ids]  # (-score, id), ascending, at most k
    for start in range(0, len(ids), CHUNK):
        x, own = rows[start:start + CHUNK], ids[start:start + CHUNK]
        columns = np.sort(x, axis=0)
        open_queries = np.arange(len(query_ids))
        for depth in DEPTHS:
            q = queries[open_queries]
            lower, upper = bounds(np.maximum(q, 0), np.minimum(q, 0), x, columns, depth)
            other = own[None, :] != query_ids[open_queries][:, None]
            lower = np.where(other, lower, -np.inf)
            floor = np.array([-best[i][k - 1][0] if len(best[i]) >= k else -np.inf for i in open_queries], float)
            if x.shape[0] >= k:
                floor = np.maximum(floor, np.partition(lower, -k, axis=1)[:, -k])
            # Bounds are sums of rounded products once values are huge: leave room for that.
            able = other & (upper + 1e-9 * np.abs(upper) >= floor[:, None])
            few = able.sum(axis=1) <= (4 * k if depth < 1 else len(own))
            for j in np.flatnonzero(few):
                i, chosen = open_queries[j], np.flatnonzero(able[j])
                scores = resolve(queries[i], x[chosen])
                found = sorted(zip((-scores).tolist(), own[chosen].tolist()))[:k] if len(chosen) <= 4 * k else \
                    [(-int(scores[o]), int(own[chosen[o]])) for o in np.lexsort((own[chosen], -scores))[:k]]
                best[i] = sorted(best[i] + found)[:k]
            open_queries = open_queries[~few]
            if len(open_queries) == 0:
                break
    return [(int(i), c, -s) for i, found in zip(query_ids, best) for s, c in found]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) from frames (vec_id, v)."""
    rows = materialise(vectors.distinct(), "topk-vectors")
    asked = materialise(queries.distinct(), "topk-queries")
    n, m = rows.count(), asked.count()
    blocks, parts = -(-n // BLOCK_ROWS) or 1, -(-m // QUERY_ROWS) or 1
    deal = lambda df, count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.select("vec_id", "v", F.size("v").alias("d"), deal(rows, blocks).alias("b"), each(parts).alias("p"))
    right = asked.select("vec_id", "v", F.size("v").alias("d"), deal(asked, parts).alias("p"), each(blocks).alias("b"))

    def run(candidates: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(wanted):
            out = search(wanted["vec_id"].to_numpy(), np.stack(wanted["v"]), candidates["vec_id"].to_numpy(),
                         np.stack(candidates["v"]), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    key = ["d", "b", "p"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
