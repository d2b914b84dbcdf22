"""Line deduplication: Bloom filters of once-seen and twice-seen hashes, then exact confirmation of suspected repeats.

1. Every task hashes its lines (each key once per document) and fills two filters: hashes seen, and hashes seen again.
   Two pairs merge as (once | once, twice | twice | once & once), which is associative, so fragments of the filters are
   merged by shuffle in slices; no task or driver holds fingerprints of lines.
2. Only the twice-seen filter travels, with at most ``MAX_BITS`` bits (128 MB). It never misses a repeat. Beyond about
   ``MAX_BITS / BITS_PER_LINE`` lines, more lines than the repeated ones pass it: more are shuffled, results stay exact.
3. Suspected keys alone are shuffled and counted as text, with their first occurrence; a key that every document has is
   one row per task. Confirmed keys go back as a broadcast set if their counted rows and bytes are within bounds, and
   otherwise by a join on (key), then on documents.

Defined results: null text is one empty line and comes back as empty text; the empty key is never a repeat; each row
is a document, also where a doc_id repeats; a key that occurs twice in one document counts once; an empty table gives
an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import fresh, materialise, pieces, same, ship

ship(__name__)

BITS_PER_LINE = 16
MIN_BITS, MAX_BITS = 1 << 20, 1 << 30
SLICE_BITS = 1 << 19
FLUSH = 1 << 20  # hashes per fragment
SET_ROWS, SET_BYTES = 200_000, 32 << 20


def keys_of(data: bytes) -> list[bytes]:
    """Line keys: A-Z lower-cased, blank ends stripped (bytes methods touch ASCII only)."""
    return [x.strip() for x in data.lower().split(b"\n")]


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bit places per hash, one row each."""
    mask = np.uint64(bits - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(33)) & mask if bits <= 1 << 31 else hashes >> np.uint64(1) & mask])


def pack(bits: np.ndarray) -> bytes:
    return zstandard.compress(np.packbits(bits).tobytes(), 1) if bits.any() else b""


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8) if data else np.zeros(SLICE_BITS // 8, np.uint8)


def fragments(hashes: np.ndarray, bits: int) -> pd.DataFrame:
    """Filters of these hashes, cut into slices; slices without a bit are left out."""
    distinct, counts = np.unique(hashes, return_counts=True)
    once, twice = np.sort(places(distinct, bits).ravel()), np.sort(places(distinct[counts > 1], bits).ravel())
    rows = []
    for part in np.unique(once // np.uint64(SLICE_BITS)).tolist():
        cut = [np.searchsorted(x, np.array([part * SLICE_BITS, (part + 1) * SLICE_BITS], np.uint64)) for x in (once, twice)]
        filled = []
        for x, (a, b) in zip((once, twice), cut):
            held = np.zeros(SLICE_BITS, bool)
            held[(x[a:b] - np.uint64(part * SLICE_BITS)).astype(np.int64)] = True
            filled.append(pack(held))
        rows.append((int(part), *filled))
    return pd.DataFrame(rows, columns=["part", "once", "twice"])


def merged(group: pd.DataFrame) -> pd.DataFrame:
    once, twice = np.zeros(SLICE_BITS // 8, np.uint8), np.zeros(SLICE_BITS // 8, np.uint8)
    for a, b in zip(group["once"], group["twice"]):
        other = unpack(a)
        twice = twice | unpack(b) | (once & other)
        once = once | other
    return pd.DataFrame({"part": [int(group["part"].iloc[0])], "once": [zstandard.compress(once.tobytes(), 1)],
                         "twice": [zstandard.compress(twice.tobytes(), 1)]})


def filter_bits(lines: int) -> int:
    return int(min(MAX_BITS, max(MIN_BITS, 1 << (BITS_PER_LINE * max(lines, 1) - 1).bit_length())))


def line_hashes(data: bytes) -> np.ndarray:
    """Hash of every distinct key of a text."""
    return np.array([xxhash.xxh3_64_intdigest(k) for k in set(keys_of(data)) if k], np.uint64)


def filter_slices(docs: DataFrame, bits: int, hashes=line_hashes) -> DataFrame:
    """Merged slices (part, once, twice) of the filters of ``hashes`` of each text."""
    def fill(batches):
        held, n = [], 0
        for whole in batches:
            for batch in pieces([whole], "text"):
                found = np.concatenate([np.empty(0, np.uint64), *map(hashes, texts_of(batch))])
                held.append(found)
                n += len(found)
                if n >= FLUSH:
                    yield from frame(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield from frame(np.concatenate(held))

    def frame(hashes):
        rows = fragments(hashes, bits).assign(turn=np.int32(hashes[0] % np.uint64(16)))
        for start in range(0, len(rows), 64):
            yield pa.RecordBatch.from_pandas(rows.iloc[start:start + 64], schema=schema, preserve_index=False)

    schema = pa.schema([("part", pa.int32()), ("once", pa.binary()), ("twice", pa.binary()), ("turn", pa.int32())])
    row = "part int, once binary, twice binary"
    return (docs.select("text").mapInArrow(fill, row + ", turn int")
            .groupBy("part", "turn").applyInPandas(merged, row).groupBy("part").applyInPandas(merged, row))


def gathered(slices: DataFrame, bits: int, kind: str) -> np.ndarray:
    """One filter from its slices."""
    out = np.zeros(bits // 8, np.uint8)
    for part, held in slices.select("part", kind).toLocalIterator():
        at = part * SLICE_BITS // 8
        out[at:at + SLICE_BITS // 8] = unpack(bytes(held))
    return out


def twice_seen(docs: DataFrame, bits: int, hashes=line_hashes, kind: str = "twice") -> np.ndarray:
    """The merged twice-seen (or ``once``-seen) filter of ``hashes`` of each text, as bytes: ``bits`` / 8 for any table."""
    return gathered(filter_slices(docs, bits, hashes), bits, kind)


def suspected(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may have been seen twice."""
    at = places(hashes, len(table) * 8).astype(np.int64)
    hit = (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
    return (hit[0] & hit[1]).astype(bool)


def repeats(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(suspects, repeated): rows (key, doc_id, pos) that pass the filter; stored keys found in ``min_docs`` documents."""
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = filter_bits(lines)
    table = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, bits))
    rest = T.StructType([docs.schema["doc_id"], T.StructField("key", T.BinaryType()), T.StructField("pos", T.LongType())])

    def test(batches):
        for whole in batches:
            for batch in pieces([whole], "text"):
                ids, keys, at = [], [], []
                for i, data in enumerate(texts_of(batch)):
                    first = {}
                    for pos, key in enumerate(keys_of(data)):
                        first.setdefault(key, pos)
                    first.pop(b"", None)
                    ids += [i] * len(first)
                    keys += first
                    at += first.values()
                hit = suspected(table.value, np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64))
                chosen = np.flatnonzero(hit)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(np.array(ids, np.int64)[chosen])),
                     pa.array([keys[j] for j in chosen], pa.binary()), pa.array(np.array(at, np.int64)[chosen])],
                    names=["doc_id", "key", "pos"])

    suspects = docs.select("doc_id", "text").mapInArrow(test, rest)
    counted = suspects.groupBy("key").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "pos")).alias("first"))
    return suspects, materialise(counted.filter(F.col("docs") >= min_docs), "line-repeats")


def dedup_lines(docs: DataFrame, min_docs: int = 2, keep_first: bool = True, counts: bool = False,
                set_rows: int = SET_ROWS) -> DataFrame:
    """``docs`` without the lines whose key is found in at least ``min_docs`` documents.

    ``keep_first`` keeps the occurrence with the smallest (doc_id, line). ``counts`` adds n_lines and n_dropped.
    """
    suspects, repeated = repeats(docs, min_docs)
    n, size = repeated.agg(F.count("*"), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    listed, given = n <= set_rows and size <= SET_BYTES, fresh(docs, "line_keys")
    source, known = docs, None
    if listed:
        known = docs.sparkSession.sparkContext.broadcast(
            {bytes(r.key): (r.first.doc_id, r.first.pos) for r in repeated.toLocalIterator()})
    else:
        of_doc = (suspects.select("key", F.col("doc_id").alias("at")).join(repeated, "key")
                  .groupBy(same(F.col("at")).alias("id")).agg(F.collect_set(F.struct(
                      "key", F.col("first.doc_id").alias("doc_id"), F.col("first.pos").alias("pos"))).alias(given)))
        source = docs.join(of_doc, same(docs["doc_id"]) == F.col("id"), "left").drop("id")
    plain = docs.schema
    more = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())] if counts else []
    text_at = plain.names.index("text")

    def drop(batches):
        for whole in batches:
            for batch in pieces([whole], "text"):
                ids = batch.column("doc_id").to_pylist()
                own = None if listed else batch.column(given).to_pylist()
                texts, lines, gone = [], [], []
                for i, data in enumerate(texts_of(batch)):
                    bad = known.value if listed else {x["key"]: (x["doc_id"], x["pos"]) for x in own[i] or ()}
                    kept = rows = data.split(b"\n")
                    if bad:
                        kept = [x for pos, (x, k) in enumerate(zip(rows, keys_of(data))) if k not in bad
                                or keep_first and bad[k] == (ids[i], pos)]
                    texts.append(b"\n".join(kept))
                    lines.append(len(rows))
                    gone.append(len(rows) - len(kept))
                out = [batch.column(j) for j in range(len(plain.names))]
                out[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
                names = plain.names + [x.name for x in more]
                yield pa.RecordBatch.from_arrays(out + [pa.array(x, pa.int64()) for x in (lines, gone)][:len(more)], names=names)

    return source.mapInArrow(drop, T.StructType([*plain.fields, *more]))
