"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact confirmation, components.

1. Every text becomes the set of its word shingles (64-bit hashes), a 128-bit digest of that set, and ``BANDS`` x ``ROWS``
   minima of multiply-shift hash functions, folded into one key per band. At the threshold itself a pair shares no band
   with probability (1 - 0.8^5)^40 = 1.3e-7.
2. Equal sets form classes; only their representatives (smallest doc_id) go on, so copies cost one row each.
3. First round: every band key with several members links each member with the key's pivot (its smallest id). Pairs
   whose signatures cannot belong to similar sets are dropped, the others are confirmed on their full sets, and
   alternating large-star and small-star turns the links into components.
4. Second round: only keys whose members, the pivot left out, are still in different components matter, and of keys with
   the same members one. The members of the largest component meet the others, and the others each other, in blocks of
   about ``BLOCK``; a task compares two blocks by one matrix product and returns the links that join components, so no
   pairs are emitted. Nothing is capped: after this round every pair that shares a band key has been compared or lies in
   one component already.

Texts are not shuffled, and only sets of candidates are; pairs, bands and links are narrow. Joins whose keys can be hot (a pivot, a band
key, the centre of a star) are plain sort-merge joins of stored tables, which adaptive execution splits.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; texts with fewer words than a
shingle are one shingle; texts of any length are used whole; rows that repeat a doc_id are equal documents if their
sets are equal, and otherwise one document with several texts, linked by either (each row keeps its own n_shingles); a
null doc_id is linked with nothing and is its own component (null); an empty table gives an empty result; extra columns
are not used by ``components`` and pass through ``dedup``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import fresh, kept, materialise, pieces, release, ship
from netloom.llm.lines import filter_bits, suspected, twice_seen

ship(__name__)

BANDS, ROWS = 40, 5
BLOCK = 256
SPLIT = 32  # hash parts of a pivot's members
#: Signatures of 200 minima: a pair at 0.8 agrees on fewer than 60 % of them with probability below 1e-10.
LEAST_AGREEMENT = 0.6


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of every word, A-Z lower-cased."""
    found = data.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, in order (all words, if there are fewer)."""
    size = min(size, len(hashes))
    if size == 0:
        return hashes
    n = len(hashes) - size + 1
    out = np.full(n, np.uint64(size), np.uint64)
    for i in range(size):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + n])
    return out


def functions() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(20_240_501))
    n = BANDS * ROWS
    return draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, n, np.uint64)


def minima(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least (a x + b) mod 2^64, upper half, per function."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(items), 2048):
        hashed = items[start:start + 2048, None] * a[None, :] + b[None, :]
        np.minimum(out, (hashed.min(axis=0) >> np.uint64(32)).astype(np.uint32), out=out)
    return out


def sign(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest, signature, bands) of every text; the last three are null for empty sets."""
    fields = [docs.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
              T.StructField("signature", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]

    def run(batches):
        a, b = kept("minhash functions", functions)
        salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
        for whole in batches:
            for batch in pieces([whole], "text"):
                counts, digests, signatures, bands = [], [], [], []
                for data in texts_of(batch):
                    items = np.unique(shingles(word_hashes(data), size))
                    counts.append(len(items))
                    if len(items) == 0:
                        digests.append(None), signatures.append(None), bands.append(None)
                        continue
                    low = minima(items, a, b)
                    key = salt.copy()
                    for column in low.reshape(BANDS, ROWS).T:
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + column)
                    digests.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                    signatures.append(low.astype(np.uint8).tobytes())
                    bands.append(key.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def id_hashes(data: bytes) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(data)], np.uint64)


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, items): the shingle sets of the documents in stored ``ids`` (doc_id), from the whole texts.

    Documents are chosen by a Bloom filter of bounded size, so no text is shuffled; the few others that pass do no harm.
    """
    bits = filter_bits(ids.count())
    table = docs.sparkSession.sparkContext.broadcast(
        twice_seen(ids.select(F.col("doc_id").cast("string").alias("text")), bits, id_hashes, "once"))
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("items", T.BinaryType())])

    def run(batches):
        for whole in batches:
            for batch in pieces([whole], "text"):
                keys = [b"" if x is None else str(x).encode() for x in batch.column("doc_id").to_pylist()]
                chosen = suspected(table.value, np.concatenate([id_hashes(k) for k in keys]))
                items = [np.unique(shingles(word_hashes(data), size)) for data in texts_of(batch.filter(pa.array(chosen)))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in items], pa.binary()),
                     pa.array([x.tobytes() for x in items], pa.binary())], names=["digest", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, schema).select(F.xxhash64("digest").alias("id"), "items")


def star(edges: DataFrame, small: bool) -> DataFrame:
    """Stored result of one large-star or small-star step on stored distinct edges (u, v), u > v, which it deletes."""
    turned = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(turned.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least")
    met = turned.join(least, "u")
    moved = met.filter("v <> m" if small else "v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    done = materialise(moved.filter("u > v").distinct(), "star-small" if small else "star-large")
    release(least)
    release(edges)
    return done


def connect(links: DataFrame) -> DataFrame:
    """Components of links (u, v): stored rows (id, component) of every linked id but the roots."""
    edges = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .filter("u > v").distinct(), "star-edges")
    before = None
    while True:
        edges = star(star(edges, small=False), small=True)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = state


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (pivot, member, part) whose full sets are similar, as links (u, v). Each member's set goes to its pivots."""
    members = pairs.join(sets.withColumnRenamed("id", "member"), "member")
    pivots = (pairs.select(F.col("pivot").alias("of"), F.col("part").alias("slice")).distinct()
              .join(sets.select(F.col("id").alias("of"), F.col("items").alias("own")), "of"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        own = np.frombuffer(right["own"].iloc[0], np.uint64)
        hits = [m for m, items in zip(left["member"], left["items"]) if similar(np.frombuffer(items, np.uint64), own, percent)]
        return pd.DataFrame({"u": hits, "v": [int(right["of"].iloc[0])] * len(hits)}, dtype="int64")

    return members.groupBy("pivot", "part").cogroup(pivots.groupBy("of", "slice")).applyInPandas(run, "u bigint, v bigint")


def compare_blocks(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Similarity of all members of two blocks: one incidence product over the items they share."""
    sizes_l, sizes_r = (np.array([len(x) for x in side]) for side in (left, right))
    values_l, values_r = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(values_l, values_r)
    both = np.zeros((len(left), len(right)))

    def places(values, sizes):
        at = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
        hit = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        return np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]

    (row_l, at_l), (row_r, at_r) = places(values_l, sizes_l), places(values_r, sizes_r)
    for start in range(0, len(shared), 8192):
        width = min(8192, len(shared) - start)
        a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        for grid, row, at in ((a, row_l, at_l), (b, row_r, at_r)):
            use = (at >= start) & (at < start + width)
            grid[row[use], at[use] - start] = 1
        both += a @ b.T
    return 100 * both >= percent * (sizes_l[:, None] + sizes_r[None, :] - both)


def joining(group: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between members of different components in one cell (two blocks of one key), as few as connect them."""
    left, right = (group[group["side"] == s].reset_index(drop=True) for s in (0, 1))
    if not len(right):
        right = left
    if not len(left) or len(set(left["component"]) | set(right["component"])) < 2:
        return []
    near = compare_blocks(*[[np.frombuffer(x, np.uint64) for x in side["items"]] for side in (left, right)], percent)
    root: dict[int, int] = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x
    out = []
    for i, j in zip(*np.nonzero(near & (left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :]))):
        a, b = top(left["component"][i]), top(right["component"][j])
        if a != b:
            root[a] = b
            out.append((int(left["id"][i]), int(right["id"][j])))
    return out


def open_keys(members: DataFrame) -> DataFrame:
    """Keys whose members (key, id, component) lie in several components: key, big (the component with most members),
    n_big, n_other. Of keys with the same members one is enough."""
    counts = members.groupBy("key", "component").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"))
    keys = counts.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("big"), F.max("n").alias("n_big"),
        F.sum("n").alias("n"), F.sum("h").alias("h"), F.count("*").alias("parts")).filter("parts > 1")
    one = keys.groupBy("n", "h").agg(F.min(F.struct("key", "big", "n_big")).alias("k"))
    return one.select("k.*", (F.col("n") - F.col("k.n_big")).alias("n_other"))


def rest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that the first round could not see, among the members (key, id, component) of open keys.

    Members of the largest component meet only the others, in cells of two blocks; the others also meet each other.
    """
    keys = materialise(open_keys(members), "near-open")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    is_big = F.col("component") == F.col("big")
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.when(is_big, blocks("n_big")).otherwise(blocks("n_other"))).cast("int")
    cell = lambda kind, a, b, side: F.struct(
        F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), side.cast("int").alias("side"))
    at = F.col("block")
    with_others = F.transform(numbers("n_other"), lambda i: cell(0, F.least(at, i), F.greatest(at, i), at > i))
    cells = F.when(is_big, F.transform(numbers("n_other"), lambda i: cell(1, i, at, F.lit(1)))).otherwise(
        F.concat(with_others, F.transform(numbers("n_big"), lambda i: cell(1, at, i, F.lit(0)))))
    placed = members.join(keys, "key").withColumn("block", own).select("key", "id", "component", F.inline(cells))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(joining(group, percent), columns=["u", "v"]).astype("int64")

    return placed.join(sets, "id").groupBy("key", "kind", "a", "b").applyInPandas(run, "u bigint, v bigint")


def components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    A stored table is deleted as soon as the tables made from it are stored.
    """
    wide = materialise(sign(docs, size), "near-signed")
    present = wide.filter("doc_id is not null and digest is not null")
    # One doc_id can carry several sets; classes are told apart by a number of their own.
    classes = materialise(present.groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.min_by(F.struct("signature", "bands"), "doc_id").alias("s"))
        .select("digest", "doc_id", F.xxhash64("digest").alias("id"), "s.signature", "s.bands"), "near-classes")
    signed = materialise(wide.select("doc_id", "n_shingles", "digest"), "near-digests")
    release(wide)
    known = signed.filter("doc_id is not null and digest is not null")
    bands = classes.select("id", F.explode("bands").alias("key"))
    pivots = materialise(bands.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
                         .select("key", "pivot"), "near-pivots")
    met = materialise(bands.join(pivots, "key"), "near-met")  # every member of a key with several
    release(pivots)
    pairs = (met.filter("id <> pivot").select("pivot", F.col("id").alias("member")).distinct()
             .withColumn("part", F.pmod(F.xxhash64("member", F.lit(5)), F.lit(SPLIT)).cast("int")))
    signature = classes.select("id", "signature")
    agree = _agreement(pairs.join(signature.select(F.col("id").alias("member"), F.col("signature").alias("a")), "member")
                       .join(signature.select(F.col("id").alias("pivot"), F.col("signature").alias("b")), "pivot"))
    likely = materialise(agree, "near-likely")
    own = materialise(classes.select("digest", "doc_id", "id"), "near-own")
    release(classes)
    wanted = materialise(own.join(met.select("id").distinct(), "id", "left_semi").select("doc_id").distinct(), "near-wanted")
    sets = materialise(sets_of(docs, wanted, size), "near-sets")
    release(wanted)
    # Classes that share a doc_id are one document.
    shared = (known.select("doc_id", F.xxhash64("digest").alias("id")).distinct())
    twin = (shared.groupBy("doc_id").agg(F.min("id").alias("v"), F.max("id").alias("top")).filter("v < top")
            .join(shared, "doc_id").select(F.col("id").alias("u"), "v"))
    first = materialise(confirm(likely, sets, percent).union(twin), "near-links")
    release(likely)
    roots = connect(first)
    release(first)

    def labelled(ids: DataFrame, roots: DataFrame) -> DataFrame:
        return ids.join(roots, "id", "left").withColumn("component", F.coalesce("component", "id"))

    # A pivot has been compared with all members of its keys.
    members = materialise(labelled(met.filter("id <> pivot").select("key", "id"), roots), "near-members")
    release(met)
    more = materialise(rest(members, sets, percent), "near-more")
    release(members)
    release(sets)
    if more.limit(1).count():
        earlier = roots
        roots = connect(earlier.select(F.col("id").alias("u"), F.col("component").alias("v")).union(more))
        release(earlier)
    release(more)
    named = materialise(labelled(own, roots), "near-named")
    release(roots)
    release(own)
    smallest = materialise(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "near-smallest")
    names = materialise(named.join(smallest, "component").select("digest", "component_id"), "near-names")
    release(named)
    release(smallest)
    out = (signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
           .join(names, "digest", "left"))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                      F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _agreement(pairs: DataFrame) -> DataFrame:
    """Signature verification: keep (pivot, member, part) that agree on enough minima."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, -1) for c in "ab")
            near = pa.array((a == b).mean(axis=1) >= LEAST_AGREEMENT)
            yield batch.select(["pivot", "member", "part"]).filter(near)

    return pairs.mapInArrow(run, "pivot bigint, member bigint, part int")


def dedup(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component; rows that repeat a kept doc_id become one row."""
    kept_ids = materialise(components(docs, size, percent).filter("kept and doc_id is not null")
                           .select(F.col("doc_id").alias("kept_id")).distinct(), "near-kept")
    stays = docs.join(kept_ids, docs["doc_id"] == F.col("kept_id"), "left_semi")
    # Of rows that share a doc_id the one with the least text stays (then the least hash of the row), so reruns agree.
    whole = F.struct(F.col("text"), F.xxhash64(*[F.col(c) for c in docs.columns if not isinstance(docs.schema[c].dataType, T.MapType)]))
    order = W.partitionBy("doc_id").orderBy(whole)
    at = fresh(docs, "row")
    stays = stays.withColumn(at, F.row_number().over(order)).filter(F.col(at) == 1).drop(at)
    return stays.unionByName(docs.filter(F.col("doc_id").isNull()))
