"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Pre-tokenisation. Code points become classes through one lookup array. Over the classes runs an automaton whose every
input is a function from state to state; functions are composed by an associative scan, so a whole batch of texts is cut
without a regular expression. The functions that inputs can compose to are few and numbered in advance, composition is
a lookup in their product table: the scan works on rows of ``WIDTH`` characters at once, then over the row totals. The
automaton reports a boundary one place late where it depends on what follows (the last blank of a run, the second
letter of a contraction).

Merging. Slices go through a cache from slice to ids. Slices not in it are merged together: all of them take their
lowest-ranked pair (leftmost first) once per round; very long ones use a heap of pairs instead.

Offsets. Every id keeps the byte place at which it starts, so decoding copies bytes to known places, whole texts or
any range of tokens.

Defined results: null text is empty text and has no ids; texts of any length are cut and merged whole (a batch is split
between rows only); repeated rows are encoded alike; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import kept, pieces, ship, sources_path

ship(__name__)

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WIDTH = 64  # characters that one row of the scan takes in turn
CACHED = 1 << 18  # slices that a worker's cache holds before it starts anew
LONG = 64  # bytes from which a slice is merged with a heap

# Classes of characters.
SPACE, BLANK, NUMBER, OTHER, QUOTE, SHORT, ELL, ARE_VE, EE, LETTER, END = range(11)
# States: what the running token is. After a quote that starts a token, a contraction may follow.
START, WORD, DIGITS, SIGNS, ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK, QUOTED, QUOTED_L, QUOTED_R, CLOSED = range(12)
HERE, BEFORE = 1, 2  # a token starts at this character; at the one before it


def _step(state: int, kind: int) -> tuple[int, int]:
    """(next state, boundaries)."""
    if kind == END:
        return START, HERE | (BEFORE if state in (QUOTED_L, QUOTED_R) else 0)
    letter = kind in (SHORT, ELL, ARE_VE, EE, LETTER)
    if state == QUOTED and kind == SHORT:
        return CLOSED, 0
    if state == QUOTED and kind in (ELL, ARE_VE):
        return (QUOTED_L if kind == ELL else QUOTED_R), 0
    if state == QUOTED_L and kind == ELL or state == QUOTED_R and kind == EE:
        return CLOSED, 0
    # A quote followed by a letter that opened no contraction: the letter starts a word.
    late, state = (BEFORE, WORD) if state in (QUOTED_L, QUOTED_R) else (0, SIGNS if state == QUOTED else state)
    if kind in (SPACE, BLANK):
        if state in (ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK):
            return (RUN_SPACE if kind == SPACE else RUN_BLANK), late
        return (ONE_SPACE if kind == SPACE else ONE_BLANK), late | HERE
    into = WORD if letter else DIGITS if kind == NUMBER else SIGNS
    if state == into:
        return into, late
    if state == ONE_SPACE:
        return into, late
    if state == RUN_SPACE:
        return into, BEFORE
    start = QUOTED if kind == QUOTE else into
    return start, late | HERE | (BEFORE if state == RUN_BLANK else 0)


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each class, product table, next state by function and state, boundaries by state and class)."""
    of_class = [tuple(_step(s, c)[0] for s in range(12)) for c in range(11)]
    number = {f: i for i, f in enumerate(dict.fromkeys(of_class))}
    queue = list(number)
    while queue:
        f = queue.pop()
        for g in of_class:
            h = tuple(g[s] for s in f)
            if h not in number:
                number[h] = len(number)
                queue.append(h)
    functions = sorted(number, key=number.get)
    product = np.array([[number[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    return (np.array([number[f] for f in of_class], np.uint16), product, np.array(functions, np.uint8),
            np.array([[_step(s, c)[1] for c in range(11)] for s in range(12)], np.uint8))


def _classes() -> np.ndarray:
    """Class of every code point, from its general category and the blanks of the pattern."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
    blanks = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[blanks] = BLANK
    for chars, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", SHORT), ("l", ELL), ("rv", ARE_VE), ("e", EE)):
        out[[ord(c) for c in chars]] = kind
    return out


def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return kept("bpe automaton", _automaton)


def scan(kinds: np.ndarray) -> np.ndarray:
    """State before every character."""
    of_class, product, go, _ = automaton()
    n = len(kinds)
    rows = -(-n // WIDTH)
    f = np.full(rows * WIDTH, of_class[END], np.uint16)
    f[:n] = of_class[kinds]
    f = np.ascontiguousarray(f.reshape(rows, WIDTH).T)
    for i in range(1, WIDTH):
        f[i] = product[f[i - 1], f[i]]
    total, step = f[-1].copy(), 1
    while step < rows:  # inclusive scan over the rows
        total[step:] = product[total[:-step], total[step:]]
        step *= 2
    entry = np.concatenate([[START], go[total[:-1], START]]).astype(np.uint8)
    after = go[f, entry]
    return np.concatenate([entry[None, :], after[:-1]]).T.reshape(-1)[:n]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where tokens start, for code points in which every text ends with the value 0x110000."""
    kinds = np.where(points == 0x110000, END, kept("bpe classes", _classes)[np.minimum(points, 0x10FFFF)]).astype(np.uint8)
    found = automaton()[3][scan(kinds), kinds]
    starts = (found & HERE) > 0
    starts[:-1] |= (found[1:] & BEFORE) > 0
    return starts


class Vocabulary:
    """Token bytes by id, and ids of mergeable pairs."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.size = max(self.ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        get = self.ranks.get
        merges = sorted((get(t[:i]) * self.size + get(t[i:]), r) for t, r in self.ranks.items()
                        for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks)
        self.pair = np.array([m[0] for m in merges], np.int64)
        self.rank = np.array([m[1] for m in merges], np.int64)
        self.cache: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.cache.clear()
        self.ids, self.first, self.count, self.used, self.known = np.empty(1 << 20, np.int32), np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32), 0, 0

    def merge_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or ``size`` where it does not merge."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair, wanted), len(self.pair) - 1)
        return np.where(self.pair[at] == wanted, self.rank[at], self.size)

    def heap_merge(self, data: bytes) -> list[int]:
        """Merge one long slice: a heap of (rank, place) over a linked list."""
        ids, n = [self.ranks[data[i:i + 1]] for i in range(len(data))], len(data)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        rank = lambda i: self.ranks.get(data[i:end[after[i]]]) if after[i] < n else None
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if ids[i] is None or after[i] >= n or end[after[i]] != stop:
                continue
            gone = after[i]
            ids[i], ids[gone], end[i], after[i] = r, None, stop, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0 and (found := rank(j)) is not None:
                    heapq.heappush(heap, (found, j, end[after[j]]))
        return [x for x in ids if x is not None]

    def merge(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slices in turn, number of ids of each)."""
        counts = np.ones(len(slices), np.int64)
        direct = np.array([self.ranks.get(data, -1) for data in slices], np.int64)
        todo = np.flatnonzero(direct < 0)
        short = np.array([i for i in todo.tolist() if len(slices[i]) <= LONG], np.int64)
        long = {i: self.heap_merge(slices[i]) for i in todo.tolist() if len(slices[i]) > LONG}
        together = []
        for start in range(0, len(short), 1 << 16):
            part = short[start:start + (1 << 16)]
            flat, counts[part] = self.merge_together([slices[i] for i in part.tolist()])
            together.append(flat)
        for i, ids in long.items():
            counts[i] = len(ids)
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        out[at[direct >= 0]] = direct[direct >= 0]
        for i, ids in long.items():
            out[at[i]:at[i] + len(ids)] = ids
        if len(short):
            n = counts[short]
            out[np.repeat(at[short] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = np.concatenate(together)
        return out, counts

    def merge_together(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for x in slices])
        ids = self.single[np.frombuffer(b"".join(slices), np.uint8)]
        owner = np.repeat(np.arange(len(slices)), lengths)
        done_ids, done_owner = [], []
        while len(ids):
            joined = owner[:-1] == owner[1:]
            rank = np.full(len(ids), self.size)
            rank[:-1][joined] = self.merge_ranks(ids[:-1][joined], ids[1:][joined])
            starts = np.flatnonzero(np.concatenate([[True], ~joined]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            best = np.repeat(least, sizes)
            at = np.flatnonzero((rank == best) & (best < self.size))
            at = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])] if len(at) else at
            closed = np.repeat(least == self.size, sizes)
            done_ids.append(ids[closed])
            done_owner.append(owner[closed])
            ids[at] = rank[at]
            keep = ~closed
            keep[at + 1] = False
            ids, owner = ids[keep], owner[keep]
        owners = np.concatenate(done_owner)
        return np.concatenate(done_ids)[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(slices))

    def learn(self, slices: list[str]) -> None:
        """Add slices to the cache."""
        found, counts = self.merge([s.encode() for s in slices])
        total = len(found)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.known + len(slices) > len(self.first):
            self.first = np.concatenate([self.first, np.empty_like(self.first)])
            self.count = np.concatenate([self.count, np.empty_like(self.count)])
        self.ids[self.used:self.used + total] = found
        self.first[self.known:self.known + len(slices)] = self.used + np.cumsum(counts) - counts
        self.count[self.known:self.known + len(slices)] = counts
        self.cache.update(zip(slices, range(self.known, self.known + len(slices))))
        self.used, self.known = self.used + total, self.known + len(slices)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each)."""
        whole = "".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        points = np.full(len(whole) + len(texts), 0x110000, np.uint32)
        ends = np.cumsum(sizes + 1) - 1  # a text's end mark
        inner = np.ones(len(points), bool)
        inner[ends] = False
        points[inner] = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.flatnonzero((boundaries(points) & inner)[inner])
        cuts = np.append(starts, len(whole)).tolist()
        slices = [whole[a:b] for a, b in zip(cuts, cuts[1:])]
        if self.known > CACHED:
            self.reset()
        get = self.cache.get
        at = list(map(get, slices))
        new = list(dict.fromkeys(s for s, i in zip(slices, at) if i is None))
        if new:
            self.learn(new)
            at = list(map(get, slices))
        at = np.array(at, np.int64)
        counts = self.count[at].astype(np.int64)
        before = np.cumsum(counts) - counts
        ids = self.ids[np.repeat(self.first[at] - before, counts) + np.arange(counts.sum())]
        edges = np.searchsorted(starts, np.cumsum(sizes) - sizes)  # first slice of each text
        upto = np.append(before, counts.sum())[np.append(edges, len(at))]
        return ids, np.diff(upto)

    def decode(self, ids: np.ndarray, offsets: np.ndarray, size: int) -> bytes:
        """Copy each token's bytes to its place."""
        n = self.lengths[ids]
        out = np.zeros(size, np.uint8)
        turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(offsets, n) + turn] = self.flat[np.repeat(self.starts[ids], n) + turn]
        return out.tobytes()


def vocabulary(path: str) -> Vocabulary:
    return kept(f"bpe {path}", lambda: Vocabulary(path))


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _encoder(path: str):
    def run(batches):
        """Append ids and offsets to batches with a text."""
        known = vocabulary(path)
        for whole in batches:
            for batch in pieces([whole], "text", 1_000_000):
                found, counts = known.encode([x or "" for x in batch.column("text").to_pylist()])
                found = found.astype(np.int32)
                upto = np.cumsum(known.lengths[found]) - known.lengths[found]
                first = np.cumsum(counts) - counts
                base = np.append(upto, 0)[np.minimum(first, len(upto))]
                places = (upto - np.repeat(base, counts)).astype(np.int32)
                yield batch, lists(found, counts), lists(places, counts)
    return run


def _decoded(known: Vocabulary, ids: pa.Array, offsets: pa.Array) -> pa.Array:
    out = []
    for a, b in zip(ids, offsets):
        if not a.is_valid or len(a) == 0:
            out.append(b"")
            continue
        a, b = np.asarray(a.values), np.asarray(b.values).astype(np.int64)
        out.append(known.decode(a, b - b[0], int(b[-1] - b[0] + known.lengths[a[-1]])))
    return pa.array(out, pa.binary())


def _with(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(k, v) for k, v in kinds.items()]])


IDS = T.ArrayType(T.IntegerType())


def encode(docs: DataFrame, path: str | None = None, ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """Add ``ids`` and ``offsets`` (byte at which each id's token starts) to documents (text)."""
    schema, encoder = _with(docs.schema, **{ids: IDS, offsets: IDS}), _encoder(path or sources_path(VOCABULARY))

    def run(batches):
        for batch, found, places in encoder(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, found, places], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", offsets: str = "offsets",
           decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``, the bytes that (ids, offsets) stand for; null ids give no bytes."""
    path, schema = path or sources_path(VOCABULARY), _with(encoded.schema, **{decoded: T.BinaryType()})

    def run(batches):
        known = vocabulary(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, _decoded(known, batch.column(ids), batch.column(offsets))], names=schema.names)

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, ids: str = "ids", offsets: str = "offsets",
               decoded: str = "decoded") -> DataFrame:
    """encode, then decode, in one pass of one worker."""
    path = path or sources_path(VOCABULARY)
    schema, encoder = _with(docs.schema, **{ids: IDS, offsets: IDS, decoded: T.BinaryType()}), _encoder(path)

    def run(batches):
        for batch, found, places in encoder(batches):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, found, places, _decoded(vocabulary(path), found, places)], names=schema.names)

    return docs.mapInArrow(run, schema)


def ids_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)
