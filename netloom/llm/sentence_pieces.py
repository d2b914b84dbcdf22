"""SentencePiece encoding and decoding through a table of distinct marked words.

A text becomes one string in which blanks are markers and one marker stands in front. No piece of the vocabulary holds a
marker after another character (checked when it is read), so no merge crosses from a character to a marker: the text
falls into marked words (a run of markers and what follows up to the next marker) that are segmented independently. Each
slice of texts is reduced to its distinct marked words; those the table does not have are segmented once; then the ids
of all words are gathered by position. Every worker has its own table, so nothing is shuffled. The table starts anew
between two slices beyond ``TABLE_WORDS`` words or ``TABLE_CHARS`` characters.

A word is segmented by best-score-first merging (leftmost of equals), long ones (such as texts without blanks) with a heap
over a linked list in n log n. Characters without a piece become their UTF-8 bytes.

Decoding copies the bytes of every piece to its place, puts blanks for markers, drops the marker in front, and turns bytes
that are not UTF-8 into U+FFFD each, as the sentencepiece library does.

Defined results: null text is empty text and has no ids; null ids decode to empty text; texts of any length are encoded
whole; repeated rows are encoded alike; an empty table gives an empty result; other columns pass through, and one that
has the name of an added column (in any case) is replaced by it, as by ``withColumn``.
"""

from __future__ import annotations

import codecs
import heapq
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from netloom.llm.bpe import IDS, lists
from netloom.llm.common import kept, pieces, replaced, ship, sources_path

ship(__name__)

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
TABLE_WORDS, TABLE_CHARS = 1 << 19, 1 << 24  # distinct words and their characters that a worker's table holds
SHORT = 40  # characters up to which a word is segmented by looking at all its pairs
SLICE = 1_000_000  # bytes of text whose words are reduced together
PROBE = "The  quick (brown) föx_jumped\tover 13 日本\n\n  lazy…  dogs  "


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


class Pieces:
    """Pieces by id, merges by score, and the table of distinct marked words."""

    def __init__(self, path: str):
        codecs.register_error("netloom each byte", _each_byte)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.get_piece_size())
        special = {i for i in size if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.of_byte = [-1] * 256
        raw = [b""] * len(size)
        plain = {}
        for i in size:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.of_byte[value], raw[i] = i, bytes([value])
            elif i not in special:
                plain[piece] = i
                raw[i] = piece.replace(MARK, " ").encode()
            elif model.is_unknown(i):
                raw[i] = " ⁇ ".encode()
        if -1 in self.of_byte:
            raise ValueError(f"{path}: not a vocabulary with a piece for every byte")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in plain):
            raise ValueError(f"{path}: pieces cross whitespace markers, marked words are not independent")
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain.values()}, reverse=True))}
        self.single = {p: i for p, i in plain.items() if len(p) == 1}
        self.ranks = {p: order[model.get_score(i)] for p, i in plain.items() if len(p) > 1}
        self.plain = plain
        self.marked = np.array([p.startswith(MARK) for p in map(model.id_to_piece, size)]) & np.array(
            [i not in special for i in size])
        self.lengths = np.array([len(x) for x in raw], np.int64)
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.reset()
        if self.encode([PROBE])[0].tolist() != model.encode(PROBE):
            raise ValueError(f"{path}: not a byte-pair vocabulary without normalisation and with a marker in front")

    def reset(self) -> None:
        self.table: dict[str, int] = {}
        self.ids, self.first, self.count, self.chars = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def segment(self, word: str) -> list[int]:
        """Ids of one marked word."""
        out = []
        for piece in self.scanned(word) if len(word) <= SHORT else self.heaped(word):
            if (known := self.plain.get(piece)) is not None:
                out.append(known)
            else:  # a single character
                out += [self.of_byte[b] for b in piece.encode("utf-8", "surrogatepass")]
        return out

    def scanned(self, word: str) -> list[str]:
        """Merged symbols of a short word: every round looks at all pairs."""
        parts, rank, none = list(word), self.ranks.get, len(self.lengths)
        ranks = [rank(a + b, none) for a, b in zip(word, word[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            ranks.pop(i)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
        return parts

    def heaped(self, word: str) -> list[str]:
        """Merged symbols of a long word: a heap of (rank, place) over a linked list."""
        n, rank = len(word), self.ranks.get
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n  # symbol i: word[i:end[i]]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue  # one of the two has been merged since
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := rank(word[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := rank(word[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(word[i:end[i]])
            i = end[i]
        return out

    def learn(self, words: list[str]) -> None:
        """Add distinct marked words to the table."""
        found = [self.segment(w) for w in words]
        counts = np.array([len(x) for x in found], np.int64)
        self.table.update(zip(words, range(len(self.first), len(self.first) + len(words))))
        self.first = np.append(self.first, len(self.ids) + np.cumsum(counts) - counts)
        self.count = np.append(self.count, counts)
        self.ids = np.append(self.ids, np.fromiter((i for x in found for i in x), np.int32, int(counts.sum())))
        self.chars += sum(map(len, words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each)."""
        if len(self.first) > TABLE_WORDS or self.chars > TABLE_CHARS:
            self.reset()
        words, upto = [], [0]
        for text in texts:
            if text:
                words += re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
            upto.append(len(words))
        new = [w for w in dict.fromkeys(words) if w not in self.table]
        if new:
            self.learn(new)
        at = np.fromiter(map(self.table.__getitem__, words), np.int64, len(words))
        counts = self.count[at]
        before = np.cumsum(counts) - counts
        ids = self.ids[np.repeat(self.first[at] - before, counts) + np.arange(counts.sum())]
        return ids, np.diff(np.append(before, counts.sum())[np.array(upto)])

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) == 0:
            return ""
        n = self.lengths[ids]
        turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        data = self.flat[np.repeat(self.starts[ids], n) + turn].tobytes()
        shown = np.flatnonzero(n)  # control pieces show nothing, and end a run of bytes
        front = int(len(shown) > 0 and self.marked[ids[shown[0]]])
        cuts = [front, *np.maximum(np.cumsum(n)[n == 0], front).tolist(), len(data)]
        return "".join(data[a:b].decode("utf-8", "netloom each byte") for a, b in zip(cuts, cuts[1:]) if a < b)


def vocabulary(path: str) -> Pieces:
    return kept(f"sentence_pieces {path}", lambda: Pieces(path))


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, the pieces of the whole ``text``, without begin or end."""
    return _run(docs, path, text, ids, None)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``, the text of ``ids``."""
    path = path or sources_path(VOCABULARY)
    rest, schema = replaced(encoded, **{decoded: T.StringType()})

    def run(batches):
        known = vocabulary(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                texts = [known.decode(np.asarray(x.values)) if x.is_valid else "" for x in batch.column(ids)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rest.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids",
               decoded: str = "decoded") -> DataFrame:
    """encode, then decode, in one pass of one worker."""
    return _run(docs, path, text, ids, decoded)


def _run(docs: DataFrame, path: str | None, text: str, ids: str, decoded: str | None) -> DataFrame:
    path = path or sources_path(VOCABULARY)
    rest, schema = replaced(docs, **{ids: IDS} | ({decoded: T.StringType()} if decoded else {}))

    def run(batches):
        known = vocabulary(path)
        for batch in pieces(batches, text, SLICE):
            found, counts = known.encode([x or "" for x in batch.column(text).to_pylist()])
            columns = [*batch.columns, lists(found, counts)]
            if decoded:
                texts = [known.decode(x) for x in np.split(found, np.cumsum(counts)[:-1])] if len(counts) else []
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rest.mapInArrow(run, schema)
