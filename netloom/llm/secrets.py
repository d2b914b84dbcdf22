"""Secret scan: fixed forms, and random strings found by their token efficiency.

Three fixed forms (assignments, access keys, hexadecimal runs) are the base. Beside them, what they leave of every run of
key characters is measured in tokens of a public vocabulary, from ``MIN_RUN`` characters on: words, paths and names need
few tokens, random strings need one for every one or two characters. Runs with fewer than ``MAX_RATIO`` characters a token
are reported. Of other runs, cut at / _ - =, those stretches of parts are reported that need the most tokens beyond that
ratio (all maximal scoring segments, in linear time), so words beside a secret do not hide it. Known digests (hexadecimal
of a digest's length), UUIDs, plain numbers and letters of one case only (long words) are not reported.

Each text is scanned on its own, so the work spreads with the rows and nothing is shuffled.

Defined results: null and empty texts have no spans; texts of any length are scanned whole; repeated rows are scanned
alike; an empty table gives an empty result; other columns pass through untouched. Places are code points.
"""

from __future__ import annotations

import base64
import bisect
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import kept, pieces, ship, sources_path

ship(__name__)

VOCABULARY = "byte_bpe_50k.tiktoken"
MIN_RUN = 16
MAX_RATIO = 2.0
KINDS = ("assign", "access", "hex", "random")
HINTS = ("passw", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones need not be matched first
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
#: Digest lengths in hexadecimal digits (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
FIXED = re.compile(rf"(?<![A-Za-z0-9+])(?:{UUID.pattern}|[0-9A-Fa-f]+)(?![A-Za-z0-9+])")
PART = re.compile(r"[A-Za-z0-9+]+|[/_=-]+")
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                 T.StructField("end", T.IntegerType())]))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed forms; each kind's matches do not overlap, failing ones are dropped."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def known(run: str) -> bool:
    """Digests, identifiers, numbers and long words: not secrets by themselves."""
    core = run.strip("=_-/+")
    plain = core.replace("-", "").replace("_", "").replace("/", "")
    return (plain.isdigit() or plain.islower() and plain.isalpha() or plain.isupper() and plain.isalpha()
            or len(core) in DIGESTS and re.fullmatch(r"[0-9A-Fa-f]+", core) is not None or UUID.fullmatch(core) is not None)


def encoding(path: str) -> tiktoken.Encoding:
    def make():
        import public_tokenizers
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept(f"tiktoken {path}", make)


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments (Ruzzo and Tompa), in order."""
    out, total = [], 0.0  # (first, after last, sum before, sum with, place of the last one with a smaller sum before)
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        first, j = i, len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= before:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                break
            first, before = out[j][0], out[j][2]
            last, j = j, out[j][4]
            del out[last:]
        out.append((first, i + 1, before, total, j))
    return [x[:2] for x in out]


def random_parts(run: str, tokens) -> list[tuple[int, int]]:
    """Places of the random strings in a run of key characters: the whole, or stretches of its parts."""
    if len(run) < MIN_RUN or known(run):
        return []
    if len(run) < MAX_RATIO * tokens(run):
        return [(0, len(run))]
    out, at = [], 0
    fixed = [m.span() for m in FIXED.finditer(run) if "-" in m[0] or len(m[0]) in DIGESTS]
    for a, b in [*fixed, (len(run), len(run))]:
        parts = list(PART.finditer(run, at, a))
        for i, j in segments([MAX_RATIO * tokens(m[0]) - len(m[0]) for m in parts]):
            start, end = parts[i].start(), parts[j - 1].end()
            core = run[start:end].lstrip("/_=-")
            start, end = end - len(core), end - len(core) + len(core.rstrip("/_-"))
            if end - start >= MIN_RUN and not known(run[start:end]):
                out.append((start, end))
        at = b
    return out


def spans(text: str, path: str) -> list[tuple[int, str, int]]:
    found = base_spans(text)
    taken = []  # what base spans cover, joined
    for a, b in sorted((a, b) for a, _, b in found):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    ends = [b for _, b in taken]
    for m in RUN.finditer(text):
        at, i = m.start(), bisect.bisect_right(ends, m.start())
        while at < m.end():
            a, b = taken[i] if i < len(taken) and taken[i][0] < m.end() else (m.end(), m.end())
            found += [(at + x, "random", at + y) for x, y in random_parts(
                text[at:a], lambda part: len(encoding(path).encode_ordinary(part)))]
            at, i = b, i + 1
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def scan_secrets(docs: DataFrame, column: str = "secrets", path: str | None = None) -> DataFrame:
    """Add ``column``: the (kind, start, end) of every secret, by start, then kind."""
    path = path or sources_path(VOCABULARY)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, SPAN)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for whole in batches:
            for batch in pieces([whole], "text"):
                found = [[{"kind": k, "start": a, "end": b} for a, k, b in spans(x or "", path)]
                         for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=schema.names)

    return docs.mapInArrow(run, schema)


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with every secret in its text replaced by <kind>; overlapping spans go as one, under the first kind."""
    schema, path = docs.schema, path or sources_path(VOCABULARY)
    at = schema.names.index("text")

    def clean(text):
        out, end = [], 0
        for a, kind, b in spans(text, path):
            if a >= end:
                out += [text[end:a], f"<{kind}>"]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def run(batches):
        for whole in batches:
            for batch in pieces([whole], "text"):
                columns = list(batch.columns)
                columns[at] = pa.array([x if x is None else clean(x) for x in batch.column("text").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)
