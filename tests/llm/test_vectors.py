"""Operators of round three: vector codes, whitening, sentence pieces."""

import random
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece

from netloom.llm import sentence_pieces, vector_codes, whitening
from netloom.llm.common import sources_path
from netloom.llm.registry import QUERIES

VECTORS = "vec_id bigint, embedding array<float>, label int"


@pytest.fixture(scope="module")
def awkward_vectors(spark):
    """Nulls, non-finite components, other lengths, repeated rows, an equal vector under another id, clashing columns."""
    draw = random.Random(4)
    rows = [(i, [draw.gauss(0, 1 + j % 3) for j in range(8)], i % 3 if i % 5 else None) for i in range(700)]
    rows += [rows[3], rows[3], (9000, rows[7][1], 1), (None, [0.5] * 8, None)]
    rows += [(9001, None, 1), (9002, [None] + [0.0] * 7, 1), (9003, [float("nan")] * 8, 2), (9004, [float("inf")] * 8, 2),
             (9005, [1.0, 2.0], 2), (9006, [], 2)]
    df = spark.createDataFrame(rows, VECTORS)
    return df.selectExpr("*", "'a' as codes", "'b' as whole", "'c' as Whitened", "'d' as was", "'e' as error")


def kept_rows(df):
    rows = [r for r in df.collect() if r.embedding is not None and len(r.embedding) == 8
            and all(x is not None and np.isfinite(x) for x in r.embedding)]
    return sorted(rows, key=lambda r: (r.vec_id is None, r.vec_id, r.embedding))


def plain_codes(x, parts, entries, rounds):
    """Codes, errors and codebooks by measuring everything in every round."""
    width = x.shape[1] // parts
    codes, error, books = [], np.zeros(len(x), np.int64), []
    for p in range(parts):
        part = x[:, p * width:(p + 1) * width]
        book = part[:entries].copy()
        for turn in range(rounds + 1):
            d = ((part[:, None, :] - book[None]) ** 2).sum(2)
            own = d.argmin(1)
            if turn < rounds:
                for e in set(own.tolist()):
                    mine = part[own == e]
                    book[e] = [int(s) // len(mine) for s in mine.sum(0)]
        codes.append(own)
        error += d.min(1)
        books.append(book)
    return np.stack(codes, 1), error, books


@pytest.mark.parametrize("entries, rounds", [(256, 4), (40, 9)])
def test_codes_equal_plain_rounds(awkward_vectors, entries, rounds):
    done = vector_codes.compress(awkward_vectors, entries=entries, rounds=rounds)
    rows = kept_rows(awkward_vectors)
    x = np.floor(np.array([r.embedding for r in rows]) * 1024).astype(np.int64)
    codes, error, books = plain_codes(x, 4, entries, rounds)
    assert [b.tolist() for b in done.codebooks] == [b.tolist() for b in books]
    got = sorted((str(r.vec_id), r.label, tuple(r.codes), r.error) for r in done.rows.collect())
    want = sorted((str(r.vec_id), r.label, tuple(map(int, c)), int(e)) for r, c, e in zip(rows, codes, error))
    assert [str(g) for g in got] == [str(w) for w in want]
    assert {"whole", "Whitened", "was"} <= set(done.rows.columns) and done.rows.columns.count("codes") == 1
    back = vector_codes.decode(done.rows, done.codebooks).select("codes", "decoded").first()
    assert back.decoded == [v / 1024 for p, c in enumerate(back.codes) for v in books[p][c].tolist()]


def test_bounds_save_distances_and_stay_right():
    draw = np.random.default_rng(2)
    centres = draw.integers(-4000, 4000, (64, 4))
    x = centres[draw.integers(0, 64, 5000)] + draw.integers(-300, 300, (5000, 4))
    own, reach, stamp = np.full(5000, -1), np.zeros(5000, np.int32), np.zeros(5000, np.int8)
    low, stamps = np.zeros((5000, 4), np.int32), np.zeros((5000, 4), np.int8)
    history, taken = [x[:64].copy()], []
    for _ in range(8):
        taken.append(vector_codes.assign(x, history, own, reach, stamp, low, stamps))
        d = vector_codes.squared(x, history[-1])
        assert (own == d.argmin(1)).all()
        now = np.sqrt(d[np.arange(5000), own])
        moved = vector_codes.displacement(history)
        assert (reach + moved[stamp, own] >= now - 1e-6).all()
        history.append(np.array([x[own == e].sum(0) // max((own == e).sum(), 1) if (own == e).any() else history[-1][e] for e in range(64)]))
    assert taken[-1] < 5000 * 64 / 3 and sum(taken) < 8 * 5000 * 64 * 0.7


def test_codes_beyond_doubles_and_limits(spark):
    wide = spark.createDataFrame([(i, [float((i * 7919) % 5000), -16000.0 + i, 3.5, 0.0], 1) for i in range(30)], VECTORS)
    x = np.array([[int(np.floor(v * 1024)) for v in r.embedding] for r in kept_or_all(wide)])
    codes, error, _ = plain_codes(x, 2, 5, 3)
    done = vector_codes.compress(wide, parts=2, entries=5, rounds=3)
    assert sorted((r.vec_id, *r.codes, r.error) for r in done.rows.collect()) == [
        (i, *map(int, c), int(e)) for i, (c, e) in enumerate(zip(codes, error))]
    with pytest.raises(Exception, match="exceeds"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], VECTORS)).rows.collect()


def kept_or_all(df):
    return sorted(df.collect(), key=lambda r: r.vec_id)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 2)], [(1, [], 2)]):
        empty = spark.createDataFrame(rows, VECTORS)
        n = sum(r[1] is not None for r in rows)
        assert vector_codes.compress(empty).rows.count() == n
        fitted = whitening.fit(empty)
        assert whitening.whiten(empty, fitted).count() == n and whitening.identity_error(fitted) is None


def test_whitening_equals_eigh(awkward_vectors):
    fitted = whitening.fit(awkward_vectors)
    rows = kept_rows(awkward_vectors)
    x = np.floor(np.array([r.embedding for r in rows]) * 256).astype(np.int64)
    points = np.unique(x, axis=0)
    n, s = len(points), points.sum(0)
    centred = points - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert fitted.count == n and fitted.sums == s.tolist()
    np.testing.assert_allclose(fitted.values, values[:4], rtol=1e-12)
    np.testing.assert_allclose(fitted.explained, values[:4] / values.sum(), rtol=1e-12)
    sign = np.sign((fitted.vectors * vectors[:, :4]).sum(0))
    np.testing.assert_allclose(fitted.vectors, vectors[:, :4] * sign, atol=1e-12)
    out = whitening.whiten(awkward_vectors, fitted)
    assert out.columns.count("whitened") == 1 and "Whitened" not in out.columns
    got = sorted(((r.vec_id is None, r.vec_id, r.embedding), r) for r in out.collect())
    want = (x - s / n) @ (vectors[:, :4] * sign) / np.sqrt(values[:4])
    np.testing.assert_allclose([r.whitened for _, r in got], want, atol=1e-9)
    assert [int(r.deviation) for _, r in got] == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s)) for v in x]
    assert whitening.identity_error(fitted) < 1e-12


@pytest.mark.parametrize("values", [
    [5, 5 + 1e-8, 5 - 1e-8, 5 + 3e-8] + [1 + i / 50 for i in range(40)], [2.0] * 3 + [1.0] * 9, [3, 2, 1] + [0] * 20,
    [1 + 1e-9 * i for i in range(20)], [10.0 ** -i for i in range(18)]])
def test_refinement_handles_clusters(values):
    """Columns are orthonormal and solve A x = l x far below what one double-precision solution leaves."""
    wide = np.longdouble
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values),) * 2))[0].astype(wide)
    for _ in range(3):
        q = q @ (1.5 * np.eye(len(q)) - q.T @ q / 2)
    a = q * np.array(values, wide) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.eigen(a)
    assert float(np.abs(a @ x - x * got).max()) < 1e-17 * max(values)
    assert float(np.abs(x.T @ x - np.eye(len(a))).max()) < 1e-15
    np.testing.assert_allclose(got.astype(float), sorted(values, reverse=True), atol=1e-16 * max(values), rtol=1e-15)


def test_covariance_is_exact(spark):
    """Far from zero and with deviations beyond 64 bits, where sums of squares less squared sums would cancel."""
    draw = random.Random(3)
    rows = [(i, [1e12 + draw.random(), draw.random() * 1e3 - 1e13, -3.0], 1) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    fitted = whitening.fit(df)
    x = [[int(np.floor(v * 256)) for v in r[1]] for r in rows]
    n, s = 50, [sum(c) for c in zip(*x)]
    cov = [[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n ** 3)) for j in range(3)] for i in range(3)]
    np.testing.assert_allclose(fitted.values[:2], np.linalg.eigvalsh(np.array(cov))[::-1][:2], rtol=1e-9)
    got = {r.vec_id: r for r in whitening.whiten(df, fitted).collect()}
    assert all(got[i].whitened[2] is None for i in range(50))  # the third dimension is constant
    assert all(int(got[i].deviation) == sum((n * a - b) ** 2 for a, b in zip(x[i], s)) for i in range(50))


PIECE_TEXTS = ["", " ", "  a  ", "▁", "a▁b", "日本 語　x", "\x00\t\r\n", "é é ﬁ", "😀𝒜", "<s> <0x41> <unk> ⁇", "x" * 5000, " " * 300, "�"]


def piece_texts(n=400):
    draw = random.Random(8)
    bits = ["▁", " ", "  ", "a", "the", "ing", "\n", "日本", "é", "é", "\x00", "　", "😀", "0", "12", "<s>", "قد", "한국", "_"]
    return PIECE_TEXTS + ["".join(draw.choice(bits) for _ in range(draw.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sources_path(sentence_pieces.VOCABULARY))


def test_pieces_equal_the_library(make_docs, library):
    texts = piece_texts()
    docs = make_docs([*texts, None], ("'k' as IDS", "1 as decoded", "2 as table"))
    out = {r.doc_id: r for r in sentence_pieces.round_trip(docs).collect()}
    for i, text in enumerate([*texts, ""]):
        ids = library.encode(text)
        assert out[i].ids == ids and out[i].decoded == library.decode(ids), text[:50]
    again = sentence_pieces.decode(sentence_pieces.encode(docs))
    assert {r.doc_id: r.decoded for r in again.collect()} == {i: r.decoded for i, r in out.items()}


def test_pieces_decode_any_ids(library):
    known, draw = sentence_pieces.Pieces(sources_path(sentence_pieces.VOCABULARY)), random.Random(5)
    for _ in range(3000):
        ids = [draw.choice([draw.randrange(3), draw.randrange(3, 259), draw.randrange(131, 259), draw.randrange(259, 32000), 259])
               for _ in range(draw.randrange(9))]
        assert known.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_pieces_merge_alike_and_tables_start_anew(library, monkeypatch):
    known = sentence_pieces.Pieces(sources_path(sentence_pieces.VOCABULARY))
    words = {w for t in piece_texts() for w in t.split(" ") if w}
    assert all(known.scanned(w) == known.heaped(w) for w in words if len(w) < 200)
    monkeypatch.setattr(sentence_pieces, "TABLE_WORDS", 5)
    for text in piece_texts(50):
        assert known.encode([text])[0].tolist() == library.encode(text)


def test_pieces_awkward_tables(awkward, no_docs):
    assert sentence_pieces.round_trip(awkward).count() == awkward.count()
    assert sentence_pieces.round_trip(no_docs).collect() == []


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_whitening", "op13_sentence_pieces"])
def test_queries_run_whole(spark, name):
    sf = "/root/testdata/sf0.001"
    source = "documents" if name.startswith("op13") else "embeddings"
    per_row = 4 if name.startswith("op12") else 1
    assert QUERIES[name](spark, sf).count() == per_row * spark.read.parquet(f"{sf}/{source}.parquet").count()
