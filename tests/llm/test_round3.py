"""Whitening, alignment and SentencePiece ids against brute force and the libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import DATA

from feedback_points.llm import alignment, pieces, queries, tokens, whitening
from feedback_points.llm.pieces import PieceEncoder

P = pytest.importorskip("public_tokenizers")
BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", "▁", "a ▁ b", "<s> </s> <unk> <0x41>", "<|endoftext|> x", "\x00\n\t", "漢字テスト", "😀 é é", " " * 70, "ab" * 700, "x" * 300 + " " + "\n" * 90, "1234567890" * 20, "don't we'll I'M", "naïve façade", "дом และ"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    return t


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- SentencePiece ------------------------------------------------------------------------------


def test_pieces_match_library(library, rows):
    rng = random.Random(8)
    parts = ["a", "e", " ", "  ", "▁", "\n", "the", "ing", "漢", "д", "😀", "\x00", "é", "<s>", "0", "aaaa", "    ", "xyz", "่"]
    texts = ODD + [t or "" for _, t in rows] + ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(2000)]
    encoder = PieceEncoder(PIECES)
    for _ in range(2):  # cold and warm
        ids, counts = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == library.encode(texts)


def test_pieces_backtrack_equals_merges(library):
    """Texts without blanks, beyond what is remembered, and with bounded tables."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdeinorst", k=400)) for _ in range(40)] + ["=-" * 300, "é" * 100]
    encoder = PieceEncoder(PIECES)
    for t in texts:
        assert encoder._chunk("▁" + t) == library.encode(t)


def test_pieces_with_small_tables(library, monkeypatch, rows):
    monkeypatch.setattr(pieces, "MAX_PAIRS", 5)
    monkeypatch.setattr(tokens, "MAX_STRINGS", 20)
    encoder, texts = PieceEncoder(PIECES), [t or "" for _, t in rows[:30]]
    for t in texts:
        assert encoder.encode([t])[0].tolist() == library.encode(t)


def test_pieces_query(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: library.encode(r.text or "") for r in docs}
    got = queries.op13_pieces(spark, DATA).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {i: (len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for i, x in want.items()} and len(got) == len(docs)


def test_pieces_odd(spark, odd, empty, docs, rows, library):
    assert pieces.piece_encode(empty, PIECES).count() == 0
    got = pieces.piece_digest(pieces.piece_decode(pieces.piece_encode(odd, PIECES), PIECES)).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((r.doc_id or -1, len(library.encode(r.text or ""))) for r in odd.collect())
    assert {r.decoded_sha256 for r in got if not r.n_tokens} == {sha("")}
    found = {r.doc_id: r.ids for r in pieces.piece_encode(docs, PIECES).collect()}
    assert found == {i: library.encode(t or "") for i, t in rows}
    nothing = spark.createDataFrame([(1, None), (2, [0, 5, 900, 300])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.piece_decode(nothing, PIECES).collect()} == {1: "", 2: library.decode([0, 5, 900, 300])}


def test_pieces_refuses_other_models(monkeypatch):
    from sentencepiece import sentencepiece_model_pb2 as proto

    real = proto.ModelProto.ParseFromString

    def unigram(self, raw):
        real(self, raw)
        self.trainer_spec.model_type = 1

    monkeypatch.setattr(proto.ModelProto, "ParseFromString", unigram, raising=False)
    try:
        proto.ModelProto().ParseFromString(b"")
    except Exception:  # compiled classes can't be changed
        pytest.skip("protobuf classes are fixed")
    with pytest.raises(ValueError, match="BPE"):
        PieceEncoder(PIECES)


# --- hashes -------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_encoder_compares_bytes(monkeypatch, plain, bits):
    """Whatever the hash, other pre-tokens' ids are not written."""
    real = tokens.hash_runs
    monkeypatch.setattr(tokens, "hash_runs", lambda *a: real(*a) & np.uint64((1 << bits) - 1))
    texts = ["moglgcklaaaaabda ikgwywcdmbcpvxyw", "ikgwywcdmbcpvxyw", "one two three", "", "two  one"] * 2
    data = [t.encode() for t in texts]
    for encoder in (tokens.Encoder(BYTES, plain=True),):
        for _ in range(2):
            ids, counts = encoder.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data]))
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_hash_of_constructed_words():
    """Two words that a single chain of 64 bits would not tell apart."""
    from feedback_points.llm.words import hash_runs

    a, b = hash_runs(np.frombuffer(b"moglgcklaaaaabdaikgwywcdmbcpvxyw", np.uint8), np.array([0, 16]), np.array([16, 16]))
    assert a != b


# --- alignment ----------------------------------------------------------------------------------


def token_bytes(plain, library, text):
    """Ids and bytes of the tokens of both sides."""
    from tokenizers.decoders import ByteLevel  # noqa: F401

    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code, n = {}, 0
    for b in range(256):
        code[chr(b) if b in keep else chr(256 + n)] = b
        n += b not in keep
    e = plain.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(code[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
    b = []
    for i in library.encode(text):
        p = library.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode()))
    return a, b


def brute_alignment(plain, library, texts):
    """Per text: n_a, n_b, groups, links; by byte offsets."""
    out = {}
    for k, text in texts:
        a, b = token_bytes(plain, library, text) if text else ([], [])
        if not text or any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
            out[k] = (0, 0, [], [])
            continue
        ranges = []
        for side in (a, b):
            at, own = 0, []
            for i, raw in side:
                own.append((i, at, at + len(raw)))
                at += len(raw)
            ranges.append(own)
        shared = {e for _, _, e in ranges[0]} & {e for _, _, e in ranges[1]}
        groups, links, j = [], [], 0
        part = [[], []]
        for end in sorted(shared):
            part = [[i for i, _, e in side if e <= end and e > j] for side in ranges]
            groups.append(part)
            j = end
        for i, s, e in ranges[0]:
            links += [(i, i2) for i2, s2, e2 in ranges[1] if s < e2 and s2 < e]
        out[k] = (len(a), len(b), groups, links)
    held = Counter(p for _, _, _, links in out.values() for p in set(links))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    return {
        k: (na, nb, len(g), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)) if na else "")
        for k, (na, nb, g, links) in out.items()
    }


def aligned(df):
    return {r.doc_id: tuple(r)[1:] for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}


@pytest.mark.parametrize("limit", [100_000, 40, 0])
def test_alignment(spark, rows, plain, library, limit, monkeypatch):
    monkeypatch.setattr(alignment.score_links, "__defaults__", (limit,))
    texts = [(i, t if t is None else t[:1500]) for i, t in rows] + [(1000 + k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, pair string, docs string").repartition(3)
    assert aligned(alignment.alignment_digest(df, BYTES, PIECES)) == brute_alignment(plain, library, texts)


def test_alignment_query(spark, plain, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    short = [(i, t) for i, t in docs if not t or len(t) < 3000]
    got = aligned(queries.op12_alignment(spark, DATA))
    assert len(got) == len(docs)
    want = brute_alignment(plain, library, short)
    assert {i: (*got[i][:4], got[i][6]) for i, _ in short} == {i: (*w[:4], w[6]) for i, w in want.items()}


def test_alignment_odd(spark, odd, empty):
    assert alignment.alignment_digest(empty, BYTES, PIECES).count() == 0
    got = alignment.alignment_digest(odd, BYTES, PIECES).collect()
    assert len(got) == 8 and sorted(r.doc_id or -1 for r in got) == [-1, -1, 3, 5, 5, 7, 8, 8]
    assert all((r.n_a, r.n_groups, r.n_best, r.count_sum, r.groups_sha256) == (0, 0, 0, 0, "") for r in got if r.doc_id == 7)


@pytest.mark.parametrize("seed", range(8))
def test_shared_cuts(seed):
    """The same groups as by set intersection, also where intervals have no cut."""
    rng = np.random.default_rng(seed)
    a_end, b_end, a_count, b_count, at, want = [], [], [], [], 0, []
    for n in rng.integers(0, 60, 30).tolist():
        if n:
            cut = lambda p: np.flatnonzero(rng.random(n) < p)
            a, b = cut(0.6), cut(rng.choice([0.02, 0.5, 0.9]))
            if seed == 0:
                b = np.setdiff1d(b, a)
            a, b = np.union1d(a, [n - 1]), np.union1d(b, [n - 1])
            a_end += (a + at + 1).tolist()
            b_end += (b + at + 1).tolist()
        else:
            a = b = np.zeros(0)
        a_count.append(len(a))
        b_count.append(len(b))
        at += n
    x, y = alignment.shared_cuts(np.array(a_end), np.array(b_end), np.array(a_count), np.array(b_count))
    want = sorted(set(a_end) & set(b_end))
    assert [a_end[i] for i in x] == want == [b_end[i] for i in y]


# --- whitening ----------------------------------------------------------------------------------


def brute_whitening(vectors):
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    d = n * x - s
    v = np.array([[int(a) for a in row] for row in d.T @ d], object)
    return n, (d * d).sum(1), np.array([[a / n**3 for a in row] for row in v], float), (x - s / n).astype(float)


def check_whitening(got, vectors, components=8):
    ids = sorted(vectors)
    n, deviation, v, centred = brute_whitening([vectors[i] for i in ids])
    values, directions = np.linalg.eigh(v)
    found = np.full((len(ids), components), np.nan)
    where = {i: k for k, i in enumerate(ids)}
    assert len(got) == len(ids) * components
    for r in got:
        k = where[r.vec_id]
        found[k, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[k] and r.identity_error <= 1e-8
        assert abs(r.explained - values[-r.component] / np.trace(v)) < 1e-9
    want = centred @ directions[:, ::-1][:, :components] / np.sqrt(values[::-1][:components])
    sign = np.sign((found * want).sum(0))
    assert np.allclose(found * sign, want, atol=1e-7)


def test_whitening_query(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    check_whitening(queries.op11_whitening(spark, DATA).collect(), vectors)


def test_whitening_drops_and_odd(spark):
    rng = np.random.default_rng(1)
    good = {i: rng.normal(0, 1, 10).tolist() for i in range(40)}
    good[40] = good[41] = [1e3] * 10
    bad = [(100, None), (101, [1.0] * 9 + [None]), (102, [float("nan")] * 10), (103, [float("inf")] * 10), (104, []), (105, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, "x", "y", 1) for i, v in [*good.items(), *bad]], "vec_id long, embedding array<double>, w string, component string, n int").repartition(3)
    check_whitening(whitening.whiten(df).collect(), good)
    assert whitening.whiten(df.where("false")).count() == whitening.whiten(df.where("vec_id >= 104")).count() == whitening.whiten(df.where("vec_id in (40, 41)")).count() == 0
    twice = whitening.whiten(df.where("vec_id < 40").unionByName(df.where("vec_id < 40")).withColumn("vec_id", __import__("pyspark").sql.functions.expr("nullif(vec_id, 3)"))).collect()
    assert len(twice) == 2 * 40 * 8 and sum(r.vec_id is None for r in twice) == 16
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}


def test_whitening_large_numbers(spark):
    """Sums beyond 64 bits stay exact; a deviation that is too large is null."""
    rng = np.random.default_rng(2)
    values = {i: [float(x) for x in rng.integers(-(1 << 40), 1 << 40, 3)] for i in range(20)}
    got = whitening.whiten(spark.createDataFrame(list(values.items()), "vec_id long, embedding array<double>")).collect()
    n, deviation, v, _ = brute_whitening(list(values.values()))
    assert all(r.deviation is None for r in got) and min(deviation) > 1 << 63
    e = np.linalg.eigvalsh(v)[::-1]
    assert {r.component: round(r.explained, 12) for r in got} == {k + 1: round(x / np.trace(v), 12) for k, x in enumerate(e)}
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in huge} == {1}


def test_polarised_covariance_is_exact():
    rng = np.random.default_rng(5)
    x = rng.integers(-3000, 3000, (50, 6)) + 100_000
    sums, n = [int(s) for s in x.sum(0)], 50
    y = x - np.array([s // n for s in sums])
    squares = whitening._square_sums(y)
    v = whitening.covariance(n, sums, dict(enumerate(map(int, y.sum(0)))), {(i, j): int(squares[i, j]) for i in range(6) for j in range(i, 6)})
    assert np.array_equal(v, brute_whitening((x - 100_000) / 1024)[2])
