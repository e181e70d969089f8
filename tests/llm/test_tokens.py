"""Token shards and packing: exact round trips."""

import random
import zlib

import numpy as np
import pytest

from feedback_points.llm import packing, token_store
from feedback_points.llm.common import stage_path
from feedback_points.llm.tokens import Encoder

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoded(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return {i: [*e.ids, 2] for (i, _), e in zip(rows, t.encode_batch([x or "" for _, x in rows], add_special_tokens=False), strict=True)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_matches_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    odd = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))  # sums of powers don't tell it from its complement
    rng = random.Random(4)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'t", "1", "²", "!", "?", "<|endoftext|>", "漢", "д", "😀", "\x1c", "\x85", "ª", "_", "''s", "'S", "ß", "\u2003", "\u00a0"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)] + ["'", "s'", "'r", " ", "x" * 5000, "hello <|endoftext|> you"]
    texts += [odd[:n].translate(turn) for n in (1024, 2048, 4096) for turn in ({}, {97: "b", 98: "a"})]
    data = "".join(texts).encode()
    at = np.cumsum([0] + [len(x.encode()) for x in texts])
    for _ in range(2):  # cold and warm
        ids, counts = Encoder.of(PATH).encode(np.frombuffer(data, np.uint8), at)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("shard_ids", [1 << 20, 500])
def test_round_trip(spark, docs, encoded, shard_ids):
    path = stage_path(spark, "test-shards")
    token_store.write_token_shards(docs, path, PATH, shard_ids=shard_ids)
    shards = token_store.read_token_shards(spark, path)
    want, at = {}, 0
    for i in sorted(encoded):
        want[i] = (at, len(encoded[i]), crc(encoded[i]))
        at += len(encoded[i])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.token_digest(shards).collect()} == want
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_store.decode(shards).collect()} == encoded
    longest = max(encoded, key=lambda i: len(encoded[i]))
    assert token_store.decode_range(shards, longest, 1000, 1100) == encoded[longest][1000:1100]
    assert token_store.decode_range(shards, longest) == encoded[longest]
    with pytest.raises(KeyError):
        token_store.decode_range(shards, -5)


@pytest.mark.parametrize("seed", range(6))
def test_re_pair(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 300, 20)
    counts[0] = 0
    ids = rng.integers(0, 4 if seed % 2 else 60, counts.sum()).astype(np.uint32)
    if seed == 3:
        ids[:] = 7
    symbols, per_doc, rules, base = token_store.re_pair(ids, counts, min_count=2)
    grammar = token_store.Grammar(base, rules, token_store.spans_of(rules, base))
    assert (grammar.expand(symbols) == ids).all() and (len(symbols) < len(ids)) == bool(len(rules))
    for part, own in zip(np.split(symbols, np.cumsum(per_doc)[:-1]), np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert (grammar.expand(part) == own).all()
        if len(own) > 9:
            assert (grammar.part(part, 3, 9) == own[3:9]).all()


@pytest.mark.parametrize("batch", [1 << 14, 1, 3])
def test_re_pair_goes_on_until_no_pair_is_frequent(batch, monkeypatch):
    monkeypatch.setattr(token_store, "ROUND_RULES", batch)
    rng = np.random.default_rng(9)
    counts = np.array([400, 0, 700, 1])
    ids = rng.choice(12, counts.sum(), p=np.arange(1, 13) / 78).astype(np.uint32)
    symbols, per_doc, rules, base = token_store.re_pair(ids, counts)
    seen = {}
    for part in np.split(symbols, np.cumsum(per_doc)[:-1]):
        last = None
        for pair in zip(part[:-1].tolist(), part[1:].tolist(), strict=True):
            if pair == last and pair[0] == pair[1]:  # overlaps the one before
                last = None
                continue
            seen[pair] = seen.get(pair, 0) + 1
            last = pair
    assert len(rules) and max(seen.values()) < token_store.MIN_COUNT
    assert (token_store.Grammar(base, rules, token_store.spans_of(rules, base)).expand(symbols) == ids).all()


def test_store_empty_and_odd(spark, odd, empty):
    for df, n in ((empty, 0), (odd, 8)):
        path = stage_path(spark, "test-shards")
        token_store.write_token_shards(df, path, PATH)
        assert token_store.token_digest(token_store.read_token_shards(spark, path)).count() == n


def check_packing(rows, encoded, capacity):
    sequences, documents = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        documents.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(documents) == set(encoded)
    for i, own in documents.items():
        at = 0
        for k, (piece, start, length, check) in enumerate(sorted(own)):
            assert (piece, start) == (k, at) and check == crc(encoded[i][at : at + length]) and (k == 0 or length == capacity)
            at += length
        assert at == len(encoded[i])
    return len(sequences)


@pytest.mark.parametrize("capacity", [1024, 64])
def test_pack(docs, encoded, capacity):
    n = check_packing(packing.pack(docs, PATH, capacity=capacity).collect(), encoded, capacity)
    assert n <= 1.05 * -(-sum(map(len, encoded.values())) // capacity) + 1


def test_pack_levels(docs, encoded, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", 8)
    check_packing(packing.pack(docs, PATH).collect(), encoded, 1024)


@pytest.mark.parametrize("task_items", [200_000, 250])
def test_pack_sorted_by_length(spark, monkeypatch, task_items):
    """Long pieces in some files and short ones in others still meet, on one level and on several."""
    monkeypatch.setattr(packing, "TASK_ITEMS", task_items)
    sizes = [600] * 1500 + [400] * 1500
    cut = spark.createDataFrame([(i, 0, 0, n, i % 7) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long").coalesce(4)
    monkeypatch.setattr(packing, "pieces", lambda *_: cut)
    got = packing.pack(cut, PATH).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1024 and len(fill) <= 1500 * 1.07


def test_pack_odd(odd, empty, encoded):
    from tokenizers import Tokenizer

    assert packing.pack(empty, PATH).count() == 0
    t = Tokenizer.from_file(PATH)
    want = sorted((r.doc_id or -1, crc([*t.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in odd.collect())
    got = packing.pack(odd, PATH).collect()
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in got) == want and {r.piece for r in got} == {0}


def test_best_fit():
    rng = random.Random(1)
    sizes = np.array([rng.randint(1, 1023) for _ in range(3000)])
    bins = packing.best_fit(sizes)
    fill = np.bincount(bins, weights=sizes)
    # no two sizes over half the capacity share a bin
    least = max(-(-sizes.sum() // 1024), (sizes > 512).sum())
    assert fill.max() <= 1024 and least <= len(fill) <= 1.02 * least + 1
