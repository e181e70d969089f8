"""Token ids on disk, compressed by Re-Pair grammars.

The file format is a Parquet table with one row per shard; shards hold whole documents in ascending
id order. A shard's ids are a sequence of symbols: ids below ``base`` stand for themselves, symbol
``base + r`` for the pair in rule r. Rules never cross the end of a document. Each rule's expansion
length is stored, so a position inside a document is found by summing lengths, and only the symbols
around it are expanded.

Replacement stops when no pair inside a document occurs ``MIN_COUNT`` times or more, and nowhere else.

Columns: ``part, shard`` (order), ``part_start`` (ids before the shard in its part), ``n_ids``,
``first_id, last_id`` (least and greatest document id, for pruning by Parquet statistics),
``doc_id`` (list), ``doc_ids`` and ``doc_symbols`` (ids and symbols of each document), ``base``,
``rules`` (pairs of unsigned 32-bit numbers), ``spans`` (expansion lengths, unsigned 32-bit),
``symbols`` (unsigned, 16-bit where base and rules allow it, else 32-bit).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_partitions
from .tokens import END_ID, encode_column

#: A shard is closed when it holds so many ids; a longer document is a shard of its own.
SHARD_IDS = 1 << 20
#: How often a pair must occur: a rule takes 12 bytes and saves a symbol of 2 bytes at each occurrence.
MIN_COUNT = 8
#: Pairs that a round replaces together at most; rounds go on until none is left.
ROUND_RULES = 1 << 13
_BUCKETS = 1 << 20

SCHEMA = "part long, shard long, part_start long, n_ids long, first_id long, last_id long, doc_id array<long>, doc_ids array<int>, doc_symbols array<int>, base long, rules binary, spans binary, symbols binary"


def _frequent(left: np.ndarray, right: np.ndarray, inner: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pairs (as 64-bit codes) and their counts, most frequent first."""
    bucket = ((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))) >> np.uint32(12)
    bucket = np.where(inner, bucket, _BUCKETS).astype(np.int64)
    seen = np.bincount(bucket, minlength=_BUCKETS + 1)[:_BUCKETS]
    full = np.flatnonzero(seen >= min_count)
    part = full if len(full) <= 2 * ROUND_RULES else full[np.argpartition(seen[full], -2 * ROUND_RULES)[-2 * ROUND_RULES :]]
    codes, counts = _counted(left, right, bucket, part, min_count)
    return (codes, counts) if len(codes) or len(part) == len(full) else _counted(left, right, bucket, full, min_count)


def _counted(left: np.ndarray, right: np.ndarray, bucket: np.ndarray, full: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    wanted = np.zeros(_BUCKETS + 1, bool)
    wanted[full] = True
    at = np.flatnonzero(wanted[bucket])
    codes, counts = np.unique(left[at].astype(np.uint64) << np.uint64(32) | right[at], return_counts=True)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] >= min_count]
    return codes[order], counts[order]


def _choose(codes: np.ndarray, limit: int) -> list[int]:
    """Pairs of which no two occurrences can overlap: no symbol is the left of one and the right of
    another; a pair of equal symbols has its symbol to itself."""
    lefts: set[int] = set()
    rights: set[int] = set()
    out = []
    for code in codes.tolist():
        a, b = code >> 32, code & 0xFFFFFFFF
        if a == b:
            if a in lefts or a in rights:
                continue
        elif a in rights or b in lefts:
            continue
        lefts.add(a)
        rights.add(b)
        out.append(code)
        if len(out) == limit:
            break
    return out


def re_pair(ids: np.ndarray, doc_ids: np.ndarray, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, symbols of each document, rules (n by 2) and base of the ids of some documents."""
    seq = ids.astype(np.uint32)
    base = int(seq.max()) + 1 if len(seq) else 0
    doc = np.repeat(np.arange(len(doc_ids)), doc_ids)
    rules: list[np.ndarray] = []
    made = 0
    while len(seq) > 1:
        left, right, inner = seq[:-1], seq[1:], doc[1:] == doc[:-1]
        codes, _counts = _frequent(left, right, inner, min_count)
        chosen = np.array(sorted(_choose(codes, ROUND_RULES)), np.uint64)
        if not len(chosen):
            break
        may = np.zeros(base + made, bool)
        may[(chosen >> np.uint64(32)).astype(np.int64)] = True
        at = np.flatnonzero(may[left] & inner)
        code = left[at].astype(np.uint64) << np.uint64(32) | right[at]
        rule = np.minimum(np.searchsorted(chosen, code), len(chosen) - 1)
        hit = chosen[rule] == code
        at, rule = at[hit], rule[hit]
        follows = np.concatenate([[False], (at[1:] == at[:-1] + 1)])  # only within runs of one symbol
        if follows.any():
            run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            even = (np.arange(len(at)) - run) % 2 == 0
            at, rule = at[even], rule[even]
        seq = seq.copy()
        seq[at] = base + made + rule
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, doc = seq[stay], doc[stay]
        rules.append(np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        made += len(chosen)
    return seq, np.bincount(doc, minlength=len(doc_ids)), np.concatenate([*rules, np.zeros((0, 2), np.uint32)]), base


def spans_of(rules: np.ndarray, base: int) -> np.ndarray:
    """Expansion length of each rule."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((1 if a < base else out[a - base]) + (1 if b < base else out[b - base]))
    return np.array(out, np.uint32)


class Grammar:
    """Decodes the symbols of one shard."""

    def __init__(self, base: int, rules: np.ndarray, spans: np.ndarray):
        self.base = base
        self.size = np.concatenate([np.ones(base, np.int64), spans.astype(np.int64)])
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([np.arange(base, dtype=np.uint32), np.zeros(int(spans.sum()), np.uint32)])
        for r, (a, b) in enumerate(rules.tolist()):
            at = int(self.first[base + r])
            for s in (a, b):
                n, f = int(self.size[s]), int(self.first[s])
                self.flat[at : at + n] = self.flat[f : f + n]
                at += n

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        s = symbols.astype(np.int64)
        n = self.size[s]
        ends = np.cumsum(n)
        if not len(s):
            return np.zeros(0, np.uint32)
        return self.flat[np.arange(int(ends[-1])) + np.repeat(self.first[s] - (ends - n), n)]

    def part(self, symbols: np.ndarray, begin: int, stop: int) -> np.ndarray:
        """Ids begin to stop (exclusive) of the sequence, expanding only the symbols that hold them."""
        ends = np.cumsum(self.size[symbols.astype(np.int64)])
        lo, hi = int(np.searchsorted(ends, begin, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[lo - 1]) if lo else 0
        return self.expand(symbols[lo:hi])[begin - before : stop - before]


def _symbols(raw: bytes, base: int, n_rules: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if base + n_rules <= 1 << 16 else np.uint32)


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode every text and write the shards to ``path``.

    A null text is an empty one and holds the end id alone. Rows with a null id come first; rows
    that repeat an id all stay, side by side. Other columns are not stored.
    """
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranged = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        ids, counts, names, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            doc_ids = np.concatenate(counts)
            symbols, per_doc, rules, base = re_pair(np.concatenate(ids), doc_ids)
            narrow = np.uint16 if base + len(rules) <= 1 << 16 else np.uint32
            own = [x for n in names for x in n]
            some = [x for x in own if x is not None] or [None]
            row = [part, shard, start, held, min(some), max(some), own, doc_ids, per_doc, base, rules.tobytes(), spans_of(rules, base).tobytes(), symbols.astype(narrow).tobytes()]
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for i, j, made, n in encode_column(batch.column(1), tokenizer, end_id):
                ids.append(made)
                counts.append(n)
                names.append(batch.column(0).slice(i, j - i).to_pylist())
                held += len(made)
                if held >= shard_ids:
                    yield close()
                    shard, start = shard + 1, start + held
                    ids, counts, names, held = [], [], [], 0
        if ids:
            yield close()

    ranged.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _starts(shards: DataFrame) -> dict[int, int]:
    """Ids before each part; one row per part of the write."""
    out, total = {}, 0
    for part, n in sorted(shards.groupBy("part").agg(F.sum("n_ids")).collect()):
        out[part] = total
        total += n
    return out


def decode(shards: DataFrame) -> DataFrame:
    """One row per document in the order of ``start``: ``doc_id, start, ids`` (little-endian
    unsigned 32-bit, the end id included)."""
    before = _starts(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for at, _, ids in _decoded(row):
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([before[row["part"]] + _], pa.int64()), pa.array([ids.tobytes()], pa.binary())], ["doc_id", "start", "ids"])

    return shards.mapInArrow(run, "doc_id long, start long, ids binary")


def _decoded(row: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Id, ids before it in its part, and ids of each document of a shard."""
    rules = np.frombuffer(row["rules"], np.uint32).reshape(-1, 2)
    grammar = Grammar(row["base"], rules, np.frombuffer(row["spans"], np.uint32))
    ids = grammar.expand(_symbols(row["symbols"], row["base"], len(rules)))
    at = 0
    for name, n in zip(row["doc_id"], row["doc_ids"], strict=True):
        yield name, row["part_start"] + at, ids[at : at + n]
        at += n


def token_digest(shards: DataFrame) -> DataFrame:
    """One row per document, from its decoded ids: ``doc_id, start, n_tokens, ids_crc32``."""
    before = _starts(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                found = [(name, before[row["part"]] + at, len(ids), zlib.crc32(ids.tobytes())) for name, at, ids in _decoded(row)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def decode_range(shards: DataFrame, doc_id: int, begin: int = 0, stop: int | None = None) -> list[int]:
    """Some ids of one document, by random access: its shard is found by statistics, and few symbols expanded."""
    here = F.lit(doc_id).between(F.col("first_id"), F.col("last_id"))
    for row in shards.where(here & F.array_contains("doc_id", doc_id)).toLocalIterator():
        k = row["doc_id"].index(doc_id)
        rules = np.frombuffer(row["rules"], np.uint32).reshape(-1, 2)
        grammar = Grammar(row["base"], rules, np.frombuffer(row["spans"], np.uint32))
        first = sum(row["doc_symbols"][:k])
        own = _symbols(row["symbols"], row["base"], len(rules))[first : first + row["doc_symbols"][k]]
        size = row["doc_ids"][k]
        return grammar.part(own, min(begin, size), size if stop is None else min(stop, size)).tolist()
    raise KeyError(doc_id)
