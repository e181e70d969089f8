"""Near-dedup by MinHash signatures and a multi-index Hamming join.

A signature holds ``positions`` MinHash values of 16 bits; its distance to another is the number of
positions that differ. It is split into chunks of ``width`` positions. Of two signatures at distance
below chunks * (errors + 1), some chunk differs in at most ``errors`` positions (pigeonhole), so each
chunk is entered once for every choice of ``errors`` positions left out: pairs under that distance
always meet under a key. With 12 chunks of 6 positions and one error all pairs up to distance 23 of
72 meet; sets that are 0.8 similar differ in 14.4 positions on average and meet with probability
1 - 3e-6. Candidates are confirmed on their full shingle sets.

Texts with equal shingle sets are one node from the start, and groups of copies are linked without
writing all their pairs (see :mod:`.linking`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, row_keys, stage, with_ids, without_ids
from .linking import link_components
from .words import distinct_sets, mix, shingles, slices, words

SHINGLE, SIMILARITY = 5, 0.8
CHUNKS, WIDTH, ERRORS = 12, 6, 1
#: Pairs whose signatures differ in more than this share of positions are not confirmed on full
#: sets: at similarity 0.8 that has a probability of about 1e-10.
FAR = 0.5


def _salts(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def signatures(hashes: np.ndarray, counts: np.ndarray, positions: int) -> np.ndarray:
    """One row of 16-bit MinHash values per text; texts without shingles get zeros."""
    out = np.zeros((len(counts), positions), np.uint16)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    starts = (np.cumsum(counts) - counts)[some]
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.empty((positions, len(some)), np.uint32)
    scratch = np.empty_like(short)
    for j, (a, b) in enumerate(zip(*_salts(positions), strict=True)):
        np.multiply(short, a, out=scratch)
        np.bitwise_xor(scratch, b, out=scratch)
        scratch ^= scratch >> np.uint32(15)
        low[j] = np.minimum.reduceat(scratch, starts)
    out[some] = ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16).T
    return out


def chunk_keys(signs: np.ndarray, chunks: int = CHUNKS, width: int = WIDTH, errors: int = ERRORS) -> np.ndarray:
    """64-bit keys: for each chunk one for every choice of ``errors`` positions left out."""
    wide = signs.astype(np.uint64)
    columns = []
    for c in range(chunks):
        for out in combinations(range(width), errors):
            acc = np.full(len(wide), c * 4096 + len(columns) + 1, np.uint64)
            for p in range(width):
                if p not in out:
                    acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + wide[:, c * width + p])
            columns.append(acc)
    return np.stack(columns, 1)


def _features(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in slices(batch.column(1)):
                h, _, _, counts = words(data, at, lower=True)
                sh, made = shingles(h, counts, k)
                sets = distinct_sets(sh, made)
                signs = signatures(sh, made, CHUNKS * WIDTH)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                        pa.array([x.tobytes() for x in signs], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "print", "sign"],
                )

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, print binary, sign binary")


def _keys(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = np.array([np.frombuffer(x, np.uint16) for x in batch.column(1).to_pylist()], np.uint16).reshape(len(batch), -1)
            ids = batch.column(0).to_numpy()
            for at in range(0, len(ids), 2048):
                keys = chunk_keys(signs[at : at + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids[at : at + 2048], keys.shape[1]))], ["key", "id"])

    return nodes.select("node", "sign").mapInArrow(run, "key long, id long")


def _sets(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in slices(batch.column(1)):
                h, _, _, counts = words(data, at, lower=True)
                sets = distinct_sets(*shingles(h, counts, k))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "set"])

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, set binary")


def _close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each bucket whose components differ and whose signatures are near; rows come sorted by key."""
    key, held = None, []

    def close() -> pa.RecordBatch:
        ids, component = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
        signs = np.stack([x[2] for x in held])
        far = (signs[:, None, :] != signs[None, :, :]).sum(2)
        a, b = np.nonzero((far <= FAR * signs.shape[1]) & (component[:, None] != component[None, :]) & (ids[:, None] < ids[None, :]))
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    for batch in batches:
        for k, name, component, sign in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if k != key:
                if held:
                    yield close()
                key, held = k, []
            held.append((name, component, np.frombuffer(sign, np.uint16)))
    if held:
        yield close()


def _linked_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links that connect the components of each pair of blocks; rows come sorted by pair."""
    key, held = None, []

    def close() -> pa.RecordBatch:
        a, b = _spanning_links(held, percent)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(c) for c in range(7)), strict=True):
            group, i, j, left, name, component = (x.as_py() for x in row[:6])
            if key != (group, i, j):
                if held:
                    yield close()
                key, held = (group, i, j), []
            held.append((left, name, component, np.frombuffer(row[6].as_buffer(), np.uint64).copy()))
    if held:
        yield close()


def _spanning_links(held: list[tuple[bool, int, int, np.ndarray]], percent: int, width: int = 4096) -> tuple[list[int], list[int]]:
    """Links between the left and the right documents, as many as connect what links connect.

    Intersections of all pairs come from products of 0/1 matrices, ``width`` shingles at a time.
    """
    left, right = [x for x in held if x[0]], [x for x in held if not x[0]]
    if not left or not right:
        return [], []
    both = left + right
    hashes, number = np.unique(np.concatenate([x[3] for x in both]), return_inverse=True)
    doc = np.repeat(np.arange(len(both)), [len(x[3]) for x in both])
    order = np.argsort(number, kind="stable")
    number, doc = number[order], doc[order]
    inter = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(hashes), width):
        lo, hi = np.searchsorted(number, [at, at + width])
        marks = np.zeros((len(both), width), np.float32)
        marks[doc[lo:hi], number[lo:hi] - at] = 1
        inter += marks[: len(left)] @ marks[len(left) :].T
    size_l, size_r = (np.array([len(x[3]) for x in side], np.int64) for side in (left, right))
    inter = inter.astype(np.int64)
    true = (100 * inter >= percent * (size_l[:, None] + size_r[None, :] - inter)) & (inter > 0)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    for i, j in zip(*np.nonzero(true), strict=True):
        x, y = find(left[i][2]), find(right[j][2])
        if x != y:
            root[x] = y
            a.append(min(left[i][1], right[j][1]))
            b.append(max(left[i][1], right[j][1]))
    return a, b


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    A-Z are lower-cased, words are runs without blanks; a text's set is its distinct shingles of
    ``k`` words (the whole sequence when it has fewer). Texts are linked when the intersection of
    their sets is at least ``similarity`` of the union; component_id is the smallest doc_id reachable
    over links. Null and empty texts have no set and no links. Rows with a null id are not linked:
    their component is null and they are kept. Rows that repeat an id are one document: each is
    returned, with the component of all texts under that id. An empty table gives no rows.
    """
    percent = round(100 * similarity)
    feats = stage(_features(docs, id_col, text_col, k), "signatures")
    nodes = stage(feats.where("n_shingles > 0 and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node"), F.min("sign").alias("sign"), F.min("n_shingles").alias("n_shingles")), "nodes")
    signs = nodes.select("node", "sign")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.array([np.frombuffer(x, np.uint16) for x in batch.column(c).to_pylist()], np.uint16).reshape(len(batch), -1) for c in (2, 3))
            close = (left != right).sum(1) <= FAR * left.shape[1] if len(batch) else np.zeros(0, bool)
            yield batch.select([0, 1]).filter(pa.array(close))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            true = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = int(np.isin(x, y, assume_unique=True, kind="sort").sum()) if len(x) and len(y) else 0
                true.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield batch.select([0, 1]).filter(pa.array(true, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        left = signs.select(F.col("node").alias("a"), F.col("sign").alias("sign_a"))
        right = signs.select(F.col("node").alias("b"), F.col("sign").alias("sign_b"))
        close = stage(pairs.join(left, "a").join(right, "b").select("a", "b", "sign_a", "sign_b").mapInArrow(near, "a long, b long"), "close")
        involved = close.select(F.col("a").alias(id_col)).distinct().unionByName(close.select(F.col("b").alias(id_col)).distinct())
        sets = stage(_sets(with_ids(docs, involved, id_col), id_col, text_col, k), "sets")
        set_a = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
        set_b = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
        return close.join(set_a, "a").join(set_b, "b").select("a", "b", "set_a", "set_b").mapInArrow(confirm, "a long, b long").distinct()

    def across(apart: DataFrame) -> DataFrame:
        own = apart.join(signs.withColumnRenamed("node", "id"), "id").select("key", "id", "component", "sign")
        return verify(stage(own.repartition("key").sortWithinPartitions("key").mapInArrow(_close_pairs, "a long, b long").distinct(), "near-pairs"))

    def in_blocks(blocks: DataFrame) -> DataFrame:
        sets = _sets(with_ids(docs, blocks.select(F.col("id").alias(id_col)), id_col), id_col, text_col, k)
        pair = blocks.join(sets, "id").select("group", "i", "j", "left", "id", "component", "set")
        return pair.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(lambda batches: _linked_blocks(batches, percent), "a long, b long")

    weights = nodes.select(F.col("node").alias("id"), F.col("n_shingles").alias("weight"))
    groups = link_components(_keys(nodes), across, verify, in_blocks, "near", weights)
    own = nodes.select("print", "node").join(groups, F.col("node") == F.col("id"), "left").select("print", F.coalesce("component", "node").alias("component"))
    found = feats.join(own, "print", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of near copies; see :func:`near_groups`.

    Rows are judged one by one, also where they repeat an id: the one with the smallest id of a group stays, any one of
    those that share it. Rows with a null id or without words stay.
    """
    rows, key = row_keys(docs, id_col)
    groups = near_groups(rows, key, text_col, **options)
    return without_ids(rows, groups.where(~F.col("kept")).select(F.col("doc_id").alias(key)), key).select(*docs.columns)
