"""Benchmark decontamination by size-partitioned MinHash containment search.

A benchmark item is short and a document long, so the Jaccard similarity of the two says little and
signatures of whole documents would need thousands of hash functions. Containment MinHash (Koslicki
and Zabeti, 2019) sketches the short side alone: the shingles of an item that are smallest under k
hash functions are looked up among all shingles of the document. Items are partitioned by size, and
each partition takes hash functions until every item of it has more distinct sketch shingles than
it may miss; a document that holds the asked share of an item then holds a sketch shingle of it, so
no pair is lost. A document with fewer shingles than the smallest item of a partition needs is not
looked up in it. Candidates are verified by counting all of the item's shingles in the document, first
by hash and then by their words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, row_keys, stage, without_ids
from .words import distinct_sets, mix, shingles, slices, words

SHINGLE, CONTAINMENT = 5, 0.8
#: Shingles of all items that a task may hold (16 bytes each); longer lists are searched in parts.
MAX_BENCHMARK_SHINGLES = 4_000_000
#: Hash functions that are tried at a time.
HASHES = 8
_BLANKS = re.compile("[\x20\x09-\x0d]+")


def sketch(items: list[np.ndarray], share: float) -> list[np.ndarray]:
    """For each set the distinct shingles that are smallest under the hash functions of its size class.

    A document with ``share`` of an item's n shingles misses at most n - need of them, where need
    is the least number that reaches the share; a sketch of n - need + 1 shingles hits it for sure.
    """
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(items)
    classes: dict[int, list[int]] = {}
    for i, x in enumerate(items):
        if len(x):
            classes.setdefault(len(x).bit_length(), []).append(i)
    for members in classes.values():
        missing = {i: len(items[i]) - _need(len(items[i]), share) + 1 for i in members}
        chosen: dict[int, set[int]] = {i: set() for i in members}
        k = 0
        while any(len(chosen[i]) < missing[i] for i in members) and k < 4096:
            for j in range(k, k + HASHES):
                seed = np.full(1, j + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for i in members:
                    chosen[i].add(int(items[i][np.argmin(mix(items[i] ^ seed))]))
            k += HASHES
        for i in members:
            out[i] = np.array(sorted(chosen[i]), np.uint64) if len(chosen[i]) >= missing[i] else items[i]
    return out


def _need(n: int, share: float) -> int:
    """The least number of n shingles that is ``share`` of them; exact for shares of whole percent."""
    percent = round(share * 100)
    return -(-n * percent // 100)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = CONTAINMENT, k: int = SHINGLE) -> DataFrame:
    """One row per document and benchmark item of which it holds at least ``share`` of the shingles:
    ``doc_id, item_id, n_shingles, n_found``.

    Words are runs without blanks, compared unchanged; a text with fewer than ``k`` words is one
    shingle, so such an item is found only in documents that are it. Null and empty texts and items
    match nothing. Repeated documents give repeated rows; repeated items give the row of each.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item_col).cast("long"), F.coalesce(F.col(item_text), F.lit("")))
    bound = rows.select(F.sum(F.size(F.split(F.col(rows.columns[1]), "\\s+")))).first()[0] or 0
    parts = -(-bound // MAX_BENCHMARK_SHINGLES) or 1
    found = None
    for p in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64(F.col(rows.columns[0])), F.lit(parts)) == p)
        ids, texts = zip(*((a, b) for a, b in own.collect()), strict=True) if not own.isEmpty() else ((), ())
        step = _search(docs, id_col, text_col, list(ids), list(texts), share, k)
        found = step if found is None else found.unionByName(step)
    return found


def _worded(text: str, k: int) -> set[tuple[str, ...]]:
    """The shingles of a text as words."""
    w = [x for x in _BLANKS.split(text) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@dataclass
class _Index:
    """A part of the benchmark: sketch shingles by size partition, and each item's shingles."""

    ids: list
    texts: list
    sets: list[np.ndarray]
    need: np.ndarray
    #: For each partition: the least number of shingles that an item needs, sketch shingles (sorted), their items.
    parts: list[tuple[int, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list, texts: list, share: float, k: int) -> "_Index":
        sets: list[np.ndarray] = []
        for _, _, data, at in slices(pa.array(texts, pa.string())):
            h, _, _, counts = words(data, at)
            sets += distinct_sets(*shingles(h, counts, k))
        sketches = sketch(sets, share)
        need = np.array([_need(len(x), share) for x in sets], np.int64)
        parts = []
        for bits in sorted({len(x).bit_length() for x in sets if len(x)}):
            own = [i for i, x in enumerate(sets) if len(x) and len(x).bit_length() == bits]
            probe, owner = np.concatenate([sketches[i] for i in own]), np.repeat(own, [len(sketches[i]) for i in own])
            order = np.argsort(probe, kind="stable")
            parts.append((int(need[own].min()), probe[order], owner[order]))
        return cls(ids, texts, sets, need, parts)

    def candidates(self, sh: np.ndarray, made: np.ndarray) -> set[tuple[int, int]]:
        """Document and item of each sketch shingle that a document holds."""
        out: set[tuple[int, int]] = set()
        doc = np.repeat(np.arange(len(made)), made)
        for least, probe, owner in self.parts:
            own = np.flatnonzero(np.repeat(made >= least, made))
            a = np.searchsorted(probe, sh[own])
            hit = np.flatnonzero(probe[np.minimum(a, len(probe) - 1)] == sh[own])
            b = np.searchsorted(probe, sh[own[hit]], "right")
            for d, s, e in zip(doc[own[hit]].tolist(), a[hit].tolist(), b.tolist(), strict=True):
                out.update((d, int(x)) for x in owner[s:e])
        return out


def _search(docs: DataFrame, id_col: str, text_col: str, ids: list, texts: list, share: float, k: int) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(_Index.of(ids, texts, share, k))  # at most MAX_BENCHMARK_SHINGLES, counted by the caller

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        worded: dict[int, set] = {}
        for batch in batches:
            out: list[tuple] = []
            for i, _, data, at in slices(batch.column(1)):
                h, _, _, counts = words(data, at)
                sh, made = shingles(h, counts, k)
                ends = np.cumsum(made)
                by_doc: dict[int, list[int]] = {}
                for d, item in sorted(own.candidates(sh, made)):
                    by_doc.setdefault(d, []).append(item)
                for d, found in by_doc.items():
                    held = np.unique(sh[ends[d] - made[d] : ends[d]])
                    found = [item for item in found if np.isin(own.sets[item], held, assume_unique=True).sum() >= own.need[item]]
                    said = _worded(data[at[d] : at[d + 1]].tobytes().decode("utf-8"), k) if found else set()
                    for item in found:
                        if item not in worded:
                            worded[item] = _worded(own.texts[item], k)
                        n = len(worded[item] & said)
                        if n >= _need(len(worded[item]), share):
                            out.append((i + d, own.ids[item], len(worded[item]), n))
            if out:
                row, item, n, held_n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (item, n, held_n))], ["doc_id", "item_id", "n_shingles", "n_found"])

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(search, "doc_id long, item_id long, n_shingles long, n_found long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; see :func:`contaminated`.

    Rows are judged one by one, also where they repeat an id; rows with a null id stay.
    """
    rows, key = row_keys(docs, id_col)
    found = stage(contaminated(rows, benchmark, key, text_col, **options).select("doc_id"), "leaks")
    return without_ids(rows, found.withColumnRenamed("doc_id", key), key).select(*docs.columns)
