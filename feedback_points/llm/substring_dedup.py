"""Substring dedup: suffix automata of reference shards, and matching statistics of the documents.

Sending automata of the whole corpus to every document would cost documents times corpus, so the
reference is sharded by content. Each window of ``window`` words belongs to the shard of its
smallest ``GRAM``-word hash; equal windows have the same smallest hash, so a window can only repeat
within its shard. Consecutive windows of one shard form a segment. Shards that a single document
uses are dropped, equal segments are streamed once, and only the words of the first of equal
segments are sent to the shard. A gram whose shard has distinct segments of more than ``HOT_WORDS``
words (counted first) is hot: a window then belongs to its smallest gram that is not hot, and windows
of hot grams alone to a shard of their own, where a frequent passage is one segment in all documents
that hold it, whatever stands around it. Should a shard be too large still, its windows are sharded
one by one, by their words. So no automaton grows with a frequent passage. In a shard
segments come in ascending document id: each is run through the suffix automaton of the smaller
documents' segments, spans whose match is at least ``window`` words long are removed, and then the
segment joins the automaton.

Segments that equal a smaller document's are lost whole. Frequent ones, of which there are at most
``FREQUENT_LIST``, are sent to all tasks with their first document and looked up in the documents' lists
of segments; the others are joined. So what many documents share makes one row per document.

Documents whose words all equal those of a smaller document lose all words (if they have a window)
and take no further part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stage, with_ids, without_ids
from .words import mix, shingles, slices, words

WINDOW, GRAM = 50, 10
#: Words of distinct segments that one automaton may take.
HOT_WORDS = 200_000
#: Occurrences from which a segment is frequent, and the most frequent ones that are sent to all tasks
#: (16 bytes each; a corpus of more segments needs more occurrences, so that there cannot be more).
FREQUENT, FREQUENT_LIST = 64, 500_000


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for the longest string of ``p`` and ``c``, cut off from ``q`` if need be."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            if c in self.next[last]:
                last = self._split(last, self.next[last][c], c)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p != -1:
                self.link[new] = self._split(p, self.next[p][c], c)
            last = new

    def spans(self, sequence: list[int], least: int) -> list[tuple[int, int]]:
        """Maximal spans of positions covered by matches of at least ``least``."""
        moves, link, length = self.next, self.link, self.length
        out: list[tuple[int, int]] = []
        v = n = 0
        for i, c in enumerate(sequence):
            while v and c not in moves[v]:
                v = link[v]
                n = length[v]
            if c in moves[v]:
                v, n = moves[v][c], n + 1
            else:
                v = n = 0
            if n >= least:
                begin = i + 1 - n
                if out and begin <= out[-1][1]:
                    out[-1] = (min(out[-1][0], begin), i + 1)
                else:
                    out.append((begin, i + 1))
        return out


def _window_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` consecutive values."""
    if len(x) < n:
        return x[:0]
    cur, span = x, 1
    while 2 * span <= n:
        cur, span = np.minimum(cur[:-span], cur[span:]), 2 * span
    count = len(x) - n + 1
    return np.minimum(cur[:count], cur[n - span : n - span + count])


@dataclass(frozen=True)
class Hot:
    """What is too large (sorted): grams, and shards that are so with those grams left out."""

    grams: np.ndarray
    shards: np.ndarray


NOT_HOT = Hot(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x if len(sorted_) else np.zeros(len(x), bool)


def segments(h: np.ndarray, counts: np.ndarray, window: int, gram: int, hot: Hot = NOT_HOT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows with one shard: text, first word (in all), words, shard, content hash."""
    sh, made = shingles(h, counts, gram)
    wide = window - gram + 1
    least = _window_min(sh, wide)
    ends = np.cumsum(made)
    at = np.arange(len(least))
    row = np.repeat(np.arange(len(counts)), made)[: len(least)]
    valid = np.flatnonzero((ends[row] - at >= wide) & (counts[row] >= window)) if len(least) else at
    row, key = row[valid], least[valid]
    new = np.ones(len(valid), bool)
    alone = np.zeros(len(valid), bool)
    if len(hot.grams):
        cold = _window_min(np.where(_among(sh, hot.grams), _TOP, sh), wide)[valid]
        only = cold == _TOP
        key = np.where(only, mix(key ^ np.uint64(1)), cold)
        alone = _among(key, hot.shards)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | alone[1:] | alone[:-1]
    first = np.flatnonzero(new)
    runs = np.diff(np.concatenate([first, [len(valid)]]))
    row, key, alone = row[first], key[first], alone[first]
    word = valid[first] - (ends - made)[row] + (np.cumsum(counts) - counts)[row]
    size = runs + window - 1
    raw = memoryview(np.ascontiguousarray(h)).cast("B")
    content = np.array([int.from_bytes(hashlib.blake2b(raw[8 * w : 8 * (w + n)], digest_size=8).digest(), "little") for w, n in zip(word.tolist(), size.tolist(), strict=True)], np.uint64)
    return row, word, size, np.where(alone, mix(content ^ key), key), content


def _survey(rows: DataFrame, window: int, gram: int, hot: Hot = NOT_HOT) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in slices(batch.column(1)):
                h, _, _, counts = words(data, at)
                row, _, size, key, content = segments(h, counts, window, gram, hot)
                offsets = pa.array(np.searchsorted(row, np.arange(len(counts) + 1)), pa.int32())
                ends = np.cumsum(counts)
                prints = [hashlib.blake2b(h[e - n : e].tobytes(), digest_size=16).digest() for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(key.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(content.view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array(size, pa.int32())),
                    ],
                    ["doc_id", "n_words", "print", "keys", "contents", "sizes"],
                )

    return rows.mapInArrow(run, "doc_id long, n_words long, print binary, keys array<long>, contents array<long>, sizes array<int>")


def _wanted_words(rows: DataFrame, window: int, gram: int, hot: Hot = NOT_HOT) -> DataFrame:
    """Words (hashed) of the listed segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for i, _, data, at in slices(batch.column(1)):
                h, _, _, counts = words(data, at)
                row, word, size, key, content = segments(h, counts, window, gram, hot)
                ends = np.searchsorted(row, np.arange(len(counts) + 1))
                pick = [np.zeros(0, np.int64)]
                for d in range(len(counts)):
                    own = np.arange(ends[d], ends[d + 1])
                    _, one = np.unique(content[own], return_index=True)
                    own = own[one]
                    pick.append(own[np.isin(content[own].view(np.int64), lists[i + d].values.to_numpy())])
                at_ = np.concatenate(pick)
                if len(at_):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key[at_].view(np.int64)), pa.array(content[at_].view(np.int64)), batch.column(0).take(pa.array(i + row[at_])),
                            pa.array([h[w : w + n].tobytes() for w, n in zip(word[at_].tolist(), size[at_].tolist(), strict=True)], pa.binary()),
                        ],
                        ["key", "content", "doc_id", "words"],
                    )

    return rows.mapInArrow(run, "key long, content long, doc_id long, words binary")


def _match(sent: DataFrame, window: int) -> DataFrame:
    """For each segment the spans that smaller documents of its shard hold; needs key and id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = doc = None
        automaton, waiting = SuffixAutomaton(), []
        for batch in batches:
            out = []
            for k, c, d, raw in zip(*(batch.column(x).to_pylist() for x in range(4)), strict=True):
                if k != key:
                    automaton, waiting = SuffixAutomaton(), []
                elif d != doc:
                    for seq in waiting:
                        automaton.add(seq)
                    waiting = []
                key, doc = k, d
                seq = np.frombuffer(raw, np.uint64).tolist()
                found = automaton.spans(seq, window)
                out.append((k, c, d, np.array(found, np.int32).tobytes()))
                waiting.append(seq)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "content", "first", "spans"])

    return sent.mapInArrow(run, "key long, content long, first long, spans binary")


def _apply(rows: DataFrame, window: int, gram: int, hot: Hot = NOT_HOT) -> DataFrame:
    """Removes words; ``rows`` has id, text, and the contents and spans that the text loses (null: whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            for i, j, data, at in slices(batch.column(1)):
                h, begin, end, counts = words(data, at)
                drop = np.zeros(len(h) + 1, np.int64)
                if hit[i:j].any():
                    row, word, size, _, content = segments(h, counts, window, gram, hot)
                    ends = np.searchsorted(row, np.arange(len(counts) + 1))
                    for d in np.flatnonzero(hit[i:j]).tolist():
                        lost = {c: s for c, s in zip(batch.column(2)[i + d].as_py(), batch.column(3)[i + d].as_py(), strict=True)}
                        for s in range(ends[d], ends[d + 1]):
                            c = int(content[s].astype(np.int64))
                            if c in lost:
                                spans = [(0, int(size[s]))] if lost[c] is None else np.frombuffer(lost[c], np.int32).reshape(-1, 2).tolist()
                                for a, b in spans:
                                    drop[word[s] + a] += 1
                                    drop[word[s] + b] -= 1
                gone = np.cumsum(drop[:-1]) > 0
                raw, last = data.tobytes(), 0
                texts, removed = [], []
                begins, stops = begin.tolist(), end.tolist()
                for n in counts.tolist():
                    lost_here = gone[last : last + n]
                    removed.append(int(lost_here.sum()))
                    kept = range(last, last + n) if not removed[-1] else (last + np.flatnonzero(~lost_here)).tolist()
                    texts.append(b" ".join([raw[begins[w] : stops[w]] for w in kept]).decode("utf-8"))
                    last += n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def _shards(survey: DataFrame, copies: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments of each document, distinct segments, and the shards that more than one document uses."""
    own = without_ids(survey.where(f"doc_id is not null and n_words >= {window}").select("doc_id", "keys", "contents", "sizes"), copies)
    used = own.select("doc_id", F.explode(F.arrays_zip("keys", "contents", "sizes")).alias("s")).select("doc_id", F.col("s.keys").alias("key"), F.col("s.contents").alias("content"), F.col("s.sizes").alias("size"))
    distinct = used.groupBy("key", "content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    by_shard = stage(distinct, "segments")
    shards = by_shard.groupBy("key").agg(F.min("first").alias("lo"), F.max("last").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).where("lo < hi")
    return used.drop("size"), by_shard, shards


def _too_large(shards: DataFrame) -> np.ndarray:
    return np.sort(np.array([r[0] for r in shards.where(F.col("words") > HOT_WORDS).select("key").collect()], np.int64).view(np.uint64))


def _frequent(by_shard: DataFrame) -> tuple[Column, pa.Table]:
    """Which rows of ``by_shard`` are frequent, and their contents and first documents, by content."""
    rows = by_shard.agg(F.sum("rows")).first()[0] or 0
    frequent = (F.col("rows") >= max(FREQUENT, -(-rows // FREQUENT_LIST))) & (F.col("first") < F.col("last"))
    return frequent, by_shard.where(frequent).select("content", "first").toArrow().sort_by("content")


def _frequent_losses(survey: DataFrame, table: pa.Table) -> DataFrame:
    """``doc_id, contents`` of documents with frequent segments that a smaller document has."""
    sent = survey.sparkSession.sparkContext.broadcast((table["content"].to_numpy(), table["first"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, first = sent.value
        for batch in batches:
            own, sizes = batch.column(1).flatten(), pc.list_value_length(batch.column(1)).to_numpy()
            at = np.minimum(np.searchsorted(content, own.to_numpy()), len(content) - 1)
            row = np.repeat(np.arange(len(sizes)), sizes)
            hit = (content[at] == own.to_numpy()) & (first[at] < batch.column(0).to_numpy()[row])
            docs, counts = np.unique(row[hit], return_counts=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs)), pa.ListArray.from_arrays(offsets, own.filter(pa.array(hit)))], ["doc_id", "contents"])

    return survey.select("doc_id", "contents").mapInArrow(run, "doc_id long, contents array<long>")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_text`` (kept words joined by a blank).

    Words are runs without blanks, compared unchanged. A word goes when a run of ``window`` words
    around it also stands in a document with a smaller id. Null and empty texts have no words. Rows
    with a null id are neither changed nor used as a reference; rows that repeat an id are no
    smaller than each other. Other columns are ignored; an empty table gives no rows.
    """
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    survey = stage(_survey(rows, window, gram), "survey")
    owners = survey.where(f"doc_id is not null and n_words >= {window}").groupBy("print").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    # an id of several rows takes the usual way, since what is said of one row does not hold for the others
    several = survey.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    copied = survey.where(f"doc_id is not null and n_words >= {window}").join(owners.where("owner < last"), "print").where("doc_id > owner").select("doc_id", "n_words")
    copies = stage(copied.join(several, "doc_id", "left_anti"), "copies")
    used, by_shard, shards = _shards(survey, copies, window)
    # each has more than HOT_WORDS words, so the lists are short beside the corpus
    grams = _too_large(shards)
    hot = Hot(grams, NOT_HOT.shards)
    if len(grams):
        survey = stage(_survey(without_ids(rows, copies), window, gram, hot), "hot-survey")
        used, by_shard, shards = _shards(survey, copies, window)
        hot = Hot(grams, _too_large(shards))
        if len(hot.shards):
            survey = stage(_survey(without_ids(rows, copies), window, gram, hot), "hot-survey")
            used, by_shard, shards = _shards(survey, copies, window)
    shared = stage(by_shard.join(shards.select("key", "n"), "key"), "shared")

    send = stage(shared.where("n > 1").groupBy("first").agg(F.collect_list("content").alias("wanted")).withColumnRenamed("first", "doc_id"), "wanted")
    texts = with_ids(rows, send).join(send, "doc_id").select("doc_id", "text", "wanted")
    sent = _wanted_words(texts, window, gram, hot).dropDuplicates(["key", "content"])
    ordered = sent.repartition("key").sortWithinPartitions("key", "doc_id")
    matched = stage(_match(ordered, window), "matched")

    # what each document loses: whole segments that a smaller document has, else the matched spans
    frequent, table = _frequent(by_shard)
    first_only = matched.where(F.length("spans") > 0).select(F.col("first").alias("doc_id"), F.array("content").alias("contents"), F.array("spans").alias("spans"))
    rare = shared.where(F.col("first") < F.col("last")).where(~frequent).select("key", "content", "first")
    whole = used.join(rare, ["key", "content"]).where("doc_id > first").select("doc_id", F.array("content").alias("contents"))
    if table.num_rows:
        own = without_ids(survey.where(f"doc_id is not null and n_words >= {window}").select("doc_id", "contents"), copies)
        whole = whole.unionByName(_frequent_losses(own, table))
    lost = whole.select("doc_id", "contents", F.transform("contents", lambda _: F.lit(None).cast("binary")).alias("spans")).unionByName(first_only)
    losses = stage(
        lost.groupBy("doc_id").agg(F.collect_set(F.struct("contents", "spans")).alias("lost"))
        .select("doc_id", F.flatten("lost.contents").alias("contents"), F.flatten("lost.spans").alias("spans")), "losses",
    )
    empty = [F.lit(None).cast("array<long>").alias("contents"), F.lit(None).cast("array<binary>").alias("spans")]
    rest = without_ids(rows, copies)
    changed = _apply(with_ids(rest, losses).join(losses, "doc_id").select("doc_id", "text", "contents", "spans"), window, gram, hot)
    same = _apply(without_ids(rest, losses).select("doc_id", "text", *empty), window, gram, hot)
    gone = copies.select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit("").alias("kept_text"))
    return same.unionByName(changed).unionByName(gone)
