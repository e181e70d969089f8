"""Alignment of the tokens of two tokenizers by divide and conquer at shared cuts.

Both tokenizers encode a blank and the text. A byte offset where a token of either ends is a shared cut.
Each text starts as one interval of tokens of both sides. From the middle of an interval outwards, ends of
its first side are looked up among those of the second by bisection; the first one found cuts the
interval in two, and both halves go on. An interval without a cut inside is a leaf: a group of tokens
that only correspond as a whole. All intervals of a slice of texts take each step together.

In a group every end of a token inside is the end of one side only, so the overlapping pairs of
tokens are found by walking the ends of both sides in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stage
from .pieces import PieceEncoder
from .tokens import Encoder
from .words import slices

#: Pairs of ids that are sent to all tasks at most: those that the most documents hold.
FREQUENT_PAIRS = 100_000


def _byte_level(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens of a byte-level vocabulary put together, and where each id's begin."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}
    vocabulary = Encoder.of(path, plain=True).tokenizer.get_vocab(with_added_tokens=False)
    size = max(vocabulary.values()) + 1
    names = [""] * size
    for name, i in vocabulary.items():
        names[i] = name
    return _table([bytes(byte_of[c] for c in name) if set(name) <= byte_of.keys() else name.encode() for name in names])


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def _spelled(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens of a list of ids, and the number of each token's."""
    flat, first = table
    size = first[ids.astype(np.int64) + 1] - first[ids]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(first[ids] - (ends - size), size)], size


def shared_cuts(a_end: np.ndarray, b_end: np.ndarray, a_count: np.ndarray, b_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens (places in either side) whose ends cut the texts into groups, in order.

    ``a_end`` and ``b_end`` are ascending byte ends over all texts, the counts are of the tokens of each
    text; a text has tokens on both sides or on none, and its last ends are equal.
    """
    some = a_count > 0
    hi, b_hi = np.cumsum(a_count)[some], np.cumsum(b_count)[some]
    lo, b_lo = hi - a_count[some], b_hi - b_count[some]
    cuts_a, cuts_b = [hi - 1], [b_hi - 1]
    while True:
        open_ = (hi - lo > 1) & (b_hi - b_lo > 1)  # else a leaf
        lo, hi, b_lo, b_hi = lo[open_], hi[open_], b_lo[open_], b_hi[open_]
        if not len(lo):
            break
        middle = (lo + hi - 1) // 2
        cut_a, cut_b = np.full(len(lo), -1), np.full(len(lo), -1)
        left, step = np.arange(len(lo)), 0
        while len(left):
            for place in (middle[left] + step, middle[left] - step) if step else (middle[left],):
                inside = (cut_a[left] < 0) & (place >= lo[left]) & (place < hi[left] - 1)
                who, place = left[inside], place[inside]
                found = np.minimum(np.searchsorted(b_end, a_end[place]), len(b_end) - 1)
                hit = b_end[found] == a_end[place]
                cut_a[who[hit]], cut_b[who[hit]] = place[hit], found[hit]
            step += 1
            left = left[(cut_a[left] < 0) & ((middle[left] + step < hi[left] - 1) | (middle[left] - step >= lo[left]))]
        cut = cut_a >= 0
        lo, hi, b_lo, b_hi, cut_a, cut_b = (x[cut] for x in (lo, hi, b_lo, b_hi, cut_a, cut_b))
        cuts_a.append(cut_a)
        cuts_b.append(cut_b)
        lo, hi = np.concatenate([lo, cut_a + 1]), np.concatenate([cut_a + 1, hi])
        b_lo, b_hi = np.concatenate([b_lo, cut_b + 1]), np.concatenate([cut_b + 1, b_hi])
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


class Aligner:
    """Tables of both vocabularies; one per worker."""

    _made: dict[tuple[str, str], "Aligner"] = {}

    def __init__(self, byte_level: str, model: str):
        self.a, self.b = Encoder.of(byte_level, plain=True), PieceEncoder.of(model)
        self.a_bytes, self.b_bytes = _byte_level(byte_level), _table(self.b.raw)
        names = lambda table, end: np.array([f"{i}{end}" for i in range(len(table[1]) - 1)], object)
        self.a_next, self.a_last = names(self.a_bytes, ","), names(self.a_bytes, "|")
        self.b_next, self.b_last = names(self.b_bytes, ","), names(self.b_bytes, ";")

    @classmethod
    def of(cls, byte_level: str, model: str) -> "Aligner":
        if (byte_level, model) not in cls._made:
            cls._made[byte_level, model] = cls(byte_level, model)
        return cls._made[byte_level, model]

    def align(self, data: np.ndarray, at: np.ndarray) -> dict[str, list | np.ndarray | pa.Array]:
        """The columns of ``align_tokens`` for a slice of texts, which already begin with a blank."""
        n = len(at) - 1
        a_ids, a_count = self.a.encode(data, at)
        text, places = data.tobytes(), at.tolist()
        b_ids, b_count = self.b.encode([text[i + 1 : j].decode("utf-8") for i, j in zip(places[:-1], places[1:], strict=True)])
        a_raw, a_size = _spelled(a_ids, self.a_bytes)
        b_raw, b_size = _spelled(b_ids, self.b_bytes)
        true = np.diff(at) > 0
        for raw, size, count in ((a_raw, a_size, a_count), (b_raw, b_size, b_count)):
            ends = np.concatenate([[0], np.cumsum(size)])
            edge = ends[np.concatenate([[0], np.cumsum(count)])]
            if len(raw) == len(data) and (edge == at).all():
                wrong = np.flatnonzero(raw != data)
                true[np.unique(np.searchsorted(at, wrong, "right") - 1)] = False
            else:
                edge = edge.tolist()
                true &= [raw[edge[d] : edge[d + 1]].tobytes() == text[places[d] : places[d + 1]] for d in range(n)]
        if not true.all():
            keep_a, keep_b = np.repeat(true, a_count), np.repeat(true, b_count)
            a_ids, a_size, b_ids, b_size = a_ids[keep_a], a_size[keep_a], b_ids[keep_b], b_size[keep_b]
            a_count, b_count = a_count * true, b_count * true
        a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
        a_cut, b_cut = shared_cuts(a_end, b_end, a_count, b_count)
        text_of = lambda place, count: np.searchsorted(np.cumsum(count), place, "right")
        groups = np.bincount(text_of(a_cut, a_count), minlength=n)

        # groups as text: the ids of A, a bar, those of B, a semicolon
        a_group, b_group = np.searchsorted(a_cut, np.arange(len(a_ids))), np.searchsorted(b_cut, np.arange(len(b_ids)))
        said = np.empty(len(a_ids) + len(b_ids), object)
        b_before, a_until = np.concatenate([[0], b_cut + 1]), a_cut + 1
        a_place, b_place = np.arange(len(a_ids)) + b_before[a_group], np.arange(len(b_ids)) + a_until[b_group] if len(a_ids) else np.arange(0)
        said[a_place], said[b_place] = self.a_next[a_ids], self.b_next[b_ids]
        said[a_place[a_cut]], said[b_place[b_cut]] = self.a_last[a_ids[a_cut]], self.b_last[b_ids[b_cut]]
        edge = np.concatenate([[0], np.cumsum(a_count + b_count)]).tolist()
        texts = ["".join(said[i:j])[:-1] for i, j in zip(edge[:-1], edge[1:], strict=True)]

        # links: between two ends that follow each other, one token of A lies over one of B
        ends = np.union1d(a_end, b_end)
        a_at, b_at = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        doc = text_of(a_at, a_count)
        code = a_ids[a_at].astype(np.int64) << 32 | b_ids[b_at].astype(np.int64)
        order = np.lexsort((code, doc))
        doc, code = doc[order], code[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        offsets = pa.array(np.searchsorted(doc[first], np.arange(n + 1)), pa.int32())
        return {
            "n_a": a_count, "n_b": b_count, "n_groups": groups, "n_links": np.bincount(doc, minlength=n), "groups": texts,
            "pairs": pa.ListArray.from_arrays(offsets, pa.array(code[first])), "times": pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.concatenate([first, [len(code)]])), pa.int32())),
        }


SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def align_tokens(docs: DataFrame, byte_level: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: numbers of tokens, groups and links, the groups and the linked id pairs.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` in the order of the text. ``pairs`` are the distinct linked pairs of
    ids (A's in the upper 32 bits), ``times`` says how many links have each. Texts that are null, empty or not
    what the tokens of either side spell have no tokens. Special tokens' strings are ordinary text. Repeated
    rows and null ids stay; other columns are ignored; both vocabularies are paths on every machine.
    """
    kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(byte_level, model)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            led = pc.if_else(pc.equal(text, ""), text, pc.binary_join_element_wise(pa.scalar("", text.type), text, pa.scalar(" ", text.type)))
            for i, j, data, at in slices(led):
                made = aligner.align(data, at)
                columns = [batch.column(0).slice(i, j - i), *(made[c] for c in names[1:])]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, docs, best`` (staged): how many documents hold a linked pair, and whether none of A's id has more."""
    counts = stage(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")), "pair-counts")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))  # at most a row per id of A
    return stage(counts.withColumn("a", a).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "pair-best")


def _frequent(counts: DataFrame, limit: int) -> int:
    """From how many documents on there are at most ``limit`` pairs."""
    steps = counts.groupBy(F.floor(F.log2("docs") * 8).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("docs").alias("least")).collect()  # eight a power of two
    least, held = None, 0
    for step in sorted(steps, key=lambda r: -r["step"]):
        held += step["n"]
        if held > limit:
            break
        least = step["least"]
    return least if least is not None else 1 << 62


def score_links(aligned: DataFrame, limit: int = FREQUENT_PAIRS) -> DataFrame:
    """``aligned`` (staged, with a number ``row`` of each row) with ``n_best``, links of the corpus's most frequent pairs of their A id, and ``count_sum``.

    The pairs of the most documents are sent to all tasks, so no key of the join that remains is held
    by more than a small part of the documents.
    """
    counts = pair_counts(aligned)
    least = _frequent(counts, limit)
    often, rare = counts.where(F.col("docs") >= least), counts.where(F.col("docs") < least)
    kept = [c for c in aligned.columns if c not in ("row", "pairs", "times")]
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    found = links.join(F.broadcast(often), "pair")
    if not rare.isEmpty():
        found = found.unionByName(links.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(rare, "pair"))
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    return aligned.select("row", *kept).join(sums, "row", "left").select(*kept, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")))


def alignment_digest(docs: DataFrame, byte_level: str, model: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    aligned = align_tokens(docs, byte_level, model).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    # rows are numbered where they are written, so that both reads of the table see one numbering
    scored = score_links(stage(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned"))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
