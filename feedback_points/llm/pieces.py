"""SentencePiece models of the BPE kind: exact ids by backtracking, and decoding.

The library merges, again and again, the adjacent symbols whose concatenation is the best piece
(leftmost among equals), from single characters on. The same ids come out without merging whole
texts: a sequence of pieces is what the merges end with if and only if every two neighbours, merged on
their own from characters, end as these two pieces, because merges on either side of a boundary that
nothing crosses do not influence each other. So a text is walked from left to right. An Aho-Corasick
automaton gives the pieces that start at each place; the longest one whose end has not failed and that
is compatible with the piece before is taken. Where none is left, the place is marked as failed in
a bit field and the piece that led there is given up for a shorter one. The sequence that reaches a
place is unique, so a place that failed once never has to be tried again.

Characters that are no piece never merge and become byte pieces. Where no piece holds a blank
behind another character, a text is cut before its blanks, and the ids of chunks are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .tokens import Memory
from .words import slices

BLANK = "▁"
#: Pairs of neighbours whose compatibility a worker remembers, and characters of a chunk that it remembers.
MAX_PAIRS, MAX_CHUNK = 1 << 20, 64


class PieceEncoder:
    """Ids of texts by one model; one per worker and model."""

    _made: dict[str, "PieceEncoder"] = {}

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        model.ParseFromString(self.processor.serialized_model_proto())
        kinds = {p.type for p in model.pieces}
        kind = proto.ModelProto.SentencePiece
        if model.trainer_spec.model_type != 2 or model.trainer_spec.treat_whitespace_as_suffix or kinds & {kind.USER_DEFINED, kind.UNUSED}:
            raise ValueError("only BPE models with normal, byte and control pieces are supported")
        self.plain = model.normalizer_spec.name == "identity" and model.normalizer_spec.add_dummy_prefix and model.normalizer_spec.escape_whitespaces and not model.normalizer_spec.remove_extra_whitespaces
        self.piece = [p.piece for p in model.pieces]
        self.number = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.rank = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        self.single = {p for p in self.number if len(p) == 1}
        self.byte_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.of_byte = {b: i for i, b in self.byte_of.items()}
        self.unknown = self.processor.unk_id()
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(BLANK, " ").encode() for i, p in enumerate(self.piece)]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.number.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.size = [len(p) for p in self.piece]
        # the longest piece that begins each piece and is shorter
        self.shorter = [next((self.number[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.number), -1) for p in self.piece]
        self.fits: dict[int, bool] = {}  # by the ids of both
        inner = any(BLANK in p.lstrip(BLANK) for p in self.number)
        self.cut = re.compile(".+" if inner else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", re.DOTALL)
        self.memory = Memory(self._learn)

    @classmethod
    def of(cls, path: str) -> "PieceEncoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _merged(self, string: str) -> list[str]:
        """What the merges make of a short string."""
        parts, rank, none = list(string), self.rank.get, -float("inf")
        ranks = [rank(a + b, none) for a, b in zip(parts[:-1], parts[1:], strict=True)]  # of each pair of neighbours
        while ranks and (best := max(ranks)) > none:
            k = ranks.index(best)  # the leftmost
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank(parts[k - 1] + parts[k], none)
            if k < len(ranks):
                ranks[k] = rank(parts[k] + parts[k + 1], none)
        return parts

    def _fits(self, before: int, piece: int) -> bool:
        """Whether merges keep the boundary between two pieces (-1: the start) and make the second."""
        want = [self.piece[piece]] if before < 0 else [self.piece[before], self.piece[piece]]
        if len(self.fits) >= MAX_PAIRS:
            self.fits.clear()
        known = self.fits[before << 32 | piece] = self._merged("".join(want)) == want
        return known

    def _backtrack(self, string: str) -> list[int]:
        """Ids of a string of known characters."""
        n, size, shorter, fits = len(string), self.size, self.shorter, self.fits.get
        longest = [-1] * n
        for end, piece in self.automaton.iter(string):
            longest[end + 1 - size[piece]] = piece  # ends ascend, so the longest one stays
        failed, any_failed = bytearray(n // 8 + 1), False
        path: list[int] = []
        at, before, piece = 0, -1, longest[0] if n else -1
        while at < n:
            while piece >= 0:
                end = at + size[piece]
                if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    known = fits(before << 32 | piece)
                    if known or known is None and self._fits(before, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                path.append(piece)
                at, before = end, piece
                piece = longest[at] if at < n else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                piece = path.pop()
                at -= size[piece]
                before = path[-1] if path else -1
                piece = shorter[piece]
        return path

    def _chunk(self, string: str) -> list[int]:
        if self.single.issuperset(string):
            return self._backtrack(string)
        out: list[int] = []
        for known, run in groupby(string, self.single.__contains__):
            run = "".join(run)
            if known:
                out += self._backtrack(run)
            elif self.of_byte:
                out += [self.of_byte[b] for b in run.encode()]
            else:
                out.append(self.unknown)  # a run of unknown characters is one unknown piece
        return out

    def _learn(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [self._chunk(s) for s in strings]
        return np.array([i for ids in made for i in ids], np.uint32), np.array([len(ids) for ids in made], np.int64)

    def _normal(self, text: str) -> str:
        if self.plain:
            return BLANK + text.replace(" ", BLANK) if text else text
        return self.processor.normalize(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, put together, and the number of each text's."""
        chunks = [self.cut.findall(self._normal(t)) for t in texts]
        each = np.array([len(c) for c in chunks], np.int64)
        flat = [s for c in chunks for s in c]
        long = np.flatnonzero(np.fromiter(map(len, flat), np.int64, len(flat)) > MAX_CHUNK).tolist()
        own = {k: self._chunk(flat[k]) for k in long}
        for k in long:
            flat[k] = ""
        ids, counts = self.memory.ids(flat)
        if long:
            begins = np.cumsum(counts) - counts
            ids = np.insert(ids, np.repeat(begins[long], [len(own[k]) for k in long]), [i for k in long for i in own[k]]).astype(np.uint32)
            counts[long] = [len(own[k]) for k in long]
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(before[np.concatenate([[0], np.cumsum(each)])])


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    for i, j, data, at in slices(column):
        text, at = data.tobytes(), at.tolist()
        yield i, j, [text[a:b].decode("utf-8") for a, b in zip(at[:-1], at[1:], strict=True)]


@cache
def _decoder(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def piece_encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` for every row: the ids that the library gives for the whole text.

    No begin or end ids. A null or empty text has no ids; repeated rows and null ids stay; other
    columns are ignored. ``model`` is the path of a BPE model on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(model)
        for batch in batches:
            for i, j, texts in _texts(batch.column(1)):
                ids, counts = encoder.encode(texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32)))], ["doc_id", "ids"])

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def piece_decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` (``doc_id, ids``) with the library's text for each list of ids; a null list has an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _decoder(model)
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()).tolist()
            texts = [processor.decode(flat[i:j].tolist()) for i, j in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def piece_digest(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of decoded rows."""
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return decoded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
