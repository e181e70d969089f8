"""Token ids of Arrow text columns by the ``tokenizers`` library.

A byte-level BPE vocabulary encodes each pre-token by itself, so equal pre-tokens have equal ids. A
worker splits a slice of texts into pre-tokens with numpy, looks them up in a table of pre-tokens met
before by a 64-bit hash of their bytes (see ``hash_runs``), compares their bytes, and calls the library for
new ones only. Texts that hold a pre-token whose hash is another's, or the string of an added (special)
token, and texts with code points outside ``_STABLE`` (whose classes may depend on a Unicode version), are
encoded by the library as a whole.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .words import hash_runs, same_runs, slices

END_ID = 2
#: Pre-tokens, and other strings, that a worker remembers the ids of; at that many it starts anew.
MAX_PIECES, MAX_STRINGS = 1 << 20, 3 << 18

#: Pre-tokens that go to the library as one text.
JOINED = 1000

_LETTER, _NUMBER, _OTHER, _SPACE, _UNSURE = range(5)
#: Code points whose class is the same in all Unicode versions of the last decades.
_STABLE = [(0, 0x250), (0x2000, 0x2060)]


def _classes() -> np.ndarray:
    import regex

    out = np.full(0x10000, _UNSURE, np.uint8)
    for lo, hi in _STABLE:
        for c in range(lo, hi):
            s = chr(c)
            out[c] = _LETTER if regex.match(r"\p{L}", s) else _NUMBER if regex.match(r"\p{N}", s) else _SPACE if regex.match(r"\p{White_Space}", s) else _OTHER
    return out


class _Numbers(dict):
    """Numbers strings in the order in which they are first asked for."""

    def __missing__(self, string: str) -> int:
        self[string] = number = len(self)
        return number


class Memory:
    """Ids of up to ``MAX_STRINGS`` strings met before; ``learn`` gives the ids of new strings, put together, and the number of each."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.learn = learn
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.first = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def ids(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings, and the number of each string's."""
        if len(self.numbers) > MAX_STRINGS:
            self._clear()
        known = len(self.numbers)
        number = np.fromiter(map(self.numbers.__getitem__, strings), np.int64, len(strings))
        if len(self.numbers) > known:
            new = np.flatnonzero(number >= known)
            _, one = np.unique(number[new], return_index=True)
            ids, counts = self.learn([strings[k] for k in new[one].tolist()])
            self.flat = np.concatenate([self.flat, ids])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
        lengths = self.first[number + 1] - self.first[number]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.first[number] - (ends - lengths), lengths)], lengths


class Encoder:
    """Ids of whole texts; one per worker and vocabulary.

    With ``plain``, the strings of added tokens are ordinary text.
    """

    _made: dict[tuple[str, bool], "Encoder"] = {}

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.added = [] if plain else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each token, a character each
        self.size[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.classes = _classes()
        self._clear()

    @classmethod
    def of(cls, path: str, plain: bool = False) -> "Encoder":
        if (path, plain) not in cls._made:
            cls._made[path, plain] = cls(path, plain)
        return cls._made[path, plain]

    def _clear(self) -> None:
        self.slots = np.zeros(1 << 18, np.uint64)
        self.value = np.zeros(1 << 18, np.int32)
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.raw = np.zeros(8, np.uint8)  # bytes of the known pre-tokens, and eight more
        self.raw_first = np.zeros(1, np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each pre-token, -1 where it is new."""
        mask = np.uint64(len(self.slots) - 1)
        at = (h & mask).astype(np.int64)
        got = self.slots[at]
        out = np.where(got == h, self.value[at], -1)
        left = np.flatnonzero((got != h) & (got != 0))
        while len(left):
            at[left] = (at[left] + 1) & int(mask)
            got = self.slots[at[left]]
            out[left] = np.where(got == h[left], self.value[at[left]], -1)
            left = left[(got != h[left]) & (got != 0)]
        return out

    def _place(self, h: np.ndarray, number: np.ndarray) -> None:
        size = len(self.slots)
        at = (h & np.uint64(size - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.slots[at[left]] == 0]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.slots[at[put]] = h[put]
            self.value[at[put]] = number[put]
            left = left[self.slots[at[left]] != h[left]]
            at[left] = (at[left] + 1) & (size - 1)

    def _ids_of(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens by the library, and the number of each one's.

        Those that are a blank and letters stay pre-tokens when they are put together, so they go as longer texts.
        """
        joins = np.array([x[0] == " " and x[1:].isalpha() for x in strings], bool)
        counts = np.zeros(len(strings), np.int64)
        words = [strings[k] for k in np.flatnonzero(joins).tolist()]
        texts = ["".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)]
        joined = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))])
        ends = np.cumsum([len(x.encode()) for x in words])
        counts[joins] = np.diff(np.searchsorted(np.cumsum(self.size[joined]), ends, "right"), prepend=0)
        made = self.tokenizer.encode([strings[k] for k in np.flatnonzero(~joins).tolist()], is_pretokenized=True, add_special_tokens=False)
        counts[~joins] = np.bincount(np.array(made.word_ids, np.int64), minlength=int((~joins).sum()))
        ids, of_joined = np.zeros(int(counts.sum()), np.uint32), np.repeat(joins, counts)
        ids[of_joined], ids[~of_joined] = joined, np.array(made.ids, np.uint32)
        return ids, counts

    def _learn(self, h: np.ndarray, strings: list[str]) -> None:
        ids, counts = self._ids_of(strings)
        self.ids = np.concatenate([self.ids, ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
        number = np.arange(len(self.known), len(self.known) + len(h), dtype=np.int32)
        self.known = np.concatenate([self.known, h])
        self.raw = np.concatenate([self.raw[:-8], np.frombuffer("".join(strings).encode() + bytes(8), np.uint8)])
        self.raw_first = np.concatenate([self.raw_first, self.raw_first[-1] + np.cumsum([len(x.encode()) for x in strings])])
        if 2 * len(self.known) > len(self.slots):
            size = len(self.slots)
            while 2 * len(self.known) > size:
                size *= 2
            self.slots, self.value = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._place(self.known, np.arange(len(self.known), dtype=np.int32))
        else:
            self._place(h, number)

    def _added(self, data: np.ndarray) -> np.ndarray:
        """Where the string of an added token begins."""
        raw, out = data.tobytes(), []
        for token in self.added:
            p = raw.find(token)
            while p >= 0:
                out.append(p)
                p = raw.find(token, p + 1)
        return np.array(out, np.int64)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and the number of each."""
        n = len(at) - 1
        text = data.tobytes().decode("utf-8")
        if not text:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        head = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = head[at]
        kind = self.classes[np.minimum(cp, 0xFFFF)]
        total = len(cp)
        begins = np.zeros(total + 1, bool)
        begins[at[:-1]] = True
        begins[total] = True
        space = kind == _SPACE
        after = np.zeros(total, bool)  # a blank before something else of the same text
        after[:-1] = space[:-1] & ~space[1:] & ~begins[1:-1]
        start = begins[:-1].copy()
        change = kind[1:] != kind[:-1]
        start[1:] |= change & (space[1:] | (cp[:-1] != 32))
        start |= after
        quote = np.flatnonzero((cp[:-1] == 39) & start[:-1])
        if len(quote):
            padded = np.concatenate([cp, np.zeros(3, np.uint32)])
            same = ~np.concatenate([begins[1:], [True, True, True]])
            a, b = padded[quote + 1], padded[quote + 2]
            two = np.isin(a, [115, 116, 109, 100]) & same[quote]
            three = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & same[quote] & same[quote + 1]
            for hit, size in ((two, 2), (three & ~two, 3)):
                q = quote[hit]
                start[q + 1] = False
                q = q[q + size < total]
                q = q[~begins[q + size]]
                start[q[kind[q + size] == _LETTER] + size] = True
        first = np.flatnonzero(start)
        size = np.diff(np.concatenate([first, [total]]))
        byte = np.concatenate([np.flatnonzero((data & 0xC0) != 0x80), [len(data)]])  # where each code point begins
        begin, n_bytes = byte[first], byte[first + size] - byte[first]
        h = hash_runs(data, begin, n_bytes) | np.uint64(1)
        number = self._find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh, one = np.unique(h[new], return_index=True)
            if len(self.known) + len(fresh) > MAX_PIECES and len(self.known):
                self._clear()
                fresh, one = np.unique(h, return_index=True)
                new = np.arange(len(h))
            one = new[one]
            self._learn(fresh, [text[a : a + n] for a, n in zip(first[one].tolist(), size[one].tolist(), strict=True)])
            number = self._find(h)
        lengths = self.first[number + 1] - self.first[number]
        ends = np.cumsum(lengths)
        ids = self.ids[np.arange(int(ends[-1])) + np.repeat(self.first[number] - (ends - lengths), lengths)]
        before = np.concatenate([[0], ends])
        counts = np.diff(before[np.searchsorted(first, at)])
        other = self.raw_first[number]
        clash = self.raw_first[number + 1] - other != n_bytes
        clash |= ~same_runs(data, begin, np.where(clash, 0, n_bytes), self.raw, other)
        unsure = np.concatenate([np.flatnonzero(kind == _UNSURE), head[self._added(data)], first[clash]])
        unsure = np.unique(np.searchsorted(at, unsure, "right") - 1)
        if len(unsure):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            whole = self.tokenizer.encode_batch_fast([text[at[d] : at[d + 1]] for d in unsure.tolist()], add_special_tokens=False)
            for d, made in zip(unsure.tolist(), whole, strict=True):
                parts[d] = np.array(made.ids, np.uint32)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts


def encode_column(column: pa.Array, path: str, end_id: int = END_ID):
    """For each slice of rows: first and last row, ids with the end id after each text, their number."""
    encoder = Encoder.of(path)
    for i, j, data, at in slices(column):
        ids, counts = encoder.encode(data, at)
        full = np.empty(len(ids) + len(counts), np.uint32)
        last = np.cumsum(counts + 1) - 1
        body = np.ones(len(full), bool)
        body[last] = False
        full[last] = end_id
        full[body] = ids
        yield i, j, full, counts + 1
