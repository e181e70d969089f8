"""Words and shingles of Arrow text columns, hashed with numpy a few megabytes at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)
#: The first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Runs of more bytes are hashed by blake2b one by one.
LONG_RUN = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    h = h ^ (h >> np.uint64(30))
    h *= _STEPS[0]
    h ^= h >> np.uint64(27)
    h *= _STEPS[1]
    h ^= h >> np.uint64(31)
    return h


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def hash_runs(data: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of bytes, taken eight bytes at a time.

    Runs of up to eight bytes take one-to-one steps, so those of one size never collide. Longer ones go through
    two chains, which are put together last: a step of one chain can be turned back, but runs that meet in
    one still differ in the other, so a collision takes a search among about 2**32 runs.
    """
    out = mix(size.astype(np.uint64) * _STEPS[2] + _STEPS[seed])
    if not len(size):
        return out
    eight = _eights(data)
    out = mix((out ^ (eight[begin] & _FIRST[np.minimum(size, 8)])) * _STEPS[4])
    for i in np.flatnonzero(size > LONG_RUN).tolist():
        run = data[begin[i] : begin[i] + size[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(run, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    live, done = np.flatnonzero((size > 8) & (size <= LONG_RUN)), 8
    if len(live):
        at, rest = begin[live], size[live]
        one, two = out[live], mix(eight[at] * _STEPS[5] + _STEPS[6])
        while len(at):
            word = eight[at + done] & _FIRST[np.minimum(rest - done, 8)]
            one, two = mix((one ^ word) * _STEPS[4]), mix((two + word) * _STEPS[7])
            out[live] = mix(one + (two << np.uint64(17) | two >> np.uint64(47)))
            done += 8
            more = rest > done
            live, at, rest, one, two = live[more], at[more], rest[more], one[more], two[more]
    return out


def same_runs(data: np.ndarray, begin: np.ndarray, size: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each run of ``data`` equals that of the same size in ``other`` (with eight bytes to spare)."""
    a, b = _eights(data), np.ndarray(len(other) - 7, "<u8", np.ascontiguousarray(other), strides=(1,))
    out = (a[begin] ^ b[at]) & _FIRST[np.minimum(size, 8)] == 0
    live, done = np.flatnonzero(size > 8), 8
    while len(live):
        out[live] &= (a[begin[live] + done] ^ b[at[live] + done]) & _FIRST[np.minimum(size[live] - done, 8)] == 0
        done += 8
        live = live[size[live] > done]
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and the last ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row (exclusive), bytes and offsets of pieces of about SLICE_BYTES."""
    data, at = text_buffers(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end (bytes) of every word, and the number of words of each text."""
    full = ~_BLANK[data]
    first, last = full.copy(), full.copy()
    first[1:] &= ~full[:-1]
    last[:-1] &= ~full[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = full[inner]
    last[inner - 1] = full[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(begin, at))
    size = end - begin
    return hash_runs(_LOWER[data] if lower else data, begin, size), begin, end, counts


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each text (a shorter text is one run), and their number."""
    total = len(hashes)
    ends = np.cumsum(counts)
    starts = ends - counts
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    if not total:
        return np.zeros(0, np.uint64), made
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    acc = np.zeros(total, np.uint64)
    salts = [mix(_STEPS[j % 8 : j % 8 + 1] + np.uint64(j))[0] | np.uint64(1) for j in range(k)]
    for j in range(k):
        acc += padded[j : j + total] * salts[j]
    keep = np.repeat(ends, counts) - np.arange(total) >= k
    for n in range(1, k):
        at = starts[counts == n]
        if len(at):
            acc[at] = np.full(1, n, np.uint64) * _STEPS[3] + sum(padded[at + j] * salts[j] for j in range(n))
            keep[at] = True
    return mix(acc[keep]), made


def distinct_sets(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each text."""
    out, at = [], 0
    for n in counts.tolist():
        x = np.sort(hashes[at : at + n])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if n else x)
        at += n
    return out
