"""Vectorised word codes: whole batches of texts become numpy arrays of 64-bit word hashes.

Every function works on one chunk of documents at a time (a few MB of UTF-8 at most, or one
document where that is longer), so a task's memory does not depend on its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i < n."""
    have = _powers.get("p")
    if have is None or len(have[0]) < n:
        most = max(n, CHUNK_BYTES + 64)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        up, down = np.full(most, _BASE), np.full(most, inverse)
        up[0] = down[0] = 1
        have = _powers["p"] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash (shift-multiply rounds)."""
    h = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64), 7)


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` turns two of them into the hash of a span."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * powers(len(buf))[0], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def chunks(sizes: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to ``most`` bytes (one row at least)."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += int(n)
    if len(sizes) > at:
        yield at, len(sizes)


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# The white space that separates words, and the upper-case letters that are folded.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


class Words:
    """Words of one chunk: ``hash``, byte ``start``/``end``, and ``first`` (first word of each document)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, drop: np.ndarray = SPACE):
        """``drop`` marks the bytes that are no part of a word; A-Z is folded to a-z."""
        gap = np.ones(len(buf) + 1, bool)
        gap[:-1] = drop[buf]
        before = np.ones(len(buf) + 1, bool)
        before[1:] = gap[:-1]
        before[offsets] = True  # a document's end is a word's end
        ends_here = gap.copy()
        ends_here[offsets] = True
        starts = np.flatnonzero(before[:-1] & ~gap[:-1])
        after = np.flatnonzero(ends_here)
        self.start = starts
        self.end = after[np.searchsorted(after, starts, side="right")]
        sums = prefix_sums(FOLD[buf])
        self.hash = span_hash(sums, self.start, self.end)
        self.first = np.searchsorted(starts, offsets)


def shingle_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams and the first n-gram of each document.

    A document with fewer than ``n`` words has one shingle, its whole sequence; one without words has none.
    """
    h, first = words.hash, words.first
    count = np.diff(first)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    total = np.zeros(len(h), np.uint64)
    for k in range(n):
        total += mix(padded[k : k + len(h)], 11 + k)
    total = mix(total, 3)
    keep = np.ones(len(h), bool)
    inside = np.arange(len(h)) - np.repeat(first[:-1], count)
    left = np.repeat(count, count) - inside
    keep[(left < n) & (inside > 0)] = False
    for d in np.flatnonzero((count > 0) & (count < n)):
        part = h[first[d] : first[d + 1]]
        total[first[d]] = mix(sum((mix(part[k : k + 1], 11 + k) for k in range(len(part))), np.zeros(1, np.uint64)), 101 + len(part))[0]
    kept = np.concatenate([[0], np.cumsum(keep)])
    return total[keep], kept[first]
