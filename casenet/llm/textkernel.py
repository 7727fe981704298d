"""Vectorised text primitives on the UTF-8 bytes of an Arrow string column.

Words are the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``. A word's
64-bit hash is a sum over its mixed blocks of eight bytes, so a whole chunk of
documents is hashed without a Python loop over words.
Everything here is local to a task; Spark partitions and shuffles the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[ord("A") : ord("Z") + 1] += 32

def flags(characters: bytes) -> np.ndarray:
    """256-entry table that is true for the given bytes."""
    table = np.zeros(256, dtype=bool)
    table[list(characters)] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of about ``limit`` bytes; a null is empty, a longer text stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n, lo + 4096)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@dataclass
class Words:
    """Words of a chunk: byte spans, 64-bit hashes, and ``first[d]:first[d + 1]`` for document ``d``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    data: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span, the same wherever the bytes stand: each eight bytes are mixed with their place in the span and then summed."""
    blocks = (end - start + 7) >> 3
    owner = np.repeat(np.arange(len(start)), blocks)
    first = np.cumsum(blocks) - blocks
    place = np.arange(len(owner)) - first[owner]
    at = start[owner] + 8 * place
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    places = mix(np.arange(1, int(blocks.max(initial=0)) + 1, dtype=U64))
    total = np.zeros(len(start), dtype=U64)
    with np.errstate(over="ignore"):
        value = mix((eight[at] & _FIRST_BYTES[np.minimum(end[owner] - at, 8)]) * _BASE ^ places[place])
        some = np.flatnonzero(blocks)
        if len(some):
            total[some] = np.add.reduceat(value, first[some])
        return mix(total + (end - start).astype(U64))


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        before[edges] = False
        after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, offsets), span_hash(data, start, end), data)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` items from each position on, mixed at each doubling; ``len(hashes) - n + 1`` values (none if too few)."""
    if len(hashes) < n:
        return np.zeros(0, dtype=U64)
    total = len(hashes) - n + 1
    done, result = 0, np.zeros(total, dtype=U64)
    block, size, left = hashes, 1, n
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                result = mix(result * _BASE + block[done : done + total])
                done += size
            left >>= 1
            if left:
                block = mix(block[:-size] * _BASE + block[size:])
                size *= 2
        return mix(result + U64(n))


def whole_windows(first: np.ndarray, n: int) -> np.ndarray:
    """Positions from which ``n`` words lie within one document."""
    total = int(first[-1])
    fits = np.zeros(total, dtype=bool)
    if total >= n:
        room = np.repeat(first[1:], np.diff(first)) - np.arange(total)
        fits = room >= n
    return np.flatnonzero(fits)


@dataclass
class Lines:
    """Lines of a chunk, split at ``\\n``; a document without one is a single line."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def lines(data: np.ndarray, offsets: np.ndarray) -> Lines:
    breaks = np.flatnonzero(data == 10)
    key = np.concatenate([offsets[1:] * 2, breaks * 2 + 1])
    key.sort()
    closes = (key & 1) == 0
    end = key >> 1
    start = np.empty_like(end)
    start[0] = 0
    start[1:] = np.where(closes[:-1], end[:-1], end[:-1] + 1)
    return Lines(start, end, np.concatenate([[0], np.flatnonzero(closes) + 1]))


def running(flag: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flag) + 1, dtype=np.int64)
    np.cumsum(flag, out=total[1:])
    return total


def repeats_earlier(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True where the same value came earlier within the same group."""
    with np.errstate(over="ignore"):
        key = mix(value ^ mix(group.astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] = ranked[1:] == ranked[:-1]
    return again


def repeated(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True where the value occurs twice or more within its group."""
    with np.errstate(over="ignore"):
        key = mix(value ^ mix(group.astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    both = np.zeros(len(key), dtype=bool)
    both[order[1:]] |= same
    both[order[:-1]] |= same
    return both
