"""Array kernels shared by the corpus operators.

A batch of texts is handled as one UTF-8 byte buffer with offsets (Arrow's own layout), so that
splitting into words and hashing cost a few array passes instead of a Python loop over words.
Words are maximal runs of bytes other than the six ASCII blanks (0x20, 0x09-0x0D); UTF-8
continuation bytes are never blanks, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANKS = b" \t\n\x0b\x0c\r"
CHUNK_BYTES = 1 << 20

_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_S32 = np.uint64(32)
_S29 = np.uint64(29)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> _S32)) * _M1
    x = (x ^ (x >> _S29)) * _M2
    return x ^ (x >> _S32)


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``limit`` bytes of text (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = np.cumsum(sizes) // max(1, limit)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each text starts (n + 1 offsets)."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Words:
    """Word boundaries of a batch: ``start``/``end`` byte positions, ``doc`` row of each word,
    ``first`` index of each row's first word (n + 1 entries)."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, lower: bool = False):
        self.raw = _LOWER[raw] if lower else raw
        n = len(at) - 1
        solid = ~_IS_BLANK[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[at] = True  # rows never share a word
        begin = solid.copy()
        if len(raw):
            begin[1:] &= ~solid[:-1] | edge[1:-1]
        stop = solid.copy()
        if len(raw):
            stop[:-1] &= ~solid[1:] | edge[1:-1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, at).astype(np.int64)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; different words of up to 8 bytes never collide unless
        the mixing of their lengths does."""
        size = self.end - self.start
        h = mix(size.astype(np.uint64) * _GOLD)
        if not len(size):
            return h
        padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        eight = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        live, at = None, 0
        while True:
            rest = (size if live is None else size[live]) - at
            where = (self.start if live is None else self.start[live]) + at
            block = eight[where] & _KEEP[np.minimum(rest, 8)]
            if live is None:
                h = mix(h ^ mix(block + _GOLD))
                live = np.flatnonzero(size > 8)
            else:
                h[live] = mix(h[live] * _GOLD ^ mix(block + _GOLD))
                live = live[size[live] > at + 8]
            at += 8
            if not len(live):
                return h


def windows(h: np.ndarray, words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of one row, with the index of their first word."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = np.flatnonzero(words.doc[:n] == words.doc[width - 1 :])
    # A polynomial of word hashes, by doubling: run(a + b) = run(a) * base^b + run(b).
    base, run, size = int(_GOLD), h, 1
    for bit in bin(width)[3:]:
        m = len(run) - size
        run = run[:m] * np.uint64(pow(base, size, 1 << 64)) + run[size:]
        size *= 2
        if bit == "1":
            run = run[:-1] * _GOLD + h[size : size + len(run) - 1]
            size += 1
    return mix(mix(run[:n]) + np.uint64(width))[keep], keep


def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between successive offsets."""
    c = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=c[1:])
    return np.diff(c[at])
