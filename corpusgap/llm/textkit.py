"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on Arrow string columns inside ``mapInArrow`` tasks: the UTF-8
bytes of many documents are looked at as one numpy array, so that words, hashes
and shingles of a few megabytes of text are found by a handful of array passes.
Null texts count as empty.  Memory is bounded by ``CHUNK_BYTES`` (or one
document, if that is longer), not by the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: Word separators: space and the control characters 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers = np.ones(1, dtype=U64)
_inverse = np.ones(1, dtype=U64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if n > len(_powers):
        size = max(n, CHUNK_BYTES + (1 << 16))
        steps = np.full(size, _BASE, dtype=U64)
        steps[0] = 1
        back = np.full(size, _BASE_INV, dtype=U64)
        back[0] = 1
        powers, inverse = np.cumprod(steps, dtype=U64), np.cumprod(back, dtype=U64)
        if size > 4 * CHUNK_BYTES:
            return powers, inverse
        _powers, _inverse = powers, inverse
    return _powers, _inverse


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string column; a null is an empty range."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, ends = off[:-1].copy(), off[1:].copy()
    if column.null_count:
        gone = column.is_null().to_numpy(zero_copy_only=False)
        ends[gone] = starts[gone]
    return raw, starts, ends


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer document stands alone."""
    _, starts, ends = text_buffer(column)
    size = np.cumsum(ends - starts)
    at, n = 0, len(starts)
    while at < n:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
        yield at, min(to, n)
        at = min(to, n)


class Texts:
    """Some documents as one byte array (ASCII letters lowered unless told otherwise)."""

    def __init__(self, column: pa.Array, lower: bool = True):
        raw, starts, ends = text_buffer(column)
        lo = int(starts.min()) if len(starts) else 0
        hi = int(ends.max()) if len(ends) else 0
        self.n = len(starts)
        self.bytes = LOWER[raw[lo:hi]] if lower else raw[lo:hi]
        self.starts, self.ends = starts - lo, ends - lo
        full = self.ends > self.starts
        solid = ~IS_SPACE[self.bytes]
        before = np.empty_like(solid)
        after = np.empty_like(solid)
        if len(solid):
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
            before[self.starts[full]] = False
            after[self.ends[full] - 1] = False
        self.word_start = np.flatnonzero(solid & ~before)
        self.word_end = np.flatnonzero(solid & ~after) + 1
        self.first_word = np.searchsorted(self.word_start, self.starts)
        self.n_words = np.searchsorted(self.word_start, self.ends) - self.first_word
        self.n_words[~full] = 0
        self.word_doc = np.repeat(np.arange(self.n), self.n_words)
        self._prefix: np.ndarray | None = None

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes have equal hashes wherever they stand."""
        n = len(self.bytes)
        powers, inverse = _power_tables(n + 1)
        if self._prefix is None:
            self._prefix = np.zeros(n + 1, dtype=U64)
            np.cumsum((self.bytes.astype(U64) + U64(1)) * powers[:n], out=self._prefix[1:])
        return mix64((self._prefix[end] - self._prefix[start]) * inverse[start])

    def word_hashes(self) -> np.ndarray:
        return self.range_hash(self.word_start, self.word_end)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash) of every run of ``width`` words, in text order.

        A document with some but fewer words has its whole sequence as its one shingle.
        """
        words, doc = self.word_hashes(), self.word_doc
        keys = mix64(np.arange(1, width + 1, dtype=U64) * U64(_BASE)) | U64(1)
        n = max(0, len(words) - width + 1)
        own = doc[:n] == doc[width - 1 : width - 1 + n] if n else np.zeros(0, bool)
        total = np.zeros(n, dtype=U64)
        for j in range(width):
            total += words[j : j + n] * keys[j]
        out_doc, out_hash = doc[:n][own], mix64(total[own])
        short = np.flatnonzero((self.n_words > 0) & (self.n_words < width))
        if len(short):
            total = self.n_words[short].astype(U64) * U64(0xD6E8FEB86659FD93)
            for j in range(width - 1):
                has = self.n_words[short] > j
                at = self.first_word[short][has] + j
                total[has] += words[at] * keys[j]
            out_doc = np.concatenate([out_doc, short])
            out_hash = np.concatenate([out_hash, mix64(total)])
            order = np.argsort(out_doc, kind="stable")
            out_doc, out_hash = out_doc[order], out_hash[order]
        return out_doc, out_hash
