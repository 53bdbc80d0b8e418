"""Vectorised scans of UTF-8 text columns.

Everything works on the raw Arrow buffers: a block of documents is one byte
array, and words, lines and 5-word windows are found and hashed by NumPy for
the whole block at once, so that no Python object is made per word.

Hashes are 64-bit polynomials over bytes (each byte stands for a fixed random
number), finished by a bijective mix. They depend on nothing but the bytes:
every executor and every rerun gets the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, _MASK, 256, dtype=U64)


_EXACT = _table(20240229)
_FOLDED = _EXACT.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _EXACT[ord("a") : ord("z") + 1]
_LINE = _EXACT.copy()
_EXACT = np.where(SPACE, U64(0), _EXACT)
_FOLDED = np.where(SPACE, U64(0), _FOLDED)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        grown = np.ones(size, U64)
        if size > 1:
            grown[1:] = U64(base)
            np.multiply.accumulate(grown, out=grown)
        _powers[base] = have = grown
        if size > 4 * BLOCK_BYTES:  # a very long text: used once, not kept
            del _powers[base]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over all output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def poly(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each slice [start, end) of values, independent of where the slice lies."""
    n = len(values)
    total = np.zeros(n + 1, U64)
    np.cumsum(values * powers(_BASE, n), out=total[1:])
    return (total[ends] - total[starts]) * powers(_BASE_INV, n + 1)[starts]


class Block:
    """Some documents of a batch: bytes, the documents' bounds in them, and the words."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds
        self.docs = len(bounds) - 1
        n = len(data)
        space = SPACE[data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        if n:
            before[1:], after[:-1] = space[:-1], space[1:]
            inner = bounds[:-1][bounds[:-1] < n]
            before[inner] = True
            after[inner[inner > 0] - 1] = True
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        # words of document d: word_bounds[d] .. word_bounds[d + 1]
        self.word_bounds = np.searchsorted(self.starts, bounds)
        self.n_words = np.diff(self.word_bounds)

    def word_hashes(self, folded: bool) -> np.ndarray:
        table = _FOLDED if folded else _EXACT
        raw = poly(table[self.data], self.starts, self.ends)
        return mix(raw + (self.ends - self.starts).astype(U64))

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums over each document's bytes."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.n_words)

    def windows(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, hash) of every window of width words inside one document."""
        n = len(words) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        doc = self.doc_of_words()
        at = np.flatnonzero(doc[:n] == doc[width - 1 :])
        coefficients = powers(0xD6E8FEB86659FD93, width + 1)[1:]
        value = np.zeros(len(at), U64)
        for k in range(width):
            value += words[at + k] * coefficients[k]
        return at, mix(value)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, end) of every line; every document has at least one."""
        cuts = np.flatnonzero(self.data == 10)
        n_cuts = self.per_doc(self.data == 10)
        doc = np.repeat(np.arange(self.docs), n_cuts + 1)
        first = np.zeros(self.docs, np.int64)
        first[1:] = np.cumsum(n_cuts + 1)[:-1]
        starts, ends = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
        is_first = np.zeros(len(doc), bool)
        is_first[first] = True
        is_last = np.zeros(len(doc), bool)
        is_last[first + n_cuts] = True
        starts[is_first], starts[~is_first] = self.bounds[:-1], cuts + 1
        ends[is_last], ends[~is_last] = self.bounds[1:], cuts
        return doc, starts, ends

    def line_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(poly(_LINE[self.data], starts, ends) + (ends - starts).astype(U64))


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """A text column (nulls count as empty) in blocks of about block_bytes; a document is never divided."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + block_bytes, "right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def sum_by(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, n).astype(np.int64)
