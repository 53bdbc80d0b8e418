"""Sets of hashed 5-word shingles and their one-permutation MinHash, per document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessera.llm.bytescan import U64, Block, blocks, mix, powers

WIDTH = 5
#: Minima kept of each set; bin = top 8 bits of a shingle's hash.
BINS = 256
BIN_SHIFT = U64(56)
LOW_BITS = 2
#: Minima in a band: 256 // 5 = 51 bands.
BAND_ROWS = 5
BANDS = BINS // BAND_ROWS

_rng = np.random.Generator(np.random.PCG64(977))
_BORROW = np.stack([_rng.permutation(BINS) for _ in range(64)])
_BAND_SALT = _rng.integers(1, 1 << 63, BANDS, dtype=U64) | U64(1)


def block_sets(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): the distinct shingles of document d, ascending, are hashes[bounds[d]:bounds[d + 1]].

    Words are lower-cased in A-Z only. A document with fewer than five words
    has its whole word sequence as one shingle, one without words has none.
    """
    words = b.word_hashes(folded=True)
    at, hashes = b.windows(words, WIDTH)
    doc = b.doc_of_words()[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((b.n_words > 0) & (b.n_words < WIDTH))
    if len(short):
        own = np.array([_short(words[b.word_bounds[d] : b.word_bounds[d + 1]]) for d in short], U64)
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, own])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[new], hashes[new]
    return np.searchsorted(doc, np.arange(b.docs + 1)), hashes


def _short(words: np.ndarray) -> int:
    value = np.zeros(1, U64)
    for k, c in enumerate(powers(0xD6E8FEB86659FD93, WIDTH)[: len(words)]):
        value += words[k : k + 1] * c
    return int(mix(value + U64(len(words)))[0])


def set_hashes(bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One 64-bit hash per set (order-free: sums of remixed members), 0 for an empty one."""
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(mix(hashes ^ U64(0xA0761D6478BD642F)), out=total[1:])
    sizes = np.diff(bounds).astype(U64)
    return np.where(sizes > 0, mix(total[bounds[1:]] - total[bounds[:-1]] + sizes), U64(0))


def minima(bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """BINS minima per non-empty set: the least hash of each bin; an empty bin borrows from bins in a fixed random order of its own."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    bins = (hashes >> BIN_SHIFT).astype(np.int64)
    first = np.ones(len(hashes), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (bins[1:] != bins[:-1])
    least = np.zeros((n, BINS), U64)
    filled = np.zeros((n, BINS), bool)
    least[doc[first], bins[first]] = hashes[first]
    filled[doc[first], bins[first]] = True
    todo = np.flatnonzero(np.diff(bounds) > 0)
    todo = todo[~filled[todo].all(axis=1)]
    value, have = least[todo], filled[todo]
    done = have.copy()
    # try t of bin i looks at bin _BORROW[t][i]: the same for all sets, different for each bin
    for t, order in enumerate(_BORROW):
        take = ~done & have[:, order]
        value[take] = mix(value[:, order][take] + U64(t + 1))
        done |= take
        if done.all():
            break
    for row, column in zip(*np.nonzero(~done), strict=True):  # sets of a few shingles
        own = np.flatnonzero(have[row])
        pick = own[np.argmin(mix(own.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(column)))]
        value[row, column] = mix(value[row, pick : pick + 1] + U64(len(_BORROW) + 1))[0]
    least[todo] = value
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[:, : BANDS * BAND_ROWS].reshape(len(least), BANDS, BAND_ROWS)
    key = np.broadcast_to(_BAND_SALT, rows.shape[:2]).copy()
    for k in range(BAND_ROWS):
        key = mix(key + rows[:, :, k])
    return key


def pack(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 32 of them in each 64-bit word."""
    low = (least & U64(3)).reshape(len(least), BINS // 32, 32)
    return (low << (U64(2) * np.arange(32, dtype=U64))).sum(axis=2, dtype=U64)


def signatures(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: set sizes, set hashes, packed signatures, band keys."""
    for b in blocks(texts):
        bounds, hashes = block_sets(b)
        least = minima(bounds, hashes)
        yield np.diff(bounds), set_hashes(bounds, hashes), pack(least), band_keys(least)
