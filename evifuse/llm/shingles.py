"""Words and shingles of whole Arrow batches as 64-bit hashes, in numpy."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

SHINGLE = 5
_rng = np.random.Generator(np.random.PCG64(20240711))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
# Bytes that are hashed at a time, so that the working arrays stay small beside any text.
BLOCK_BYTES = 4 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _P, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def utf8_buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    text = text.cast(pa.large_string()).fill_null("")
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset:text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def _hash_block(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of ``raw``; a word also ends at each of ``breaks``."""
    inside = np.flatnonzero(~_SPACE[raw])
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.empty(len(inside), bool)
    first[0] = True
    np.not_equal(np.diff(inside), 1, out=first[1:])
    cuts = np.searchsorted(inside, breaks)
    first[cuts[cuts < len(inside)]] = True
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(inside)))
    place = np.arange(len(inside)) - np.repeat(starts, lengths)
    h = np.add.reduceat(_BYTE[raw[inside]] * _powers(int(lengths.max()))[place], starts)
    return mix(h + lengths.astype(np.uint64)), inside[starts]


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows in order, and the offsets of the rows among them.

    Words are runs of anything but ASCII white space, compared as they are written.
    """
    raw, at = utf8_buffers(text)
    hashes, begins = [], []
    lo, end = int(at[0]), int(at[-1])
    while lo < end:
        hi = min(lo + BLOCK_BYTES, end)
        if hi < end:  # go on to the end of the word
            while hi < end and not _SPACE[raw[hi]]:
                hi += 1
        breaks = at[np.searchsorted(at, lo):np.searchsorted(at, hi)] - lo
        h, s = _hash_block(raw[lo:hi], breaks)
        hashes.append(h)
        begins.append(s + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), at)


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of one text's words; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(size, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = h * _Q + words[j:n - k + 1 + j]
    return mix(h)


def shingle_sets(text: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    words, at = word_hashes(text)
    return [np.unique(shingle_hashes(words[a:b], size)) for a, b in zip(at[:-1], at[1:], strict=True)]
