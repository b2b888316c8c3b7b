"""Whole Arrow batches of texts as numpy arrays: word hashes, shingle sets, rolling hashes."""

from __future__ import annotations

import numpy as np

_SEED = np.random.default_rng(20240611)
#: A random value per byte and an odd base make a polynomial hash modulo 2**64.
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)
#: Bytes of text that are worked on at once, and where eight-byte values are made of each byte.
SLICE, SHINGLE_SLICE = 1 << 20, 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Powers:
    def __init__(self):
        self.n, self.up, self.down = 0, None, None

    def get(self, n: int):
        if n > self.n:
            size = max(n, 1 << 16)
            up, down = np.full(size, _BASE, np.uint64), np.full(size, _BACK, np.uint64)
            up[0] = down[0] = 1
            up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
            if n > 4 * SLICE:
                return up, down  # not kept: one very long text
            self.n, self.up, self.down = size, up, down
        return self.up, self.down


_powers = _Powers()


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[s:e], equal for equal content wherever it stands; values are uint64."""
    up, down = _powers.get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:], dtype=np.uint64)
    return mix((total[ends] - total[starts]) * down[starts])


def slices(offsets: np.ndarray, size: int = SLICE):
    """(first, last) text numbers of consecutive slices of about `size` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def buffers(texts):
    """Bytes and offsets of an Arrow string array without nulls (chunks are combined)."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets


def shingle_sets(texts, size: int):
    """For each text of an Arrow array the sorted distinct 64-bit hashes of its word shingles.

    Words are runs of bytes outside [\\x20\\x09-\\x0D] after A-Z is lower-cased.
    A text of fewer than `size` words has its whole sequence as one shingle; one
    without words has none.
    """
    data, offsets = buffers(texts)
    factors = _SEED_FACTORS[: size + 1]
    for first, last in slices(offsets, SHINGLE_SLICE):
        at = offsets[first : last + 1] - offsets[first]
        raw = data[offsets[first] : offsets[last]]
        n = len(raw)
        if not n:
            for _ in range(first, last):
                yield np.zeros(0, np.uint64)
            continue
        low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
        opens[edges] = word[edges]
        closes[edges - 1] = word[edges - 1]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        words = span_hashes(_BYTE[low], s, e)
        owner = np.searchsorted(s, at, side="left")
        if len(words) >= size:
            shingles = np.zeros(len(words) - size + 1, np.uint64)
            for j in range(size):
                shingles += words[j : len(words) - size + 1 + j] * factors[j]
            shingles = mix(shingles)
        for i in range(last - first):
            a, b = owner[i], owner[i + 1]
            if b - a >= size:
                yield np.unique(shingles[a : b - size + 1])
            elif b > a:
                yield mix((words[a:b] * factors[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


_SEED_FACTORS = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
