"""Ids of whole Arrow batches of texts, from spans that a tokenizer never merges across.

A tokenizer says where its texts may be cut.  Each distinct span of fewer than
WIDTH bytes is encoded once and kept, as packed arrays of a bounded size; the
ids of a text are those of its spans, put together for a whole slice of texts at
once.  Spans are compared by all their bytes, never by a hash alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from noticeflow.llm.text_arrays import buffers, mix, slices

#: Bytes by which spans are compared: the last one holds the length.
WIDTH = 24
#: Spans that a worker keeps (about 60 bytes each); beyond that the half used last stays.
ENTRIES = 500_000
#: For 0..8 bytes, the bits of the first so many of a little-endian 64-bit word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def keys_of(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Three 64-bit words a span that hold its bytes and length; spans are shorter than WIDTH."""
    padded = np.concatenate([raw, np.zeros(WIDTH, np.uint8)])
    words = np.ndarray((len(raw) + WIDTH - 7,), "<u8", padded, strides=(1,))  # eight bytes from every place
    found = [words[starts + 8 * k] & _FIRST[np.clip(sizes - 8 * k, 0, 8)] for k in range(WIDTH // 8)]
    found[-1] |= sizes.astype(np.uint64) << np.uint64(56)
    return found


class SpanIds:
    """`encode` gives the ids of a list of spans, one after the other, and the number of ids of each."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = ENTRIES):
        self.encode, self.most, self.turn = encode, most, 0
        self.keys = [np.zeros(0, np.uint64) for _ in range(WIDTH // 8)]
        self.start, self.count, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # in order of the hash
        self.pool = np.zeros(0, np.uint32)

    def _shrink(self) -> None:
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2])
        new = np.full(len(self.used), -1, np.int32)
        new[keep] = np.arange(len(keep), dtype=np.int32)
        stay = new[self.entry] >= 0
        self.hashes, self.entry = self.hashes[stay], new[self.entry[stay]]
        self.pool = gather(self.pool, self.start[keep], self.count[keep])
        self.keys, self.count, self.used = [k[keep] for k in self.keys], self.count[keep], self.used[keep]
        self.start = np.cumsum(self.count, dtype=np.int64) - self.count

    def _add(self, hashes: np.ndarray, place: np.ndarray, keys: list[np.ndarray], ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        n, more = len(self.count), len(count)
        count, numbers = count.astype(np.int32), np.arange(n, n + more, dtype=np.int32)
        self.keys = [np.concatenate([a, b]) for a, b in zip(self.keys, keys)]
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(count, dtype=np.int64) - count])
        self.count, self.used = np.concatenate([self.count, count]), np.concatenate([self.used, np.zeros(more, np.int32)])
        self.pool = np.concatenate([self.pool, ids])
        self.hashes, self.entry = np.insert(self.hashes, place, hashes), np.insert(self.entry, place, numbers)
        return numbers

    def _entries(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The kept entry of each short span, -1 where its hash is another span's."""
        self.turn += 1
        if len(self.count) > self.most:
            self._shrink()
        keys = keys_of(raw, starts, sizes)
        hashes = mix(keys[0] ^ mix(keys[1] ^ mix(keys[2])))
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == distinct[inside]
        entry = np.empty(len(distinct), np.int32)
        entry[known] = self.entry[place[known]]
        new = first[~known]
        if len(new):
            body = raw.tobytes()
            found = self.encode([body[s : s + n] for s, n in zip(starts[new].tolist(), sizes[new].tolist())])
            entry[~known] = self._add(distinct[~known], place[~known], [k[new] for k in keys], *found)
        self.used[entry] = self.turn
        entry = entry[back]
        same = np.ones(len(entry), bool)
        for mine, kept in zip(keys, self.keys):
            same &= kept[entry] == mine
        entry[~same] = -1
        return entry

    def ids(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans one after the other, number of ids of each)."""
        sizes = ends - starts
        entry = np.full(len(starts), -1, np.int32)
        short = np.flatnonzero(sizes < WIDTH)
        if len(short):
            entry[short] = self._entries(raw, starts[short], sizes[short])
        apart = np.flatnonzero(entry < 0)
        count, start = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        kept = entry >= 0
        count[kept], start[kept] = self.count[entry[kept]], self.start[entry[kept]]
        if not len(apart):
            return gather(self.pool, start, count), count
        spans = [raw[a:b].tobytes() for a, b in zip(starts[apart].tolist(), ends[apart].tolist())]
        number = {s: k for k, s in enumerate(dict.fromkeys(spans))}
        own, n = self.encode(list(number))
        which = np.array([number[s] for s in spans])
        count[apart], start[apart] = n[which], len(self.pool) + (np.cumsum(n) - n)[which]
        return gather(np.concatenate([self.pool, own]), start, count), count


def gather(pool: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """pool[s : s + n] of all spans, one after the other."""
    count = count.astype(np.int64)
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    if not len(pool):
        return np.zeros(total, np.uint32)
    at = np.repeat(start - (ends - count), count)
    at += np.arange(total)
    return pool.take(at, mode="clip")


def encoded(texts, tokenizer, head: tuple[int, ...] = (), tail: tuple[int, ...] = ()):
    """(first, last, ids, offsets) of consecutive slices of an Arrow array of texts.

    The tokenizer has `spans(raw, texts' offsets)`, which gives where spans
    start and end, and `kept`, a SpanIds.  ids[offsets[i] : offsets[i + 1]] are
    those of text first + i, with head and tail around them.
    """
    data, offsets = buffers(texts)
    for first, last in slices(offsets):
        raw, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        raw, at = tokenizer.prepared(raw, at)
        starts, ends = tokenizer.spans(raw, at)
        ids, count = tokenizer.kept.ids(raw, starts, ends)
        upto = np.concatenate([[0], np.cumsum(count)])
        bounds = upto[np.searchsorted(starts, at)]  # where each text's ids start
        if head or tail:
            h, t, n = len(head), len(tail), last - first
            out = np.empty(len(ids) + n * (h + t), np.uint32)
            shift = np.arange(n) * (h + t) + h
            out[np.arange(len(ids)) + np.repeat(shift, np.diff(bounds))] = ids
            bounds = bounds + np.arange(n + 1) * (h + t)
            for k, value in enumerate(head):
                out[bounds[:-1] + k] = value
            for k, value in enumerate(tail):
                out[bounds[1:] - t + k] = value
            ids = out
        yield first, last, ids, bounds
