"""A store of the ids of short byte strings, asked for many strings at once.

Texts are cut into pieces that a tokenizer solves one by one; pieces repeat, so each is solved once and remembered. A
piece of up to WIDTH bytes is three words of eight bytes, the last with its size, so keys are exact. They are found by
open addressing, with arrays instead of a loop over pieces. Longer pieces are solved whenever they come. When over
entries pieces are held those that came but once are dropped, and pieces are taken SLICE at a time, so its bytes are
bounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

WIDTH = 23
#: Bytes that a buffer must have after its last piece, for reads of whole words.
PAD = 32
#: From the bytes and the starts and sizes of pieces: their ids in a row, and how many each has.
Solve = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start .. start + size - 1 of each run, in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class PieceStore:
    ENTRIES, SLICE = 600_000, 120_000

    def __init__(self, kind: np.dtype, entries: int | None = None) -> None:
        self.kind, self.entries = np.dtype(kind), entries or self.ENTRIES
        self.slots = 1 << (2 * (self.entries + self.SLICE) - 1).bit_length()
        self._empty()

    def _empty(self) -> None:
        self.table = np.full(self.slots, -1, np.int32)
        self.count, self.used = 0, 0
        self.keys = np.empty((3, 1 << 12), np.uint64)
        self.start = np.empty(1 << 12, np.int64)
        self.n = np.empty(1 << 12, np.uint8)
        self.ids = np.empty(1 << 14, self.kind)
        self.met = np.zeros(1 << 12, bool)

    def _thin(self) -> None:
        """Leaves what was asked for again since the store was last thinned, if that is half of what it holds or less."""
        keep = np.flatnonzero(self.met[: self.count])
        if len(keep) > self.entries // 2:
            return self._empty()
        keys, n, ids = self.keys[:, keep], self.n[keep], self.ids[spread(self.start[keep], self.n[keep].astype(np.int64))]
        self._empty()
        self._add(keys, self._hash(keys), ids, n.astype(np.int64))

    @staticmethod
    def _keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        words = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        out = np.empty((3, len(starts)), np.uint64)
        for k in range(3):
            left = np.clip(sizes - 8 * k, 0, 8).astype(np.uint64)
            # a shift by 64 is not defined, so none is left in two steps
            mask = (np.uint64(1) << np.uint64(4) * left << np.uint64(4) * left) - np.uint64(1)
            mask = np.where(left == 8, ~np.uint64(0), mask)
            out[k] = words[starts + 8 * k] & mask
        out[2] |= sizes.astype(np.uint64) << np.uint64(56)
        return out

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        h = keys[0] * np.uint64(0x9E3779B97F4A7C15)
        h = ((h ^ (h >> np.uint64(29))) + keys[1]) * np.uint64(0xBF58476D1CE4E5B9)
        h = ((h ^ (h >> np.uint64(32))) + keys[2]) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def _find(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1."""
        low = np.uint64(self.slots - 1)
        at = (h & low).astype(np.int64)
        out = self.table[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[:, out] != keys).any(axis=0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (self.slots - 1)
            e = out[open_] = self.table[at[open_]]
            open_ = open_[(e >= 0) & (self.keys[:, e] != keys[:, open_]).any(axis=0)]
        return out

    def _add(self, keys: np.ndarray, h: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Entries for keys that are not there, all different."""
        more = len(h)
        while self.count + more > len(self.start):
            self.keys = np.concatenate([self.keys, np.empty_like(self.keys)], axis=1)
            self.start = np.concatenate([self.start, np.empty_like(self.start)])
            self.n = np.concatenate([self.n, np.empty_like(self.n)])
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        new = np.arange(self.count, self.count + more, dtype=np.int32)
        self.keys[:, new], self.n[new] = keys, n
        self.start[new] = self.used + np.cumsum(n) - n
        self.ids[self.used : self.used + len(ids)] = ids
        self.count += more
        self.used += len(ids)
        at = (h & np.uint64(self.slots - 1)).astype(np.int64)
        left = np.arange(more)
        while len(left):
            free = left[self.table[at[left]] < 0]
            self.table[at[free]] = new[free]  # of several for a slot, one stays
            left = left[self.table[at[left]] != new[left]]
            at[left] = (at[left] + 1) & (self.slots - 1)

    def ids_of(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, solve: Solve, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has. alone: pieces that are not remembered."""
        if len(starts) > self.SLICE:
            cuts = range(0, len(starts), self.SLICE)
            parts = [self.ids_of(data, starts[i : i + self.SLICE], sizes[i : i + self.SLICE], solve, None if alone is None else alone[i : i + self.SLICE]) for i in cuts]
            return np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])
        if self.count > self.entries:
            self._thin()
        held = sizes <= WIDTH if alone is None else (sizes <= WIDTH) & ~alone
        short, long = np.flatnonzero(held), np.flatnonzero(~held)
        keys = self._keys(data, starts[short], sizes[short])
        h = self._hash(keys)
        at = self._find(keys, h)
        self.met[at[at >= 0]] = True
        miss = np.flatnonzero(at < 0)
        while len(miss):
            _, first = np.unique(h[miss], return_index=True)
            own = miss[first]
            self._add(keys[:, own], h[own], *solve(data, starts[short[own]], sizes[short[own]]))
            at[miss] = self._find(keys[:, miss], h[miss])
            miss = miss[at[miss] < 0]  # others of the same hash
        n, source = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        n[short], source[short] = self.n[at], self.start[at]
        if len(long):
            ids, counts = solve(data, starts[long], sizes[long])
            n[long] = counts
        out = self.ids[spread(source, n) if not len(long) else np.minimum(spread(source, n), len(self.ids) - 1)]
        if len(long):
            ends = np.cumsum(n)
            out[spread((ends - n)[long], n[long])] = ids
        return out, n


def text_bytes(column, add: str = "") -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """The UTF-8 bytes of an Arrow column of strings in a row, padded, and the offsets of its rows; null is empty. add
    goes before each text that is not empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(column.cast(pa.large_string()), "")
    if add:
        empty = pa.scalar("", pa.large_string())
        texts = pc.if_else(pc.equal(texts, empty), empty, pc.binary_join_element_wise(pa.scalar(add, pa.large_string()), texts, empty))
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.zeros(int(offsets[-1] - offsets[0]) + PAD, np.uint8)
    if raw is not None and len(data) > PAD:
        data[: len(data) - PAD] = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]
