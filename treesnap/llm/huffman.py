"""Canonical length-limited Huffman code over ids, with NumPy coders.

Bits fill 32-bit big-endian words from the top. A block carries the bit
offset of every ``STRIDE``-th id, so its lanes decode side by side: one table
look-up gives each lane its next id and the bits to skip."""

from __future__ import annotations

import numpy as np

STRIDE = 128   # ids between bit-offset checkpoints
LIMIT = 16     # bits in a code at most, more only where the ids need more


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths up to ``limit`` for positive counts, by
    package-merge; ties go to the earlier id. One id gets one bit."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes longer than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.float64)[order]
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        items = np.concatenate((leaves, packages))
        by = np.argsort(items, kind="stable")
        levels.append(by < n)
        items = items[by]
        even = len(items) // 2 * 2
        packages = items[0:even:2] + items[1:even:2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code: ids sorted by (length, id) get successive codes."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = np.asarray(ids, np.int64)[order], np.asarray(lengths, np.int64)[order]
        self.width = int(self.lengths.max()) if len(ids) else 1
        # codes left-aligned to `width` bits are the running sums of their spans
        spans = np.int64(1) << (self.width - self.lengths)
        first = np.concatenate(([0], np.cumsum(spans)))[:-1]
        size = int(self.ids.max()) + 1 if len(ids) else 1
        self.length_of, self.code_of = np.zeros(size, np.uint8), np.zeros(size, np.uint64)
        self.length_of[self.ids] = self.lengths
        self.code_of[self.ids] = first.astype(np.uint64) << np.uint64(64 - self.width)   # from the top bit on
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.skip = np.ones(1 << self.width, np.int64)
        self.symbol[:int(spans.sum())] = np.repeat(self.ids, spans)
        self.skip[:int(spans.sum())] = np.repeat(self.lengths, spans)

    @classmethod
    def fit(cls, ids: np.ndarray, counts: np.ndarray, limit: int = LIMIT) -> Code:
        need = max(1, int(np.ceil(np.log2(max(2, len(ids))))))
        order = np.argsort(ids)
        ids, counts = np.asarray(ids)[order], np.asarray(counts)[order]
        return cls(ids, code_lengths(counts, max(limit, need)) if len(ids) else np.zeros(0, np.int64))

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits as bytes (whole words) and the checkpoints."""
        if not len(ids):
            return np.zeros(1, ">u4").tobytes(), np.zeros(0, np.int64)
        ids = np.asarray(ids, np.intp)
        n = self.length_of.take(ids)
        ends = np.cumsum(n, dtype=np.int64)
        at = ends - n
        word = at >> 5
        bits = self.code_of.take(ids) >> (at & 31).view(np.uint64)
        out = np.zeros(int(ends[-1] >> 5) + 2, np.uint32)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        both = np.add.reduceat(bits, first)  # no two codes share a bit
        word = word[first]
        out[word] |= (both >> np.uint64(32)).astype(np.uint32)
        out[word + 1] |= (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return out.astype(">u4").tobytes(), at[::STRIDE].copy()

    def decode(self, payloads: list[bytes], marks: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
        """Ids of each block; all lanes of all blocks run together."""
        raw = b"".join([*payloads, bytes(8)])
        ahead = np.ndarray(len(raw) - 3, ">u4", raw, strides=(1,))   # the 32 bits from every byte on
        base = np.cumsum([0] + [8 * len(p) for p in payloads])[:-1]
        at = np.concatenate([m + b for m, b in zip(marks, base, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
        left = np.concatenate([np.minimum(STRIDE, s - np.arange(0, s, STRIDE)) for s in sizes] or [np.zeros(0, np.int64)])
        out = np.zeros((STRIDE, len(at)), np.uint32)
        mask, room = np.uint32((1 << self.width) - 1), 32 - self.width
        full, at_full, shortest = None, at, left.min(initial=STRIDE)   # None: all lanes
        for step in range(STRIDE):
            if step >= shortest:
                on = left > step if full is None else left[full] > step
                full, at_full = np.flatnonzero(on) if full is None else full[on], at_full[on]
                if not len(full):
                    break
            peek = (ahead[at_full >> 3].astype(np.uint32) >> (room - (at_full & 7)).astype(np.uint32)) & mask
            if full is None:
                out[step] = self.symbol.take(peek)
            else:
                out[step, full] = self.symbol.take(peek)
            at_full = at_full + self.skip.take(peek)
        flat = np.ascontiguousarray(out.T).reshape(-1)
        found, lane = [], 0
        for s in sizes:
            lanes = -(-s // STRIDE)
            found.append(flat[lane * STRIDE:lane * STRIDE + s])
            lane += lanes
        return found
