"""Fast similarity sketches of many sets at once.

Every coordinate of a sketch holds the smallest (round, value) placed in its
bin. In rounds 0 to t-1 a hash deals each element to one of t bins; in round
t + j every element goes to bin j. Later rounds run only for sets that still
have an empty bin, so a set of n elements costs about n + t log t placements,
all t coordinates are filled, and two sets agree in a coordinate with the
probability of their Jaccard similarity, concentrated as for t independent
hash functions."""

from __future__ import annotations

import math

import numpy as np

from treesnap.llm.arrays import mix

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of ``t`` coordinates for each set of uint64; rows of empty
    sets stay empty (all ones)."""
    out = np.full(len(sets) * t, _EMPTY, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return out.reshape(len(sets), t)
    items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * t):
        h = mix(items ^ np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        spot = (h % np.uint64(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + spot, np.uint64(i << 54) | h >> np.uint64(10))
        short = (out.reshape(len(sets), t) == _EMPTY).any(axis=1) & (sizes > 0)
        if not short.any():
            break
        on = short[owner]
        items, owner = items[on], owner[on]
    return out.reshape(len(sets), t)


def banding(similarity: float, miss: float = 1e-6) -> tuple[int, int]:
    """Bands and rows: two sets of this similarity share no band with
    probability ``miss`` at most."""
    rows = 6 if similarity >= 0.85 else 5
    return math.ceil(math.log(miss) / math.log(1 - similarity ** rows)), rows


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch; the band's number is part
    of the key."""
    out = np.empty((len(sketch), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sketch), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x2545F4914F6CDD1D) + sketch[:, b * rows + r])
        out[:, b] = h
    return out
