"""NumPy helpers that run inside tasks: hashing of words and features of the
bytes of one text."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a fresh uint64 array."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


# one random-looking odd number for each byte value
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE) | np.uint64(1)
_POWERS = np.cumprod(np.full(256, _BASE | np.uint64(1), dtype=np.uint64))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(n, _BASE | np.uint64(1), dtype=np.uint64))
    return _POWERS


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def run_hashes(buf: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the maximal runs of bytes that are
    not ``outside`` (a mask), in order."""
    inside = ~outside
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    length = ends - starts
    kept = np.flatnonzero(inside)
    offsets = np.concatenate(([0], np.cumsum(length)[:-1]))
    within = np.arange(len(kept)) - np.repeat(offsets, length)
    terms = _BYTE[buf[kept]] * _powers(int(length.max()))[within]
    sums = np.add.reduceat(terms, offsets) + length.astype(np.uint64)
    return mix(sums), starts, ends


def word_hashes(buf: np.ndarray) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``, in order."""
    return run_hashes(buf, _SPACE[buf])[0]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` word hashes; empty for fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + words[j:j + n] + np.uint64(j + 1))
    return h
