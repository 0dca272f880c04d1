"""Hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], seed: int = 0x9E3779B97F4A7C15) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without ASCII white space) of all texts, and the number of words of each.

    Words are read eight bytes at a time, all words in step. Hashes of different seeds are independent of each other.
    """
    blob = b" ".join([*texts, bytes(8)])
    x = np.frombuffer(blob, np.uint8)[:-8]
    inside = np.concatenate(([False], ~_SPACE[x], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(blob) - 7,), "<u8", blob, 0, (1,))
    h = mix(size.astype(np.uint64) + np.uint64(seed))
    left, at, who = size, start, None
    while len(at):
        value = eight[at] & _KEEP[np.minimum(left, 8)]
        if who is None:
            h = mix(h ^ value)
        else:
            h[who] = mix(h[who] ^ value)
        more = np.flatnonzero(left > 8)
        who = more if who is None else who[more]
        at, left = at[more] + 8, left[more] - 8
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    return h, np.diff(np.searchsorted(start, ends), prepend=0)


def window_hashes(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash for each window of width consecutive hashes; one fewer than width for each window less."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    for j in range(width):
        out ^= h[j : j + n]
        out *= np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(32)
    return mix(out)
