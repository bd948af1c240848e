"""Word and shingle hashes of many texts at once, in numpy.

A word's hash is the sum of its bytes' random numbers, each times a power of an odd number that depends on the byte's
place, divided by that of the word's first place (all modulo 2^64), and then mixed. Running sums give it for all words
of a batch without a loop over words. Two different words of a corpus share one about once in 2^64 pairs.
"""

from __future__ import annotations

import numpy as np

ODD = 0xD6E8FEB86659FD93
_RANDOM = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(z: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", ODD), ("down", pow(ODD, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(text: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of a text, in order."""
    raw = np.frombuffer(text, np.uint8)
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = _BLANK[raw]
    change = np.flatnonzero(blank[1:] != blank[:-1])
    first, end = change[0::2], change[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), first, end
    up, down = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_RANDOM[_LOWER[raw] if lower else raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[first]) * down[first]), first, end


def runs(h: np.ndarray, size: int, odd: int = ODD) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words; empty if there are fewer words. Another ``odd``, another hash."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # by doubling: a run of 2m words is a run of m, times odd^m, plus the next run of m
    out, done, part, have = None, 0, h, 1
    while True:
        if size & have:
            first = part[: n + size - done - have]
            out = first if out is None else out[: len(first)] * np.uint64(pow(odd, have, 1 << 64)) + part[done : done + len(first)]
            done += have
        if 2 * have > size:
            return mix(out[:n])
        part = part[: len(part) - have] * np.uint64(pow(odd, have, 1 << 64)) + part[have:]
        have *= 2


def shingle_set(text: bytes, size: int, lower: bool = True) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; of the whole sequence if it is shorter; empty without words."""
    h, _, _ = word_hashes(text, lower)
    if not len(h):
        return h
    return np.unique(runs(h, size) if len(h) >= size else runs(h, len(h)) ^ np.uint64(len(h)))
