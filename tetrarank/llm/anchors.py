"""Content-defined anchors: the suffixes of a sparse suffix array, and which windows of a text each of them stands for.

Every window of `length` bytes has one anchor: of the GRAM-byte strings that lie inside it the one with the smallest hash, the
first of equals. The choice depends on the window's bytes only, so equal windows have equal strings at their anchors, at
the same distance from their start. It is therefore enough to sort and compare the suffixes at anchors, some one in
(length - GRAM) / 2 of all suffixes, to find every pair of equal windows.
"""

from __future__ import annotations

import hashlib

import numpy as np

GRAM = 250
_rng = np.random.default_rng(77)
BASE = (int(_rng.integers(1 << 62)) << 1) | 1
INVERSE = pow(BASE, -1, 1 << 64)
VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = VALUES.copy()  # A-Z as a-z
FOLDED[65:91] = VALUES[97:123]
FILLED = ~np.isin(np.arange(256), [32, *range(9, 14)])
NONE = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as longer texts come."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> Powers:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            for name, base in (("up", BASE), ("down", INVERSE)):
                out = np.full(size, base, np.uint64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))
        return self


POWERS = Powers()


class Hashes:
    """Polynomial hashes of all substrings of a text from one pass over it."""

    def __init__(self, data: bytes):
        self.n = len(data)
        p = POWERS.upto(self.n)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(VALUES[np.frombuffer(data, np.uint8)] * p.up[:self.n], out=self.sums[1:])

    def fixed(self, size: int) -> np.ndarray:
        """Of every substring of `size` bytes, by its start."""
        m = self.n - size + 1
        return mix((self.sums[size:size + m] - self.sums[:m]) * POWERS.down[:m])

    def windows(self, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return mix((self.sums[starts + size] - self.sums[starts]) * POWERS.down[starts])


class WordHashes(Hashes):
    """The same for the words of a text: A-Z lower-cased, parted by blanks, so that runs of equal words are equal strings."""

    def __init__(self, data: bytes):
        letters = np.frombuffer(data, np.uint8)
        filled = np.zeros(len(data) + 2, bool)
        filled[1:-1] = FILLED[letters]
        edges = np.flatnonzero(filled[1:] != filled[:-1])
        starts, ends = edges[::2], edges[1::2]
        p = POWERS.upto(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(FOLDED[letters] * p.up[:len(data)], out=sums[1:])
        own = mix((sums[ends] - sums[starts]) * p.down[starts])
        self.n = len(own)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(own * p.up[:self.n], out=self.sums[1:])


def _sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = np.minimum(x[:len(x) - step], x[step:])
        done += step
    return x


def anchors(data: bytes, length: int, hashes: Hashes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: position, hash of the string there, first and last window start that it stands for."""
    return anchors_of(hashes, length, GRAM) if len(data) >= length else NONE


def anchors_of(hashes: Hashes, length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same over any sequence, windows of `length` members and strings of `size`."""
    if hashes.n < length:
        return NONE
    gram = hashes.fixed(size)
    w = length - size + 1
    low = _sliding_minimum(gram, w)  # by window start
    at = np.flatnonzero(gram == _spread(low, w))
    first, last = _ranges(at, gram[at], len(low), w)
    keep = last >= first
    return at[keep], gram[at[keep]], first[keep], last[keep]


def _spread(low: np.ndarray, w: int) -> np.ndarray:
    """For each position the largest of the minima of the windows that hold it: only where that is its own hash can an anchor be."""
    pad = np.zeros(w - 1, np.uint64)
    x = np.concatenate([pad, low, pad])
    done = 1
    while done < w:
        step = min(done, w - done)
        x = np.maximum(x[:len(x) - step], x[step:])
        done += step
    return x


def _ranges(at: np.ndarray, value: np.ndarray, starts: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start (of `starts`) whose first smallest hash is at each candidate.

    It reaches back to the last candidate that is not larger, and on to the next one that is smaller.
    """
    before, after = np.full(len(at), -1, np.int64), np.full(len(at), starts + w, np.int64)
    stack: list[int] = []
    places, v = at.tolist(), value.tolist()
    for i, place in enumerate(places):
        while stack and v[stack[-1]] > v[i]:
            after[stack.pop()] = place
        if stack:
            before[i] = places[stack[-1]]
        stack.append(i)
    return np.maximum(np.maximum(at - w + 1, before + 1), 0), np.minimum(np.minimum(at, after - w), starts - 1)


def digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
