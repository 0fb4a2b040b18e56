"""BagMinHash signatures of shingle multisets.

A shingle that occurs w times owns the weight interval (0, w]. On every unit of weight runs a
Poisson process of points, each with a signature component; the earliest point of a component over
all the units a text owns is its entry, so two texts agree in a component with the probability of
their weighted Jaccard similarity, the sum of minima over the sum of maxima.

The processes are hierarchical: the weights are cut into (0, 1], (1, 2], (2, 4], (4, 8] ..., and
the process of a long interval is known only by its next point until that point comes before the
latest entry of the signature; then it is split in halves, one of which inherits the point. All
draws depend on the shingle, the interval and a counter alone, so equal units have equal points in
every text. Whatever comes later than the latest entry is never drawn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S11 = (np.uint64(x) for x in (30, 27, 31, 11))
_CHILD = np.array([0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7], np.uint64)
_SIDE, _PLACE = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xA0761D6478BD642F)
_POWERS = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA5CB9243F3B2C0A1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def _draw(key: np.ndarray, counter: np.ndarray | int) -> np.ndarray:
    """Exponential waits of mean one."""
    bits = mix(key + np.asarray(counter, np.uint64) * _GOLDEN)
    return -np.log1p(-(bits >> _S11).astype(np.float64) * 2.0**-53)


class Shingles:
    """Multisets of hashed word shingles, with a bounded cache of word hashes."""

    def __init__(self, size: int = 5, cache: int = 500_000):
        self.size, self.most = size, cache
        self.cache: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        if len(self.cache) >= self.most:
            self.cache = {}
        value = self.cache[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value

    def of(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles in ascending order and how often each occurs; all words of a shorter
        text are one shingle."""
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        get = self.cache.get
        known = np.array([v if (v := get(w)) is not None else self._word(w) for w in words], np.uint64)
        n = max(1, len(words) - self.size + 1)
        total = np.full(n, np.uint64(min(len(words), self.size)))
        for k in range(min(self.size, len(words))):
            total = mix(total + known[k : k + n] * _POWERS[k % len(_POWERS)])
        return np.unique(total, return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sum of the minima and sum of the maxima of two multisets."""
    both, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][at], b[1][bt]).sum()) if len(both) else 0
    return least, int(a[1].sum()) + int(b[1].sum()) - least


def signatures(bags: Sequence[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """One row per non-empty multiset with its `size` entries: the times of the earliest points."""
    doc = np.repeat(np.arange(len(bags)), [len(x) for x, _ in bags])
    shingle = np.concatenate([x for x, _ in bags]) if bags else np.zeros(0, np.uint64)
    weight = np.concatenate([w for _, w in bags]).astype(np.int64) if bags else np.zeros(0, np.int64)
    entry = np.full(len(bags) * size, np.inf)
    parts = []
    low, octave = 0, 0
    while len(doc):
        length = max(1, low)
        key = mix(shingle + np.uint64((octave + 1) * int(_PLACE) % 2**64))
        parts.append((doc, key, np.full(len(doc), low), np.full(len(doc), length), weight, _draw(key, 0) / (length * size)))
        low += length
        octave += 1
        more = weight > low
        doc, shingle, weight = doc[more], shingle[more], weight[more]
    if not parts:
        return entry.reshape(len(bags), size)
    doc, key, low, length, weight, time = (np.concatenate(x) for x in zip(*parts))
    counter = np.zeros(len(doc), np.uint64)
    while len(doc):
        latest = entry.reshape(len(bags), size).max(axis=1)
        open_ = time <= latest[doc]
        doc, key, low, length, weight, time, counter = (x[open_] for x in (doc, key, low, length, weight, time, counter))
        leaf = length == 1
        # where few processes are left, each goes several points at a time
        ahead = 1 if leaf.sum() > 20_000 else 16
        ldoc, lkey, lcounter = doc[leaf], key[leaf], counter[leaf]
        steps = lcounter[:, None] + np.arange(1, ahead + 1, dtype=np.uint64)
        times = np.cumsum(np.concatenate([time[leaf][:, None], _draw(lkey[:, None], steps) / size], axis=1), axis=1)
        which = mix(lkey[:, None] * _SIDE + steps - np.uint64(1)) % np.uint64(size)
        np.minimum.at(entry, (ldoc[:, None] * size + which.astype(np.int64)).ravel(), times[:, :-1].ravel())
        split = ~leaf
        new = [(ldoc, lkey, low[leaf], length[leaf], weight[leaf], times[:, -1], lcounter + np.uint64(ahead))]
        if split.any():
            pkey, half = key[split], length[split] // 2
            heir = (mix(pkey ^ _SIDE) >> np.uint64(63)).astype(np.int64)
            for side in (0, 1):
                ckey = mix(pkey + _CHILD[side])
                clow = low[split] + side * half
                ctime = np.where(heir == side, time[split], time[split] + _draw(ckey, 0) / (half * size))
                owned = clow < weight[split]
                new.append(
                    tuple(x[owned] for x in (doc[split], ckey, clow, half, weight[split], ctime, np.zeros(len(ckey), np.uint64)))
                )
        doc, key, low, length, weight, time, counter = (np.concatenate(x) for x in zip(*new))
    return entry.reshape(len(bags), size)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit value per band of `rows` entries, different for equal entries of different bands."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), -1, rows)
    value = np.broadcast_to(np.arange(1, bits.shape[1] + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for k in range(rows):
        value = mix(value * _GOLDEN + bits[:, :, k])
    return value.view(np.int64)


def sketch(signature: np.ndarray) -> np.ndarray:
    """One byte per entry, for a quick estimate."""
    return (mix(np.ascontiguousarray(signature).view(np.uint64)) >> np.uint64(56)).astype(np.uint8)
