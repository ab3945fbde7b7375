"""Signatures for set similarity by universe partition and pigeonhole, in numpy.

Sets are sorted arrays of 64-bit hashes. Two sets of sizes s <= t with Jaccard similarity of at least p/q
differ in at most H = floor((q - p) (s + t) / (q + p)) elements. Sizes fall into bands; a pair is looked
for in the scheme of the band of its smaller set, so a set signs for its own band and for those below that hold
a size within reach. A scheme cuts the universe of hashes into M segments; if a set has more than H
segments with something in them, at least one of those is equal in both sets (else every one of them
would hold a difference). M is the cheapest number that leaves sets of the band enough such segments.

A segment's content is a sum of mixed hashes, so the content without one element is a subtraction.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from marginalia.llm.word_hashes import mix64, windows, words_of

_SCHEME, _SEGMENT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Similarity:
    """Links sets with q * intersection >= p * union. width: words of a shingle; growth: ratio of a band's ends."""

    p: int = 75
    q: int = 100
    width: int = 5
    growth: float = 1.6

    def differences(self, s: int, t: int) -> int:
        """The most elements in which linked sets of these sizes differ."""
        return (self.q - self.p) * (s + t) // (self.q + self.p)

    def largest_partner(self, n: int) -> int:
        return n * self.q // self.p

    def smallest_partner(self, n: int) -> int:
        return -(-n * self.p // self.q)


@lru_cache(maxsize=8)
def band_starts(growth: float) -> tuple[int, ...]:
    """The smallest size of each band, up to 2**40."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * growth)))
    return tuple(out)


def band_of(n: int, sim: Similarity) -> int:
    return bisect_right(band_starts(sim.growth), n) - 1


@lru_cache(maxsize=4096)
def segments(band: int, sim: Similarity) -> int:
    """The segments of a band's scheme: the fewest for which its largest sets have, three deviations below the mean, a tenth more filled segments than needed."""
    n = band_starts(sim.growth)[band + 1] - 1
    need = 1.1 * (sim.differences(n, sim.largest_partner(n)) + 1)

    def enough(m: int) -> bool:
        a = n / m
        mean = m * -math.expm1(-a)
        spread = math.sqrt(max(0.0, m * math.exp(-a) * (1 - (1 + a) * math.exp(-a))))
        return mean - 3 * spread >= need

    low, high = 2, 8 * n + 16
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if enough(mid) else (mid + 1, high)
    return low


@lru_cache(maxsize=65536)
def schemes(n: int, sim: Similarity) -> tuple[tuple[int, int], ...]:
    """(band, H) of each scheme in which a set of n elements can have a partner that differs from it."""
    out = []
    for band in range(band_of(sim.smallest_partner(n), sim), band_of(n, sim) + 1):
        top = band_starts(sim.growth)[band + 1] - 1
        as_smaller = sim.differences(n, sim.largest_partner(n)) if band == band_of(n, sim) else 0
        h = max(as_smaller, sim.differences(min(n, top), n))
        if h > 0:
            out.append((band, h))
    return tuple(out)


def shingle_sets(texts: list[str | None], sim: Similarity) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word windows; of all its words together where they are fewer than a window."""
    words = words_of(texts, lower=True)
    h = windows(words.hashes, sim.width)
    ends = np.searchsorted(words.owner, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= sim.width:
            out.append(np.unique(h[a : b - sim.width + 1]))
        else:
            out.append(windows(words.hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set, as two signed 64-bit numbers."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(s))
        x = np.array([s.sum(dtype=np.uint64) + n * _SCHEME, mix64(s ^ _SEGMENT).sum(dtype=np.uint64) + n])
    a, b = mix64(x).view(np.int64).tolist()
    return a, b


@dataclass
class Signed:
    """Of one set in one scheme: signatures of its filled segments and, if asked for, of them without one element each; and the units these are worth."""

    exact: np.ndarray
    without_one: np.ndarray
    units: int


def sign(s: np.ndarray, band: int, sim: Similarity, neighbours: bool = False) -> Signed:
    m = segments(band, sim)
    with np.errstate(over="ignore"):
        segment = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        starts = np.flatnonzero(np.diff(segment, prepend=np.uint64(1 << 62)))
        mixed = mix64(s)
        content = np.add.reduceat(mixed, starts)
        salt = np.uint64(band + 1) * _SCHEME + (segment[starts] + np.uint64(1)) * _SEGMENT
        exact = mix64(content + salt)
        if not neighbours:
            return Signed(exact, exact[:0], len(starts))
        sizes = np.diff(np.append(starts, len(s)))
        owner = np.repeat(np.arange(len(starts)), sizes)
        several = sizes[owner] > 1
        without = mix64((content[owner] - mixed + salt[owner])[several])
    return Signed(exact, without, int(2 * (sizes > 1).sum() + (sizes == 1).sum()))


def filled_segments(s: np.ndarray, band: int, sim: Similarity) -> int:
    """How many segments of the scheme hold an element of the set."""
    segment = ((s >> np.uint64(32)) * np.uint64(segments(band, sim))) >> np.uint64(32)
    return int((segment[1:] != segment[:-1]).sum()) + bool(len(s))


def linked(a: np.ndarray, b: np.ndarray, sim: Similarity) -> bool:
    common = len(a) + len(b) - len(np.union1d(a, b))
    return sim.q * common >= sim.p * (len(a) + len(b) - common)
