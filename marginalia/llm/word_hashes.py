"""Vectorised word hashing shared by the operators that look at word windows.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text. Word hashes are
multilinear (sum of byte times a random number for its place, modulo 2**64) and then mixed; window
hashes are multilinear in the word hashes. Two different windows agree with probability about 2**-57.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is cut at white space.
SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_places = np.zeros(0, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_odd(n: int, stream: int = 0) -> np.ndarray:
    """The first n numbers of a fixed pseudo-random stream."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(stream << 32)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _place_numbers(n: int) -> np.ndarray:
    global _places
    if len(_places) < n:
        _places = random_odd(max(256, 2 * n))
    return _places


@dataclass
class Words:
    """The words of several texts: hash, owner (index of the text) and, if asked for, code points."""

    hashes: np.ndarray
    owner: np.ndarray
    chars: np.ndarray | None
    texts: int


def slices(data: Sequence[bytes]) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """Joined pieces of about SLICE_BYTES, each with the ends of its texts and the index of its first text."""
    held: list[bytes] = []
    size, first = 0, 0
    for i, raw in enumerate(data):
        if size and size + len(raw) > SLICE_BYTES:
            yield b" ".join(held), np.cumsum([len(x) + 1 for x in held]), first
            held, size, first = [], 0, i
        while len(raw) > SLICE_BYTES:
            cut = SLICE_BYTES
            while cut < len(raw) and not SPACE[raw[cut]]:
                cut += 1
            yield raw[:cut], np.array([cut + 1]), i
            raw = raw[cut:]
        if not held:
            first = i
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield b" ".join(held), np.cumsum([len(x) + 1 for x in held]), first


@dataclass
class Runs:
    """Maximal runs of marked bytes: where they start and stop, and their hashes."""

    starts: np.ndarray
    stops: np.ndarray
    hashes: np.ndarray
    prefixes: list[np.ndarray]


def hash_runs(raw: np.ndarray, marked: np.ndarray, prefixes: Sequence[int] = ()) -> Runs:
    """The runs of marked bytes of raw. prefixes: also the hashes of their first bytes, so many each."""
    edge = np.flatnonzero(np.diff(marked.astype(np.int8), prepend=0, append=0))
    starts, stops = edge[::2], edge[1::2]
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return Runs(starts, stops, none, [none for _ in prefixes])
    size = stops - starts
    at = np.flatnonzero(marked)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(at)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        value = _place_numbers(int(size.max()))[place] * (raw[at].astype(np.uint64) + np.uint64(1))
        count = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        hashes = mix64(np.add.reduceat(value, first) + count)
        beginnings = [mix64(np.add.reduceat(np.where(place < n, value, np.uint64(0)), first) + np.uint64(n)) for n in prefixes]
    return Runs(starts, stops, hashes, beginnings)


def words_of(texts: Sequence[str | None], lower: bool = False, chars: bool = False) -> Words:
    """All words of the texts in order. lower: A-Z become a-z first. Null counts as empty."""
    data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    if lower:
        data = [x.lower() for x in data]
    hashes, owner, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for joined, ends, first in slices(data):
        raw = np.frombuffer(joined, np.uint8)
        word = ~SPACE[raw]
        runs = hash_runs(raw, word)
        hashes.append(runs.hashes)
        owner.append(first + np.searchsorted(ends, runs.starts, side="right"))
        if chars and len(runs.starts):
            points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            lengths.append(points[runs.stops] - points[runs.starts])
    return Words(np.concatenate(hashes), np.concatenate(owner), np.concatenate(lengths) if chars else None, len(texts))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each window of n words in a row; those that cross from one text into the next are for the caller to drop."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for j, r in enumerate(random_odd(n, stream=n)):
            out += hashes[j : j + count] * r
    return mix64(out)


def parts(batch: pa.RecordBatch, column: int, rows: int = 500) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """A batch in parts of at most so many rows and about 4 million characters, each with its texts as strings."""
    for at in range(0, batch.num_rows, rows):
        piece = batch.slice(at, rows)
        texts = piece.column(column).to_pylist()
        for a, b in bounded(texts):
            yield piece.slice(a, b - a), texts[a:b]


def bounded(texts: Sequence[str | None], most: int = 4 * SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `most` characters together; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
