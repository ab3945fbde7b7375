"""Byte-level BPE by replaying the merges over a corpus of words.

A task cuts its texts into words by the vocabulary's pattern and keeps each different word once. An inverted index leads from
each merge to the places of all words where it applies; merges are applied in the order of their ranks, each to all its
places at once, and only the neighbours of a merged place change their entries. The ids of the words are then put back in
the texts. Nothing is shuffled: the corpus of a replay is the part of the table that a task holds (`BLOCK_BYTES` of text at
a time, with the words of earlier blocks kept), so memory is bounded and a lost executor costs its own tasks only.

A word that is a token itself takes that token, as in the tiktoken library. Where a merge brings up a pair of a lower rank than
its own (possible where several pairs spell one token) the order within that word matters; such words are encoded alone.

Null and empty texts have no tokens; texts of any length are read whole; each row is encoded by itself, so that repeated ids
and ties do no harm; an empty table gives an empty result. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import chunks as C

BLOCK_BYTES = 8 << 20
_NONE = np.iinfo(np.int64).max


class Merges:
    """The ranks of a vocabulary: bytes of every token, and for each pair of tokens the token that both spell."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.single < 0).any():
            raise ValueError("a byte-level vocabulary has a token for each byte")
        pairs = {(ranks[t[:i]] << 32 | ranks[t[i:]]): rank for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.token_bytes = pa.array(by_id, C.BINARY)

    @staticmethod
    @functools.cache
    def from_file(path: str) -> Merges:
        """A rank file: base64 of the token's bytes and its rank on each line."""
        with open(path, "rb") as file:
            return Merges({base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())})

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; _NONE where there is no such merge."""
        if not len(self.keys):
            return np.full(len(left), _NONE)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NONE)

    def alone(self, word: bytes) -> list[int]:
        """One word, merge after merge: the pair of least rank, the first of equal ones."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[k] + parts[k + 1], _NONE), k) for k in range(len(parts) - 1))
            if rank == _NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]


def _distinct(places: np.ndarray) -> np.ndarray:
    """The different places in order."""
    places = np.sort(places)
    return places[np.concatenate([[True], places[1:] != places[:-1]])] if len(places) else places


class _Index:
    """Places by rank, and the ranks in order."""

    def __init__(self) -> None:
        self.places: dict[int, list[np.ndarray]] = {}
        self.order: list[int] = []

    def add(self, ranks: np.ndarray, places: np.ndarray) -> None:
        known = ranks != _NONE
        ranks, places = ranks[known], places[known]
        if not len(ranks):
            return
        by = np.argsort(ranks, kind="stable")
        ranks, places = ranks[by], places[by]
        starts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
        for rank, group in zip(ranks[starts].tolist(), np.split(places, starts[1:]), strict=True):
            if rank not in self.places:
                self.places[rank] = []
                heapq.heappush(self.order, rank)
            self.places[rank].append(group)

    def least(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.order)
        groups = self.places.pop(rank)
        return rank, _distinct(np.concatenate(groups) if len(groups) > 1 else groups[0])


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and where each word's ids start (one more entry than words)."""
    lengths = np.array([len(w) for w in words], np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    total = int(bounds[-1])
    token = merges.single[np.frombuffer(b"".join(words), np.uint8)] if total else np.zeros(0, np.int64)
    after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
    filled = lengths > 0
    after[bounds[1:][filled] - 1] = -1
    before[bounds[:-1][filled]] = -1
    rank = np.full(total, _NONE)
    alive = np.ones(total, bool)
    disordered: set[int] = set()
    index = _Index()

    def look_again(places: np.ndarray) -> np.ndarray:
        found = merges.rank_of(token[places], token[after[places]])
        rank[places] = found
        index.add(found, places)
        return found

    look_again(np.flatnonzero(after >= 0))
    while index.order:
        least, places = index.least()
        places = places[(rank[places] == least) & alive[places]]
        if not len(places):
            continue
        # Of pairs that overlap in a row the first, the third and so on are merged.
        linked = np.concatenate([[False], after[places[:-1]] == places[1:]])
        numbers = np.arange(len(places))
        run = np.maximum.accumulate(np.where(linked, 0, numbers))
        places = places[(numbers - run) % 2 == 0]
        right = after[places]
        beyond = after[right]
        # What a merge sees to its right before the next one is applied.
        more = places[beyond >= 0]
        early = [more[merges.rank_of(np.full(len(more), least), token[beyond[beyond >= 0]]) < least]]
        token[places] = least
        alive[right] = False
        rank[right] = _NONE
        after[places] = beyond
        before[beyond[beyond >= 0]] = places[beyond >= 0]
        rank[places[beyond < 0]] = _NONE
        left = before[places]
        touched = _distinct(np.concatenate([left[left >= 0], places[beyond >= 0]]))
        found = look_again(touched)
        early.append(touched[found < least])
        if any(map(len, early)):
            disordered.update((np.searchsorted(bounds, np.concatenate(early), "right") - 1).tolist())
    kept = np.concatenate([[0], np.cumsum(alive)])
    ids, starts = token[alive], kept[bounds]
    if disordered:
        parts = np.split(ids, starts[1:-1])
        for k in disordered:
            parts[k] = np.array(merges.alone(words[k]), np.int64)
        ids, starts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return ids.astype(np.uint32), starts


class Encoder:
    """Texts to ids in blocks; what is known of chunks is kept up to a bound, by a worker from task to task."""

    @staticmethod
    @functools.lru_cache(maxsize=1)
    def of_worker(path: str, pattern: str) -> Encoder:
        return Encoder(Merges.from_file(path), pattern)

    def __init__(self, merges: Merges, pattern: str, most_chunks: int = 600_000) -> None:
        import regex

        self.merges, self.pattern = merges, regex.compile(pattern)
        self.known = C.Known(most_chunks)
        self.ids = self._lists(np.zeros(1, np.int64), np.zeros(0, np.uint32))

    @staticmethod
    def _lists(starts: np.ndarray, ids: np.ndarray) -> pa.Array:
        return pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), pa.array(ids, pa.uint32()))

    def _learn(self, new: pa.Array) -> pa.Array:
        words = [[p.encode() for p in self.pattern.findall(c.decode())] for c in new.to_pylist()]
        ranks = self.merges.ranks
        flat = list(chain.from_iterable(words))
        different = dict.fromkeys(flat)
        unknown = [w for w in different if w not in ranks]
        ids, starts = replay(unknown, self.merges)
        bounds = starts.tolist()
        spelled = dict(zip(unknown, zip(bounds, bounds[1:], strict=False), strict=True))
        places = {w: k for k, w in enumerate(different)}
        of_known = np.array([ranks.get(w, -1) for w in different], np.int64)
        spans = np.array([spelled.get(w, (0, 1)) for w in different], np.int64).reshape(-1, 2)
        lists = np.repeat(of_known, spans[:, 1] - spans[:, 0])
        ends = np.concatenate([[0], np.cumsum(spans[:, 1] - spans[:, 0])])
        lists[lists < 0] = ids
        taken = self._lists(ends, lists.astype(np.uint32)).take(pa.array([places[w] for w in flat], pa.int64()))
        bounds_of_words = np.concatenate([[0], np.cumsum(taken.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        return self._lists(bounds_of_words[np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)], taken.flatten().to_numpy(zero_copy_only=False))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (large binaries in UTF-8) one after another, and where each text's ids start."""
        chunks, starts = C.cut(texts)
        places, new, afresh = self.known.look_up(chunks)
        self.ids = pa.concat_arrays([self.ids.slice(0, 0) if afresh else self.ids, self._learn(new)])
        lists = self.ids.take(pa.array(places))
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        return lists.flatten().to_numpy(zero_copy_only=False), ends[starts]


def decode(ids: np.ndarray, starts: np.ndarray, merges: Merges) -> pa.Array:
    """The bytes of each run of ids."""
    offsets, data = C.offsets_and_bytes(merges.token_bytes.take(pa.array(ids)))
    return C.binaries(offsets[starts], data)


def _digests(data: np.ndarray, starts: np.ndarray) -> list[str]:
    view = memoryview(np.ascontiguousarray(data)).cast("B")
    bounds = starts.tolist()
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]


def _encoded(documents: DataFrame, id_column: str, text_column: str, path: str, pattern: str, schema: str, row) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(path, pattern)
        for batch in batches:
            for part in C.slices(batch, "text", BLOCK_BYTES):
                ids, starts = encoder.encode(C.as_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *row(ids, starts, encoder.merges)], names=names)

    names = [part.split()[0] for part in schema.split(", ")]
    narrow = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return narrow.mapInArrow(run, schema)


def encode_documents(documents: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the ids of each text (array of ints) by the rank file at `path`, which every worker can read."""

    def row(ids: np.ndarray, starts: np.ndarray, _: Merges) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))]

    return _encoded(documents, id_column, text_column, path, pattern, "doc_id long, ids array<int>", row)


def decode_documents(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """doc_id and the bytes that the ids of each row spell; null ids count as none, unknown ones raise an error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges.from_file(path)
        for batch in batches:
            lists = batch.column("ids")
            starts = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), decode(lists.flatten().to_numpy(zero_copy_only=False), starts, merges).cast(pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col(id_column).cast("long").alias("doc_id"), F.col(ids_column).alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def bpe_digest(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: n_tokens, the SHA-256 of its ids (unsigned 32-bit, little-endian) and of the bytes decoded from them."""

    def row(ids: np.ndarray, starts: np.ndarray, merges: Merges) -> list[pa.Array]:
        offsets, data = C.offsets_and_bytes(decode(ids, starts, merges))
        return [pa.array(np.diff(starts), pa.int64()), pa.array(_digests(ids.astype("<u4"), 4 * starts)), pa.array(_digests(data, offsets))]

    return _encoded(documents, "doc_id", "text", path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)
