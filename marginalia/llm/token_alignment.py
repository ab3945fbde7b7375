"""How the tokens of two tokenizers meet over a corpus: inverted bitmaps of id pairs.

Both tokenizers encode each text; two tokens are linked where their byte ranges overlap, and the places where tokens of both
end cut a text into groups. For each pair of linked ids a container of documents (those that one task reads in a row, `CONTAINER`
of them at most) keeps compressed bitmaps: plane k holds the documents in which bit k of the pair's number of links is set.
The union of the planes is the pair's document bitmap, so popcounts give its documents, and popcounts weighted by 2**k its links.
A plane is a sorted list of 16-bit places or a bitmap, whichever is shorter. Containers hold different documents, so
their popcounts are added up; each then brings the pair's score back to its documents.

One pass over the texts writes planes and document rows to the shared folder; only pairs with their counts, and scores by document
are shuffled. A frequent pair has one row a container, so no key grows with its links. Scores are broadcast while
there are at most `MOST_BROADCAST` pairs, beyond that joined by shuffle. The best count of each right id is broadcast: it
has no more rows than the vocabulary.

Equal chunks of text (see chunks.cut) are encoded and aligned once a task. That is exact where no token spans the cut; where a
tokenizer isn't known to be of that kind, whole texts are encoded. A text whose tokens don't spell it has no tokens, nor
has a null or empty one: its row has zeros and an empty digest. Texts of any length are read whole. Rows that share an
id are documents of their own and each count. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import chunks as C
from marginalia.workspace import written

BLOCK_BYTES = 4 << 20
#: Documents of a container (places have 16 bits), and entries that a task holds before it closes one.
CONTAINER, ENTRIES = 1 << 16, 1 << 20
MOST_BROADCAST = 1_000_000
_DENSE = 0x80


def _from_byte_letters(token: str, table: dict[str, int]) -> bytes:
    return bytes(table[c] for c in token)


@functools.cache
def _byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable ones themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 0xAD]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE of a tokenizers file: ids and byte lengths of the tokens of texts."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec.get("pre_tokenizer") or {}
        self.by_chunk = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and bool(split.get("use_regex")) and not split.get("add_prefix_space")
        letters, vocabulary = _byte_letters(), self.tokenizer.get_vocab(with_added_tokens=False)
        self.spelled = {i: _from_byte_letters(token, letters) for token, i in vocabulary.items() if all(c in letters for c in token)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for a in range(0, len(texts), 4096):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[a : a + 4096], add_special_tokens=False)]
        return out


class Pieces:
    """A sentencepiece model that puts a space before each text; texts are given with that space."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spelled, spans_words = {}, False
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.spelled[i] = bytes([int(piece[3:-1], 16)])
            elif not (self.model.is_control(i) or self.model.is_unknown(i)):
                self.spelled[i] = piece.replace("▁", " ").encode()
                spans_words |= " " in piece.replace("▁", " ").lstrip(" ")
        probe = "a  b ﬁ Å\n c "
        self.by_chunk = not spans_words and self.model.decode(self.model.encode(probe)) == probe
        self.space = self.model.piece_to_id("▁")

    def encode(self, texts: list[str]) -> list[list[int]]:
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [[self.space] if t == " " else ids for t, ids in zip(texts, found, strict=True)]


@functools.cache
def _tokenizers(left: str, right: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(left), Pieces(right)


@functools.cache
def _spellings(left: str, right: str) -> tuple[_Spellings, _Spellings]:
    a, b = _tokenizers(left, right)
    return _Spellings(a.spelled, b",|"), _Spellings(b.spelled, b",;")


class _Spellings:
    """A vocabulary by id: byte lengths, bytes, and ids in digits before each separator."""

    def __init__(self, spelled: dict[int, bytes], separators: bytes) -> None:
        size = max(spelled, default=0) + 1
        self.lengths = np.array([len(spelled.get(i, b"")) for i in range(size)], np.int64)
        self.bytes = pa.array([spelled.get(i, b"") for i in range(size)], C.BINARY)
        self.digits = [b"%d%c" % (i, sign) for sign in separators for i in range(size)]

    def joined(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The bytes of each run of ids."""
        offsets, data = C.offsets_and_bytes(self.bytes.take(pa.array(ids)))
        return C.binaries(offsets[bounds], data)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and the number of each list."""
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


@dataclass(frozen=True)
class Aligned:
    """Texts that two runs of tokens spell: tokens, groups and links of each, the groups in writing, and the linked pairs."""

    counts: np.ndarray
    groups: pa.Array
    pairs: pa.Array


def align(left: np.ndarray, left_sizes: np.ndarray, right: np.ndarray, right_sizes: np.ndarray, a: _Spellings, b: _Spellings) -> Aligned:
    """Both runs spell the same text in each row. Every byte where a token of either ends closes one link, and every byte where
    tokens of both end closes one group."""
    ends_a, ends_b = np.cumsum(a.lengths[left]), np.cumsum(b.lengths[right])
    starts_a, starts_b = _bounds(left_sizes), _bounds(right_sizes)
    merged = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    twice = merged[1:] == merged[:-1]
    both, every = merged[1:][twice], merged[np.concatenate([np.ones(min(len(merged), 1), bool), ~twice])]
    of_a, of_b = np.searchsorted(ends_a, every), np.searchsorted(ends_b, every)
    pairs = left[of_a] << 32 | right[of_b]
    row_ends = np.concatenate([[0], ends_a])[starts_a]
    link_bounds, group_bounds = np.searchsorted(every, row_ends, "right"), np.searchsorted(both, row_ends, "right")
    group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
    last_a, last_b = both[group_a] == ends_a, both[group_b] == ends_b
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    size_a, size_b = len(a.lengths), len(b.lengths)
    written_ids = np.concatenate([left + size_a * last_a, 2 * size_a + right + size_b * last_b])[order]
    offsets, data = C.offsets_and_bytes(_digits(a, b).take(pa.array(written_ids)))
    token_bounds = starts_a + starts_b
    lists = pa.LargeListArray.from_arrays(pa.array(link_bounds.astype(np.int64)), pa.array(pairs))
    counts = np.stack([left_sizes, right_sizes, np.diff(group_bounds), np.ones(len(left_sizes), np.int64)], axis=1)
    return Aligned(counts, C.binaries(offsets[token_bounds], data), lists)


@functools.lru_cache(maxsize=2)
def _digits(a: _Spellings, b: _Spellings) -> pa.Array:
    return pa.array(a.digits + b.digits, C.BINARY)


class Aligner:
    """Alignment of chunks, each different one once; what is known is kept up to a bound, by a worker from task to task."""

    @staticmethod
    @functools.lru_cache(maxsize=1)
    def of_worker(left: str, right: str) -> Aligner:
        return Aligner(left, right)

    def __init__(self, left: str, right: str, most_chunks: int = 250_000) -> None:
        self.left, self.right = _tokenizers(left, right)
        self.a, self.b = _spellings(left, right)
        self.by_chunk = self.left.by_chunk and self.right.by_chunk
        self.known = C.Known(most_chunks)
        self._forget()

    def _forget(self) -> None:
        self.counts = np.zeros((0, 4), np.int64)  # left tokens, right tokens, groups, spelled alike
        self.groups = pa.array([], C.BINARY)
        self.pairs = pa.array([], pa.large_list(pa.int64()))

    def _learn(self, new: pa.Array) -> None:
        texts = [c.decode() for c in new.to_pylist()]
        left, left_sizes = _flat(self.left.encode(texts))
        right, right_sizes = _flat(self.right.encode(texts))
        same = [pc.equal(side.joined(ids, _bounds(sizes)), new).to_numpy(zero_copy_only=False) for side, ids, sizes in ((self.a, left, left_sizes), (self.b, right, right_sizes))]
        good = same[0] & same[1]
        found = align(left[np.repeat(good, left_sizes)], left_sizes[good], right[np.repeat(good, right_sizes)], right_sizes[good], self.a, self.b)
        counts = np.zeros((len(texts), 4), np.int64)
        counts[good] = found.counts
        place = np.cumsum(good) - 1
        at = pa.array(place, mask=~good)
        self.counts = np.concatenate([self.counts, counts])
        self.groups = pa.concat_arrays([self.groups, pc.fill_null(found.groups.take(at), b"")])
        self.pairs = pa.concat_arrays([self.pairs, found.pairs.take(at)])

    def block(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For texts (null or empty: b"", others behind a space): counts (left, right, groups, links), digests, and the entries
        document, pair, links (a document and pair may stand in several)."""
        if self.by_chunk:
            chunks, starts = C.cut(texts, b" ")
        else:
            full = np.diff(C.offsets_and_bytes(texts)[0]) > 0
            chunks, starts = texts.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])
        places, new, afresh = self.known.look_up(chunks)
        if afresh:
            self._forget()
        self._learn(new)
        n, size = len(texts), np.diff(starts)
        of = np.repeat(np.arange(n), size)
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.counts[places], axis=0)])
        counts = sums[starts[1:]] - sums[starts[:-1]]
        good = (counts[:, 3] == size) & (size > 0)
        counts[~good] = 0
        offsets, data = C.offsets_and_bytes(self.groups.take(pa.array(places)))
        bounds, view = offsets[starts].tolist(), memoryview(np.ascontiguousarray(data)).cast("B")
        digests = [hashlib.sha256(view[a : b - 1]).hexdigest() if g else "" for a, b, g in zip(bounds, bounds[1:], good.tolist(), strict=False)]
        keep = good[of]
        code = np.sort((of << 32 | places)[keep])
        code, often = _sums(code, None)
        document, place = code >> 32, pa.array(code & 0xFFFFFFFF)
        lists = self.pairs.take(place)
        length = lists.value_lengths().to_numpy(zero_copy_only=False)
        document, links = np.repeat(document, length), np.repeat(often, length)
        counts[:, 3] = _added(document, links, n)
        return counts, digests, document, lists.flatten().to_numpy(zero_copy_only=False), links


def _sums(keys: np.ndarray, values: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys the different ones, with the sum of their values (their number where values is None)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys))) if values is None else np.add.reduceat(values, first)


def _added(places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of integers by place."""
    out = np.zeros(n, np.int64)
    np.add.at(out, places, values)
    return out


def pack_planes(row: np.ndarray, plane: np.ndarray, place: np.ndarray, rows: int, documents: int) -> pa.Array:
    """The planes of `rows` pairs as lists of binaries, from one entry for each set bit, sorted by (row, plane, place).

    The first byte of a plane is its number, with the top bit set for a bitmap (bits from the lowest); else 16-bit places follow.
    """
    key, number = _sums(row << 8 | plane, None)
    bitmap = -(-documents // 8)
    dense = 2 * number > bitmap
    sizes = 1 + np.where(dense, bitmap, 2 * number)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    data = np.zeros(offsets[-1], np.uint8)
    data[offsets[:-1]] = (key & 0xFF) | np.where(dense, _DENSE, 0)
    firsts = np.concatenate([[0], np.cumsum(number)]).astype(np.int64)
    within = np.arange(len(place)) - np.repeat(firsts[:-1], number)
    sparse = ~np.repeat(dense, number)
    at = (np.repeat(offsets[:-1], number) + 1 + 2 * within)[sparse]
    data[at], data[at + 1] = place[sparse] & 0xFF, place[sparse] >> 8
    base = (np.repeat(offsets[:-1], number) + 1)[~sparse] + (place[~sparse] >> 3)
    np.bitwise_or.at(data, base, (1 << (place[~sparse] & 7)).astype(np.uint8))
    of_row = np.concatenate([[0], np.cumsum(np.bincount(key >> 8, minlength=rows))]).astype(np.int32)
    values = C.binaries(offsets, data).cast(pa.binary())
    return pa.ListArray.from_arrays(pa.array(of_row), values)


def unpack_planes(planes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each set bit: row, plane and place."""
    lists = np.repeat(np.arange(len(planes)), planes.value_lengths().to_numpy(zero_copy_only=False))
    offsets, data = C.offsets_and_bytes(planes.flatten().cast(C.BINARY))
    if not len(lists):
        return (np.zeros(0, np.int64),) * 3
    tags = data[offsets[:-1]]
    body = np.diff(offsets) - 1
    dense = (tags & _DENSE) > 0
    number = np.where(dense, 0, body // 2)
    firsts = np.concatenate([[0], np.cumsum(number)])[:-1]
    at = np.repeat(offsets[:-1] + 1 - 2 * firsts, number) + 2 * np.arange(number.sum())
    rows, bits, places = [np.repeat(lists, number)], [np.repeat(tags, number)], [data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8]
    for k in np.flatnonzero(dense).tolist():
        found = np.flatnonzero(np.unpackbits(data[offsets[k] + 1 : offsets[k + 1]], bitorder="little"))
        rows.append(np.full(len(found), lists[k]))
        bits.append(np.full(len(found), tags[k] & 0x7F))
        places.append(found)
    return np.concatenate(rows), np.concatenate(bits).astype(np.int64), np.concatenate(places)


class _Container:
    """Documents read in a row and the entries of their pairs, until they are packed."""

    def __init__(self) -> None:
        self.documents, self.entries, self.parts = 0, 0, []

    def add(self, n: int, document: np.ndarray, pair: np.ndarray, links: np.ndarray) -> None:
        self.parts.append((pair, document + self.documents, links))
        self.documents += n
        self.entries += len(pair)

    def packed(self, block: int) -> Iterator[pa.RecordBatch]:
        """A row for each pair: its links, its documents and its planes."""
        pair, document, links = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        codes = pa.array(pair).dictionary_encode()
        order = np.argsort(codes.dictionary.to_numpy(), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = rank[codes.indices.to_numpy()] << 16 | document
        by = np.argsort(key, kind="stable")
        key, links = _sums(key[by], links[by])
        row, place = key >> 16, key & 0xFFFF
        total = _added(row, links, len(order))
        bits = int(links.max()).bit_length() if len(links) else 0
        set_ = [(links >> k) & 1 == 1 for k in range(bits)]
        entry = np.concatenate([np.zeros(0, np.int64), *(row[s] for s in set_)])
        plane = np.concatenate([np.zeros(0, np.int64), *(np.full(np.count_nonzero(s), k) for k, s in enumerate(set_))])
        where = np.concatenate([np.zeros(0, np.int64), *(place[s] for s in set_)])
        by = np.argsort(entry << 8 | plane, kind="stable")
        planes = pack_planes(entry[by], plane[by], where[by], len(order), self.documents)
        columns = {"pair": pa.array(codes.dictionary.to_numpy()[order]), "block": pa.array(np.full(len(order), block)), "links": pa.array(total), "documents": pa.array(np.bincount(row, minlength=len(order))), "planes": planes}
        whole = _rows(columns, len(order))
        for a in range(0, len(order), 10_000):
            yield whole.slice(a, 10_000)


_COLUMNS = {"pair": pa.int64(), "block": pa.int64(), "links": pa.int64(), "documents": pa.int64(), "planes": pa.list_(pa.binary()), "place": pa.int32(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string()}
_SCHEMA = "pair long, block long, links long, documents long, planes array<binary>, place int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string"


def _rows(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[k].cast(t) if k in columns else pa.nulls(n, t) for k, t in _COLUMNS.items()], names=list(_COLUMNS))


def inverted_pairs(documents: DataFrame, left: str, right: str, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Planes (pair, block, links, documents, planes) and document rows (block, place, doc_id, n_a, n_b, n_groups, links,
    groups_sha256), written to the shared folder in one pass. `left` is a byte-level tokenizers file, `right` a sentencepiece model;
    every worker can read both."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, container, closed = Aligner.of_worker(left, right), _Container(), 0
        base = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in C.slices(batch, "text", BLOCK_BYTES):
                for start in range(0, part.num_rows, CONTAINER):
                    rows = part.slice(start, CONTAINER)
                    if container.documents and (container.entries > ENTRIES or container.documents + rows.num_rows > CONTAINER):
                        yield from container.packed(base + closed)
                        container, closed = _Container(), closed + 1
                    texts = pc.fill_null(rows.column("text"), "")
                    spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(" ", texts, ""))
                    counts, digests, document, pair, links = aligner.block(C.as_bytes(spaced))
                    n = rows.num_rows
                    place = pa.array(np.arange(container.documents, container.documents + n), pa.int32())
                    container.add(n, document, pair, links)
                    yield _rows({"block": pa.array(np.full(n, base + closed)), "place": place, "doc_id": rows.column("doc_id"), "n_a": pa.array(counts[:, 0]), "n_b": pa.array(counts[:, 1]), "n_groups": pa.array(counts[:, 2]), "links": pa.array(counts[:, 3]), "groups_sha256": pa.array(digests, pa.string())}, n)
        if container.parts:
            yield from container.packed(base + closed)

    both = written(documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, _SCHEMA), "alignment")
    return both.where("pair IS NOT NULL").select("pair", "block", "links", "documents", "planes"), both.where("pair IS NULL").select("block", "place", "doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256")


def pair_counts(planes: DataFrame) -> DataFrame:
    """a_id, b_id, documents, links of each pair of ids, and is_best: no pair of this b_id has more links."""
    counts = planes.groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links")).withColumn("b_id", F.expr("CAST(pair & 4294967295 AS INT)"))
    counts = written(counts, "pair-counts")
    best = counts.groupBy("b_id").agg(F.max("links").alias("most"))
    return counts.join(F.broadcast(best), "b_id").select("pair", F.expr("CAST(shiftright(pair, 32) AS INT)").alias("a_id"), "b_id", "documents", "links", (F.col("links") == F.col("most")).alias("is_best"))


def _scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the scores of each container's documents; a row for each document of a container that this task saw."""
    block, best, total = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def closed() -> pa.RecordBatch:
        place = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(place), block)), pa.array(place, pa.int32()), pa.array(best[place]), pa.array(total[place])], names=["block", "place", "n_best", "count_sum"])

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        cuts = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
            if a == b:
                continue
            if block != int(blocks[a]):
                if block is not None:
                    yield closed()
                block, best, total = int(blocks[a]), np.zeros(CONTAINER, np.int64), np.zeros(CONTAINER, np.int64)
            part = batch.slice(a, b - a)
            row, plane, place = unpack_planes(part.column("planes"))
            links = np.left_shift(1, plane)
            np.add.at(total, place, links * part.column("count").to_numpy()[row])
            top = part.column("is_best").to_numpy(zero_copy_only=False)[row]
            np.add.at(best, place[top], links[top])
    if block is not None:
        yield closed()


def document_scores(planes: DataFrame, counts: DataFrame) -> DataFrame:
    """block, place, n_best and count_sum of each document with links: what the pairs' planes bring back to it."""
    scored = counts.select("pair", F.col("links").alias("count"), "is_best")
    if scored.count() <= MOST_BROADCAST:
        joined = planes.select("pair", "block", "planes").join(F.broadcast(scored), "pair")
    else:
        joined = planes.select("pair", "block", "planes").join(scored, "pair").repartition("block").sortWithinPartitions("block")
    partial = joined.select("block", "planes", "count", "is_best").mapInArrow(_scores, "block long, place int, n_best long, count_sum long")
    return partial.groupBy("block", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_digest(documents: DataFrame, left: str, right: str) -> DataFrame:
    """Per document: tokens of both, groups, links, links whose pair is the best of its right id, sum of the links' counts, and the
    SHA-256 of the groups."""
    planes, rows = inverted_pairs(documents, left, right)
    scores = document_scores(planes, pair_counts(planes))
    return rows.join(scores, ["block", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("links").alias("n_links"), F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"
    )
