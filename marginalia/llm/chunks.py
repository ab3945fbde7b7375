"""Texts cut before the white space that follows a word: pieces that no token of the usual tokenizers spans, so that equal ones are encoded once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BINARY = pa.large_binary()


def _buffer(column: pa.Array, k: int, kind: type) -> np.ndarray:
    buffer = column.buffers()[k]
    return np.frombuffer(buffer, kind) if buffer else np.zeros(0, kind)


def offsets_and_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of an array of large binaries without nulls."""
    offsets = _buffer(column, 1, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    return offsets - offsets[0], _buffer(column, 2, np.uint8)[offsets[0] : offsets[-1]]


def binaries(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(BINARY, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def as_bytes(texts: pa.Array | pa.ChunkedArray, prefix: bytes = b"") -> pa.Array:
    """Texts in UTF-8, null ones empty, each behind the prefix."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    column = pc.fill_null(texts, "").cast(pa.large_string()).cast(BINARY)
    return pc.binary_join_element_wise(pa.scalar(prefix, BINARY), column, pa.scalar(b"", BINARY)) if prefix else column


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about `most_bytes` of text; a longer text makes a run of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(sizes):
        before = int(sizes[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _ends_in_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Is the character before each place white space (or, to be safe, another sign up to U+0020)?"""
    last, second, third = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    two = (second == 0xC2) & ((last == 0x85) | (last == 0xA0))
    general = (third == 0xE2) & (((second == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))) | ((second == 0x81) & (last == 0x9F)))
    other = ((third == 0xE1) & (second == 0x9A) & (last == 0x80)) | ((third == 0xE3) & (second == 0x80) & (last == 0x80))
    return (last <= 0x20) | ((last >= 0x80) & (two | general | other))


def cut(texts: pa.Array, signs: bytes = b" \n\t\r") -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts in order, and where each text's chunks start (one more entry than texts).

    A text is cut before each of `signs` that follows a character other than white space. Empty texts have no chunks.
    """
    offsets, data = offsets_and_bytes(texts)
    wanted = np.zeros(256, bool)
    wanted[np.frombuffer(signs, np.uint8)] = True
    at = np.flatnonzero(wanted[data[1:]]) + 1
    at = at[~_ends_in_space(data, at)] if len(at) else at
    starts = np.zeros(len(data) + 1, bool)
    starts[at] = starts[offsets] = True
    places = np.flatnonzero(starts)
    return binaries(places, data), np.searchsorted(places, offsets)


class Known:
    """What a task has learnt about chunks: a growing table of chunks and the place of each.

    `look_up` gives the places of chunks and those that are new, in the order of their places. Beyond `most` chunks the table
    starts afresh, and the caller with it.
    """

    def __init__(self, most: int = 400_000) -> None:
        self.most = most
        self.chunks = pa.array([], BINARY)

    def look_up(self, chunks: pa.Array) -> tuple[np.ndarray, pa.Array, bool]:
        """Places of the chunks, new chunks, and whether the table has just started afresh."""
        afresh = len(self.chunks) > self.most
        if afresh:
            self.chunks = pa.array([], BINARY)
        coded = chunks.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.chunks)
        missing = pc.is_null(found)
        new = coded.dictionary.filter(missing)
        places = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        places[missing.to_numpy(zero_copy_only=False)] = len(self.chunks) + np.arange(len(new))
        self.chunks = pa.concat_arrays([self.chunks, new])
        return places[coded.indices.to_numpy(zero_copy_only=False)] if len(chunks) else np.zeros(0, np.int64), new, afresh
