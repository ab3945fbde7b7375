"""Token ids in patched frame-of-reference blocks.

Documents are dealt out by ranges of their id and sorted, so that shard after shard holds the ids of
documents in ascending order. A shard is a series of segments, each about `segment_tokens` ids of whole
documents; a segment is one row of a Parquet table in the shared folder, so that a lost executor costs
one task and half-written files are never seen. Its bytes hold blocks of BLOCK ids: the block's minimum
is subtracted, the rest is packed at the width that covers `percentile` percent of the block, and the
ids that need more bits leave their high bits in an exception list. The starts of all blocks stand in
the segment's header, so that any id is found without unpacking what comes before.

Layout of a segment (little-endian): b"PFR1", ids u32, blocks u32, 0 u32 | minimum u32[blocks] |
width u32[blocks] | exceptions u32[blocks] | start u32[blocks + 1] (in words of 4 bytes) | bodies: packed
words u32[32 * width] (lane-wise, 32 lanes of 32 ids), places u16[exceptions] padded to 4 bytes, high bits
u32[exceptions].

Null texts count as empty and hold the end id alone; a text of any length is encoded whole, texts of about 4 MB at once. Rows with the same id keep the order of their texts;
null ids come first. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.workspace import written

BLOCK = 1024
_HEAD = np.dtype("<u4")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 1024) numbers below 2**width to (blocks, width * 32) words."""
    lanes = values.reshape(len(values), 32, 32)
    out = np.zeros((len(values), width, 32), np.uint32)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        out[:, word] |= lanes[:, i] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= lanes[:, i] >> np.uint32(32 - shift)
    return out.reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    packed = words.reshape(len(words), width, 32)
    out = np.empty((len(words), 32, 32), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        x = packed[:, word] >> np.uint32(shift)
        if shift + width > 32:
            x = x | packed[:, word + 1] << np.uint32(32 - shift)
        out[:, i] = x & mask
    return out.reshape(len(words), -1)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint32)


def encode_segment(ids: np.ndarray, percentile: float = 90.0) -> bytes:
    """Any unsigned 32-bit ids, none included, to the bytes of a segment."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    table = padded.reshape(blocks, BLOCK)
    low = table.min(axis=1) if blocks else np.zeros(0, np.uint32)
    table = table - low[:, None]
    place = min(BLOCK - 1, int(BLOCK * percentile / 100))
    width = _bits(np.partition(table, place, axis=1)[:, place]) if blocks else np.zeros(0, np.uint32)
    bodies: list[bytes] = [b""] * blocks
    exceptions = np.zeros(blocks, np.uint32)
    for w in map(int, np.unique(width)):
        rows = np.flatnonzero(width == w)
        values = table[rows]
        high = values >> np.uint32(w) if w < 32 else np.zeros_like(values)
        packed = _pack(values & np.uint32((1 << w) - 1), w) if w else np.zeros((len(rows), 0), np.uint32)
        at, where = np.nonzero(high)
        first = np.searchsorted(at, np.arange(len(rows) + 1))
        tops = high[at, where]
        for k, row in enumerate(rows):
            a, b = first[k], first[k + 1]
            exceptions[row] = b - a
            body = packed[k].tobytes()
            if b > a:
                body += where[a:b].astype("<u2").tobytes() + b"\0\0" * (int(b - a) % 2) + tops[a:b].tobytes()
            bodies[row] = body
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in bodies])]).astype(_HEAD)
    head = b"PFR1" + np.array([n, blocks, 0], _HEAD).tobytes()
    return b"".join([head, low.astype(_HEAD).tobytes(), width.astype(_HEAD).tobytes(), exceptions.astype(_HEAD).tobytes(), starts.tobytes(), *bodies])


def decode_segment(data: bytes) -> np.ndarray:
    if data[:4] != b"PFR1":
        raise ValueError("not a token segment")
    words = np.frombuffer(data, _HEAD)
    n, blocks = int(words[1]), int(words[2])
    low, width, exceptions = (words[4 + k * blocks : 4 + (k + 1) * blocks] for k in range(3))
    starts = words[4 + 3 * blocks : 5 + 4 * blocks].astype(np.int64) + (5 + 4 * blocks)
    table = np.zeros((blocks, BLOCK), np.uint32)
    for w in map(int, np.unique(width)):
        rows = np.flatnonzero(width == w)
        if w:
            table[rows] = _unpack(words[starts[rows][:, None] + np.arange(32 * w)], w)
    for row in np.flatnonzero(exceptions):
        count, a = int(exceptions[row]), int(starts[row]) + 32 * int(width[row])
        places = np.frombuffer(data, "<u2", count, 4 * a)
        table[row, places] |= words[a + -(-count // 2) : a + -(-count // 2) + count] << width[row]
    return (table + low[:, None]).reshape(-1)[:n]


#: ASCII signs that are neither letters nor digits.
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
# The parts of a tokenizer file for which WordCache's short cuts hold.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def _folds_and_splits(spec: dict) -> bool:
    """Does the file describe a tokenizer that folds case, parts letters from digits and signs, and ends words with </w>?"""
    model = spec["model"]
    return (
        (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
        and (spec.get("pre_tokenizer") or {}).get("pretokenizers") == [_SPLIT, _BYTES]
        and (model.get("type"), model.get("end_of_word_suffix")) == ("BPE", "</w>")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback"))
        and not any(spec.get(k) for k in ("truncation", "padding"))
        and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )


def _strings(column: pa.Array) -> list[bytes]:
    """The bytes of an array of strings without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    raw = bytes(column.buffers()[2] or b"")
    return [raw[i:j] for i, j in zip(offsets, offsets[1:], strict=False)]


class WordCache:
    """Ids of texts by way of their pieces between white space, which no token of these tokenizers spans.

    Arrow cuts the texts of a part, looks their pieces up among the known ones, and finds the different new ones; these are
    encoded once. A stem of letters and the signs after it are encoded apart; new stems go together, cut again at the
    tokens that end a word. A letter counts as one only if the tokenizer's own normaliser and splitter keep it apart
    from a sign after it. Beyond `most` pieces those go that no part has asked for since the last time. Texts with the name
    of a special token, and all texts where the tokenizer isn't of this kind (see _folds_and_splits), go through the
    tokenizer whole.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_piece = _folds_and_splits(spec)
        self.special = sorted({t["content"].lower() for t in spec["added_tokens"]})
        self.words, self.values, self.asked = pa.array([], pa.string()), pa.array([], pa.large_binary()), np.zeros(0, bool)
        self.letters: set[str] = set()
        self.others: set[str] = set()
        if self.by_piece:
            vocabulary = self.tokenizer.get_vocab()
            self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
            self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
            # The same model for stems, which need no splitting: lower-case ASCII letters, and any letters.
            self.plain, self.folding = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.folding.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
            self.folding.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _is_letter(self, c: str) -> bool:
        return c.isalpha() and len(self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(f"a{c}a<"))) == 2

    def _are_stems(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which of these are lower-case ASCII letters, and which other letters that stay apart from signs."""
        read = lambda mask: mask.to_numpy(zero_copy_only=False)
        plain, other = read(pc.ascii_is_alpha(stems)), read(pc.utf8_is_alpha(stems))
        other &= ~plain
        if other.any():
            found = _strings(stems.filter(pa.array(other)))
            characters = set(b"".join(found).decode())
            for c in characters - self.letters - self.others:
                (self.letters if self._is_letter(c) else self.others).add(c)
            if not characters <= self.letters:
                other[other] = [self.letters.issuperset(x.decode()) for x in found]
        return plain, other

    def _whole(self, texts: Sequence[str]) -> list[bytes]:
        """One call for each text."""
        out = []
        for a in range(0, len(texts), 4096):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(list(texts[a : a + 4096]), add_special_tokens=False)]
        return out

    def _stems(self, stems: pa.Array, tokenizer) -> pa.Array:
        """The ids of different stems."""
        out = [pa.array([], pa.large_binary())]
        for a in range(0, len(stems), 1000):
            part = _strings(stems.slice(a, 1000))
            ids = np.array(tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends_word[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                ends = np.concatenate([[0], 4 * stops]).astype(np.int64)
                out.append(pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(ids)]))
            else:
                out.append(pa.array(self._whole([p.decode() for p in part]), pa.large_binary()))
        return pa.concat_arrays(out)

    def _ids_of(self, pieces: pa.Array) -> pa.Array:
        """The ids of different pieces."""
        stems = pc.ascii_rtrim(pieces, characters=_SIGNS.decode())
        plain, other = self._are_stems(stems)
        parts_, places = [], []
        for mask, tokenizer in ((plain, self.plain), (other, self.folding)):
            at = np.flatnonzero(mask)
            found = stems.take(pa.array(at)).dictionary_encode()
            tails = [p[n:].decode() for p, n in zip(_strings(pieces.take(pa.array(at))), pc.binary_length(stems).to_numpy()[at].tolist(), strict=True)]
            signs = pa.array(tails, pa.string()).dictionary_encode()
            ended = pa.array(self._whole(signs.dictionary.to_pylist()), pa.large_binary())
            both = [self._stems(found.dictionary, tokenizer).take(found.indices), ended.take(signs.indices)]
            parts_.append(pc.binary_join_element_wise(*both, pa.scalar(b"", pa.large_binary())))
            places.append(at)
        rest = np.flatnonzero(~plain & ~other)
        parts_.append(pa.array(self._whole(pieces.take(pa.array(rest)).to_pylist()), pa.large_binary()))
        order = np.argsort(np.concatenate([*places, rest]))
        return pa.concat_arrays(parts_).take(pa.array(order))

    def _forget(self) -> None:
        keep = self.asked if np.count_nonzero(self.asked) <= self.most // 2 else np.zeros(len(self.asked), bool)
        self.words, self.values = self.words.filter(pa.array(keep)), self.values.filter(pa.array(keep))
        self.asked = np.zeros(len(self.words), bool)

    def _look_up(self, pieces: pa.Array) -> np.ndarray:
        """The places of pieces among the known words; new ones are learnt."""
        if len(self.words) > self.most:
            self._forget()
        found = pc.index_in(pieces, value_set=self.words)
        if found.null_count:
            missing = pc.is_null(found)
            again = pieces.filter(missing).dictionary_encode()
            at = found.fill_null(0).to_numpy().copy()
            at[missing.to_numpy(zero_copy_only=False)] = again.indices.to_numpy() + len(self.words)
            self.words, self.values = pa.concat_arrays([self.words, again.dictionary]), pa.concat_arrays([self.values, self._ids_of(again.dictionary)])
            self.asked = np.concatenate([self.asked, np.zeros(len(again.dictionary), bool)])
        else:
            at = found.to_numpy()
        self.asked[at] = True
        return at

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """texts: strings, null like empty. The ids of all texts in a row, each text's ended by end_id, and where each text's stop."""
        texts, end = texts.fill_null(""), np.array([end_id], "<u4").tobytes()
        if not self.by_piece:
            each = [x + end for x in self._whole(texts.to_pylist())]
            return np.frombuffer(b"".join(each), "<u4"), np.cumsum([len(x) // 4 for x in each], dtype=np.int64)
        low = pc.ascii_lower(texts)
        whole = np.zeros(len(texts), bool)
        for name in self.special:
            whole |= pc.match_substring(low, name).to_numpy(zero_copy_only=False)
        if whole.any():
            low = pc.if_else(pa.array(whole), "", low)
        words = pc.ascii_split_whitespace(low)
        stops = words.offsets.to_numpy()[1:].astype(np.int64)
        index = self._look_up(words.flatten())
        more = []
        if whole.any():
            at = np.flatnonzero(whole)
            more = self._whole(texts.take(pa.array(at)).to_pylist())
            index = np.insert(index, stops[at], len(self.values) + np.arange(len(at)))
            stops = stops + np.cumsum(whole)
        index = np.insert(index, stops, len(self.values) + len(more))
        stops = stops + np.arange(1, len(stops) + 1)
        laid = pa.concat_arrays([self.values, pa.array([*more, end], pa.large_binary())]).take(pa.array(index))
        offsets = np.frombuffer(laid.buffers()[1], np.int64)[: len(index) + 1] // 4
        return np.frombuffer(laid.buffers()[2] or b"", "<u4", int(offsets[-1])), offsets[stops]


#: One cache a tokenizer and Python worker; later tasks of the worker use it again.
_caches: dict[str, WordCache] = {}


def _cache(path: str) -> WordCache:
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


_SCHEMA = "shard int, segment int, first_token bigint, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, data binary"


#: Characters of text that are encoded at once; a longer text stands alone.
PART_CHARS = 1 << 22


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about PART_CHARS bytes of its second column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    totals = np.cumsum(sizes)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(totals, totals[a] - sizes[a] + PART_CHARS, "right")))
        yield batch.slice(a, b - a)
        a = b


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", percentile: float = 90.0, segment_tokens: int = 1 << 20, path: str | None = None
) -> DataFrame:
    """Encodes and writes; returns the written table of segments, read back.

    path: the folder to make, in any store that Spark writes to; it then holds `segments`, the token files, and
    `manifest`, a row a shard with its base (ids of all shards before it), ids, documents and segments. Without one the
    segments go to the session's shared folder."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        cache: WordCache | None = None
        held_ids: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[int] = []
        size = segment = first = 0

        def flush() -> pa.RecordBatch:
            data = encode_segment(np.concatenate(held), percentile)
            columns = [[shard], [segment], [first], [size], [held_ids], [lengths], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["shard", "segment", "first_token", "n_tokens", "doc_ids", "doc_tokens", "data"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            cache = cache or _cache(tokenizer_path)
            for part in _parts(batch):
                ids, stops = cache.encode(part.column(1), end_id)
                doc_ids, at, done = part.column(0).to_pylist(), 0, 0
                while done < len(doc_ids):
                    # Whole documents up to the one that fills the segment.
                    b = min(len(doc_ids), int(np.searchsorted(stops, at + segment_tokens - size)) + 1)
                    stop = int(stops[b - 1])
                    held.append(ids[at:stop])
                    held_ids += doc_ids[done:b]
                    lengths += np.diff(stops[done:b], prepend=at).tolist()
                    size, at, done = size + stop - at, stop, b
                    if size >= segment_tokens:
                        yield flush()
                        first, segment, size, held, held_ids, lengths = first + size, segment + 1, 0, [], [], []
        if held:
            yield flush()

    rows = ranged.mapInArrow(encode, _SCHEMA)
    if path is None:
        return written(rows, "token-files")
    path = path.rstrip("/")
    rows.write.parquet(f"{path}/segments")
    segments = open_token_files(spark, path)
    shards = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"), F.sum(F.size("doc_ids")).alias("n_docs"), F.count(F.lit(1)).alias("n_segments"))
    shards.join(_bases(segments), "shard").write.parquet(f"{path}/manifest")
    return segments


def open_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The segments of token files written to path."""
    return spark.read.schema(_SCHEMA).parquet(f"{path.rstrip('/')}/segments")


def _bases(segments: DataFrame) -> DataFrame:
    """shard, base: the ids of all shards before it."""
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # One row a shard: a bounded table, whatever the number of documents.
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_token_files(segments: DataFrame) -> DataFrame:
    """From the files: doc_id, shard, start (ids of all documents before it), n_tokens and the ids' CRC-32."""
    bases = _bases(segments)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_segment(row["data"]).astype("<u4", copy=False)
                raw, lengths = memoryview(ids).cast("B"), np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * len(crc), pa.int32()), pa.array(row["first_token"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["doc_id", "shard", "offset", "n_tokens", "ids_crc32"],
                )

    found = segments.select("shard", "first_token", "doc_ids", "doc_tokens", "data").mapInArrow(decode, "doc_id bigint, shard int, offset bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "shard")


def tokenise_to_files(docs: DataFrame, tokenizer_path: str, end_id: int, **options) -> DataFrame:
    """Writes the token files of docs and returns what reading them back gives, per document."""
    return read_token_files(write_token_files(docs, tokenizer_path, end_id, **options))
