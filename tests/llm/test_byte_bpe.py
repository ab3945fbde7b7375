import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import byte_bpe, chunks
from marginalia.llm.queries import op13_byte_bpe, vocabulary_path, word_pattern

PATH = vocabulary_path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=word_pattern(), mergeable_ranks=byte_bpe.Merges.from_file(PATH).ranks, special_tokens={})


def of_texts(texts, encoder=None):
    ids, starts = (encoder or byte_bpe.Encoder(byte_bpe.Merges.from_file(PATH), word_pattern())).encode(chunks.as_bytes(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="ab 's 　\n\t1é#漢", max_size=60)), max_size=8))
def test_equals_the_library(reference, texts):
    assert of_texts(texts) == [reference.encode_ordinary(t or "") for t in texts]


def test_every_character_beside_letters_digits_and_spaces(reference):
    texts = [f"a{c} b {c}1{c}{c}  {c} \n{c}x" for c in map(chr, [*range(0x20, 0xD800, 7), *range(0xE000, 0x20000, 31)])]
    assert of_texts(texts) == [reference.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=2, max_size=6), max_size=14, unique=True), st.lists(st.text(alphabet="abc", max_size=14), max_size=8))
def test_replay_equals_one_word_at_a_time_for_any_order_of_ranks(tokens, words):
    """Vocabularies that no training makes too: a later merge may bring up an earlier rank."""
    ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + k for k, t in enumerate(tokens)}
    merges = byte_bpe.Merges(ranks)
    raw = [w.encode() for w in words]
    ids, starts = byte_bpe.replay(raw, merges)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [merges.alone(w) for w in raw]


def test_what_is_known_starts_afresh(reference):
    encoder = byte_bpe.Encoder(byte_bpe.Merges.from_file(PATH), word_pattern(), most_chunks=3)
    for texts in (["one two three four", "qzx qzx"], ["five six qzx", ""], ["one qzxqzx", None]):
        assert of_texts(texts, encoder) == [reference.encode_ordinary(t or "") for t in texts]


def test_long_texts_and_slices(spark, docs, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", 50)
    rows = [(1, "zyx" * 20_000 + " end"), (2, None), (3, ""), (3, "twice"), (4, "  lead and trail  "), (5, "<|endoftext|> plain")]
    got = {(r.doc_id, tuple(r.ids)) for r in byte_bpe.encode_documents(docs(rows), PATH, word_pattern()).collect()}
    assert got == {(i, tuple(reference.encode_ordinary(t or ""))) for i, t in rows}


def test_round_trip_and_digests(spark, docs, reference, tmp_path):
    rows = [(1, "naïve 漢字 text"), (None, "no id"), (3, None)]
    table = docs(rows).withColumnRenamed("extra", "a.b").withColumnRenamed("hash", "ids")
    encoded = byte_bpe.encode_documents(table, PATH, word_pattern())
    assert {(r.doc_id, bytes(r.bytes).decode()) for r in byte_bpe.decode_documents(encoded, PATH).collect()} == {(i, t or "") for i, t in rows}
    table.write.parquet(f"{tmp_path}/documents.parquet")
    for r in op13_byte_bpe(spark, str(tmp_path)).collect():
        text = dict(rows)[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark, docs):
    assert byte_bpe.bpe_digest(docs([(1, "x")]).where("doc_id < 0"), PATH, word_pattern()).count() == 0
