import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm.token_files import WordCache, decode_segment, encode_segment, open_token_files, read_token_files, tokenise_to_files, write_token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 9000])
@pytest.mark.parametrize("high", [1, 2, 300, 49408, 2**32 - 1])
def test_round_trip(n, high):
    x = np.random.default_rng(n + high).integers(0, high, n, endpoint=True, dtype=np.uint64).astype(np.uint32)
    x[::37] = 2**32 - 1
    assert (decode_segment(encode_segment(x)) == x).all()


def test_outliers_cost_exceptions_not_width():
    x = np.arange(1024, dtype=np.uint32) % 16 + 1000
    small = len(encode_segment(x))
    x[::100] = 2**31
    assert len(encode_segment(x)) < small + 11 * 8
    with pytest.raises(ValueError):
        decode_segment(b"nope" + bytes(16))


def encoded(cache, texts):
    ids, stops = cache.encode(pa.array(texts, pa.string()), 1)
    return [x.tolist() for x in np.split(ids, stops)[:-1]] if texts else []


@pytest.fixture(scope="module")
def cache_and_plain():
    return WordCache(PATH, most=3), tokenizer()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aBÉ'sst ,.\n\t\x1c<|endoftext|>ENDOFTX1İΣǅ日\u0301\u0958\u00a0", max_size=40), max_size=8))
def test_cache_equals_tokenizer(cache_and_plain, texts):
    cache, plain = cache_and_plain
    for _ in range(2):
        assert encoded(cache, texts) == [plain.encode(t, add_special_tokens=False).ids + [1] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from(["<|endoftext|>", "a <|EndOfText|> b", "x<|startoftext|>y", "", " ", "İstanbul, İ!"])), max_size=8))
def test_cache_equals_tokenizer_on_any_text(cache_and_plain, texts):
    cache, plain = cache_and_plain
    assert encoded(cache, texts) == [plain.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_every_character_beside_letters_and_signs(cache_and_plain):
    plain, cache = cache_and_plain[1], WordCache(PATH)
    characters = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for form in ("{0}<", "a{0}, <{0}a", "{0}e\u0301."):
        for a in range(0, len(characters), 20_000):
            texts = [form.format(c) for c in characters[a : a + 20_000]]
            want = [e.ids + [1] for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
            got = encoded(cache, texts)
            assert got == want, [t for t, x, y in zip(texts, got, want, strict=True) if x != y][:5]


def test_other_tokenizers_encode_whole_texts():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    plain, cache = Tokenizer.from_file(path), WordCache(path)
    texts = ["Hello,  World", None, "", "É x"]
    assert not cache.by_piece
    assert encoded(cache, texts) == [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_files_at_a_path(spark, docs, tmp_path):
    rows = [(i, f"text number {i} and more") for i in range(300)]
    path = f"file://{tmp_path}/tokens"
    segments = write_token_files(docs(rows).repartition(4), PATH, 1, segment_tokens=64, path=path)
    manifest = spark.read.parquet(f"{path}/manifest").orderBy("shard").collect()
    got = read_token_files(open_token_files(spark, path)).collect()
    assert sum(r.n_docs for r in manifest) == len(got) == 300 and sum(r.n_segments for r in manifest) == segments.count()
    assert [r.base for r in manifest] == np.cumsum([0] + [r.n_tokens for r in manifest])[:-1].tolist()


def test_files_of_documents(spark, docs):
    rows = [(5, "Hello, hello world's end"), (2, None), (9, ""), (-1, "x " * 5000), (5, "again"), (7, "é")]
    plain, want, start = tokenizer(), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tokenise_to_files(docs(rows).repartition(3), PATH, 1, segment_tokens=100)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == sorted(want)
    assert tokenise_to_files(docs(rows).limit(0), PATH, 1).count() == 0
