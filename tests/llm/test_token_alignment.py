import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import token_alignment as T
from marginalia.llm.queries import op11_token_alignment, vocabulary_path

LEFT, RIGHT = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")


def brute(texts):
    """Whole texts, all pairs of tokens of a group compared."""
    a, b = T._tokenizers(LEFT, RIGHT)
    found, counts = [], Counter()
    for text in texts:
        left = right = []
        if text:
            left, right = a.tokenizer.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)
            raw = (" " + text).encode()
            if b"".join(a.spelled.get(i, b"") for i in left) != raw or b"".join(b.spelled.get(i, b"") for i in right) != raw:
                left = right = []
        spans = []
        for ids, spelled in ((left, a.spelled), (right, b.spelled)):
            ends = np.cumsum([0, *(len(spelled[i]) for i in ids)]).tolist()
            spans.append([(s, e, i) for s, e, i in zip(ends, ends[1:], ids, strict=False)])
        stops = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, links = [], []
        for start, stop in zip([0, *stops], stops, strict=False):
            ga, gb = ([x for x in side if start < x[1] <= stop] for side in spans)
            groups.append(",".join(str(x[2]) for x in ga) + "|" + ",".join(str(x[2]) for x in gb))
            links += [(x[2], y[2]) for x in ga for y in gb if x[0] < y[1] and y[0] < x[1]]
        counts.update(links)
        found.append((left, right, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(len(x), len(y), len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for x, y, g, k in found]


TEXTS = ["plain words, plain words", None, "", " ", "  two  spaces  ", "tab\tand\nline  　 x", "<s> </s> <unk> <|endoftext|> <0x41>", "under▁score", "漢字 naïve 😀👩‍👩‍👧", "\x00\x7f", "plain", "plain", "a" * 5000, "zq " * 3000, "ﬁ Å é"]


def test_query_equals_brute_force(spark, docs, tmp_path):
    table = docs([(k % 12, t) for k, t in enumerate(TEXTS)]).withColumnRenamed("extra", "a.b").withColumnRenamed("hash", "links")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, *tuple(r)[1:]) for r in op11_token_alignment(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((k % 12, *w) for k, w in enumerate(brute(TEXTS)))


@pytest.mark.parametrize("broadcast", [True, False])
def test_containers_and_both_joins(spark, docs, monkeypatch, broadcast):
    monkeypatch.setattr(T, "CONTAINER", 4)
    monkeypatch.setattr(T, "ENTRIES", 20)
    monkeypatch.setattr(T, "BLOCK_BYTES", 100)
    monkeypatch.setattr(T, "MOST_BROADCAST", 10**6 if broadcast else 0)
    texts = TEXTS * 3
    got = [tuple(r)[1:] for r in T.alignment_digest(docs(list(enumerate(texts))).coalesce(2), LEFT, RIGHT).collect()]
    assert sorted(got) == sorted(brute(texts))


def test_counts_of_pairs(spark, docs):
    texts = ["plain words words", "plain", None]
    planes, rows = T.inverted_pairs(docs(list(enumerate(texts))), LEFT, RIGHT)
    a, b = T._tokenizers(LEFT, RIGHT)
    key = (a.tokenizer.encode(" words").ids[0], b.model.encode("words")[0])
    counts = {(r.a_id, r.b_id): (r.documents, r.links, r.is_best) for r in T.pair_counts(planes).collect()}
    assert counts[key] == (1, 2, True) and rows.count() == 3
    assert sum(n for _, n, _ in counts.values()) == sum(w[3] for w in brute(texts))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 299), st.integers(1, 700), max_size=60), min_size=1, max_size=6))
def test_planes_give_back_every_multiplicity(pairs):
    entries = sorted((row, k, place) for row, times in enumerate(pairs) for place, n in times.items() for k in range(10) if n >> k & 1)
    row, plane, place = (np.array([e[k] for e in entries], np.int64) for k in range(3))
    packed = T.pack_planes(row, plane, place, len(pairs), 300)
    got = [Counter() for _ in pairs]
    for r, k, p in zip(*T.unpack_planes(packed), strict=True):
        got[r][int(p)] += 1 << int(k)
    assert [dict(g) for g in got] == pairs


def test_whole_texts_where_tokens_may_span_words(monkeypatch):
    aligner = T.Aligner(LEFT, RIGHT)
    texts = pa.array([b" some words here", b"", b" some"], pa.large_binary())
    by_chunk = aligner.block(texts)
    whole = T.Aligner(LEFT, RIGHT)
    whole.by_chunk = False
    other = whole.block(texts)
    assert (by_chunk[0] == other[0]).all() and by_chunk[1] == other[1]


def test_empty_table(spark, docs):
    assert T.alignment_digest(docs([(1, "x")]).where("doc_id < 0"), LEFT, RIGHT).count() == 0
