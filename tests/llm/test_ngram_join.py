import random

import numpy as np
import pytest

from marginalia.llm import ngram_join
from marginalia.llm import partition_signatures as ps
from marginalia.llm.components import components

SIM = ps.Similarity()


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {i: sets_of(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    passage = [word() for _ in range(60)]
    rows, texts = [], []
    for _ in range(30):
        texts.append([word() for _ in range(rng.choice([1, 3, 4, 5, 6, 7, 9, 14, 40, 120]))])
    for base in texts[::2]:
        for _ in range(rng.randrange(5)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    hub = [word() for _ in range(110)]
    for _ in range(60):  # more near copies than a signature may have
        copy = list(hub)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(copy)
    for _ in range(50):
        texts.append(passage + [word() for _ in range(rng.choice([2, 8, 15, 30, 80]))])
    rng.shuffle(texts)
    for i, t in enumerate(texts):
        text = " ".join(t)
        rows.append((i * 3 + 1, text.upper() if i % 7 == 0 else text))
    return rows


@pytest.mark.parametrize("seed, frequent", [(1, 32), (2, 4), (3, 2)])
def test_components_equal_brute_force(spark, docs, monkeypatch, seed, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    rows = corpus(seed) + [(100001, None), (100002, ""), (100003, " \n ")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(rows).repartition(3)).collect()}
    assert got == brute(rows)


def test_pigeonhole_holds_for_linked_pairs():
    rng = np.random.default_rng(5)
    for n in (3, 4, 5, 8, 13, 30, 90, 400):
        for _ in range(30):
            base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            drop = rng.integers(0, max(1, n // 8) + 1)
            add = np.unique(rng.integers(0, 2**64, rng.integers(0, max(1, n // 8) + 1), dtype=np.uint64))
            other = np.union1d(rng.permutation(base)[drop:], add)
            if not len(other) or not ps.linked(base, other, SIM) or np.array_equal(base, other):
                continue
            common = [b for b, _ in ps.schemes(len(base), SIM) if b in dict(ps.schemes(len(other), SIM))]
            assert common
            sure = [b for b in common if ps.filled_segments(base, b, SIM) > dict(ps.schemes(len(base), SIM))[b]]
            for b in sure:
                if b == min(ps.band_of(len(base), SIM), ps.band_of(len(other), SIM)):
                    assert np.intersect1d(ps.sign(base, b, SIM).exact, ps.sign(other, b, SIM).exact).size


def test_components_of_long_path_and_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(50)) and len(got) == 251


def test_one_of_each_keeps_columns_and_null_ids(spark, docs):
    text = " ".join(f"w{i}" for i in range(30))
    df = docs([(7, text), (5, text), (9, text + " more"), (11, "other words that are here alone"), (None, None), (11, "other words that are here alone")])
    out = ngram_join.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 5), (False, 11), (False, 11), (True, 0)]
    assert ngram_join.ngram_components(df.limit(0)).count() == 0
