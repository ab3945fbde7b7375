import math
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm.toxicity import BEGINNINGS, WORD, Model, ToxicityRules, _counts, _scores, evidence, maximal_segments, tokens_of, toxicity


def brute(scores):
    """Ruzzo and Tompa by definition: the best segment, then left and right of it."""

    def split(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = -best[2], best[3]
        return split(a, i) + [(i, j, best[0])] + split(j, b)

    return split(0, len(scores))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=14))
def test_segments_equal_definition(scores):
    got = maximal_segments(np.array(scores, float))
    assert sum(s for *_, s in got) == sum(s for *_, s in brute(scores))
    assert all(sum(scores[a:b]) == s for a, b, s in got)


def test_token_offsets_are_code_points(monkeypatch):
    import marginalia.llm.word_hashes as wh

    texts = ["é Ünï, x", None, "ab " * 30 + "çd"]
    for size in (1 << 20, 16):
        monkeypatch.setattr(wh, "SLICE_BYTES", size)
        t = tokens_of(texts)
        assert [texts[o][a:b] for o, a, b in zip(t.owner, t.start, t.end, strict=True)] == ["é", "Ünï", "x"] + ["ab"] * 30 + ["çd"]


def test_held_out_accuracy(spark, docs):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ba", "do", "ki", "lu", "me", "no"]) for _ in range(rng.randrange(1, 5)))
    bad = ["vilescum", "vilerat", "grotfool", "grothead"]
    rows, labels = [], []
    for i in range(1500):
        w = [word() for _ in range(rng.randrange(5, 80))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        held = zlib.crc32(str(i).encode()) % 3 == 1
        labels.append((i, int(not toxic) if held else int(toxic)))  # held-out labels are wrong: they must not matter
    rows += [(9001, None), (9002, ""), (9003, rows[0][1])]
    got = {r.doc_id: r for r in toxicity(docs(rows), spark.createDataFrame(labels + [(9001, 1), (3, None)], "doc_id long, toxic int")).collect()}
    assert len(got) == len(rows)
    for i in range(1500):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].predicted == (i % 8 == 0), (i, got[i])
    assert got[0].score == got[9003].score and got[9001].predicted == got[9002].predicted == 0
    text = rows[8][1]
    assert any(w in text[p.start : p.end] for p in got[8].passages for w in bad)


def brute_scores(texts, labels, rules, rate):
    """Log-odds of words and beginnings from Python sets, level by level, as the chain of priors says."""
    from collections import Counter

    n = [(Counter(), Counter()) for _ in range(WORD + 1)]
    cut = lambda w, level: w if level == WORD else w[: BEGINNINGS[level]]
    for text, toxic in zip(texts, labels, strict=True):
        for level in range(WORD + 1):
            for key in {cut(w, level) for w in text.encode().split()}:
                n[level][1 - toxic][key] += 1

    def score(word, deepest):
        a, b = rules.prior * rate, rules.prior * (1 - rate)
        for level in range(deepest + 1):
            t, c = (n[level][k][cut(word, level)] for k in (0, 1))
            if level < deepest:
                t, c = (max(x - n[level + 1][k][cut(word, level + 1)], 0) for k, x in ((0, t), (1, c)))
            if level:
                share = min(rules.beginning_share, rules.beginning_weight / max(a + b, 1.0))
                a, b = share * a + rules.prior * rate, share * b + rules.prior * (1 - rate)
            a, b = a + t, b + c
        value = math.log(a / b) - math.log(rate / (1 - rate))
        return math.copysign(max(abs(value) - rules.errors * math.sqrt(1 / a + 1 / b), 0.0), value)

    return score


def test_scores_equal_brute_force(spark):
    rng = random.Random(4)
    stems = ["bad", "badness", "badnesses", "good", "goodly", "gone", "ba", "b", "middle", "mid", "éa", "éabcdefgh"]
    texts = [" ".join(rng.choices(stems, k=rng.randrange(1, 6))) for _ in range(120)]
    labels = [int("bad" in t and rng.random() < 0.8) for t in texts]
    rate, rules = sum(labels) / len(labels), ToxicityRules(errors=0.2)
    rows = spark.createDataFrame(list(zip(texts, labels, strict=True)), "text string, toxic int").repartition(3)
    table = _scores(_counts(rows), rate, rules).toPandas()
    levels = []
    for k in range(WORD + 1):
        part = table[table.level == k].sort_values("key", key=lambda x: x.to_numpy().view(np.uint64))
        levels.append((part.key.to_numpy().view(np.uint64), part.score.to_numpy()))
    model = Model(levels, rules)
    brute_score = brute_scores(texts, labels, rules, rate)
    known = {(level, w if level == WORD else w.encode()[: BEGINNINGS[level]]) for w in stems for level in range(WORD + 1)}
    for word in [*stems, "badnight", "goodest", "zzz", "éab"]:
        raw = word.encode()
        deepest = max((k for k in range(WORD + 1) if (k, word if k == WORD else raw[: BEGINNINGS[k]]) in known and (k < WORD or word in stems)), default=None)
        want = 0.0 if deepest is None else brute_score(raw, deepest)
        assert abs(model.token_scores(tokens_of([word]))[0] + rules.drift - want) < 1e-9, word


def test_result_does_not_hang_on_partitions(spark, docs):
    rng = random.Random(6)
    words = ["la", "lo", "mi", "re", "vile", "scum", "fa", "so"]
    rows = [(i, " ".join(rng.choices(words[:4] + words[6:], k=30)) + (f" {rng.choice(words[4:6])} x{i % 7}" if i % 5 == 0 else "")) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(50)]  # copies, dealt to several tasks
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows] + [(5, 0)], "doc_id long, toxic int")
    one, other = (sorted((r.doc_id, r.score) for r in toxicity(docs(rows).repartition(n), labels).collect()) for n in (1, 9))
    assert one == other and len(one) == len(rows)


def test_evidence_grows_with_every_different_segment():
    model = Model([], ToxicityRules(), lam=1.0, log_k=-4.0)
    one = evidence(100, [(0, 1, 3.0, 7)], model)
    assert evidence(100, [(0, 1, 3.0, 7)] * 9, model) == one > 0  # the same words again
    several = [evidence(100, [(0, 1, 3.0, k) for k in range(n)], model) for n in (1, 2, 4, 8, 400)]
    assert several == sorted(several) and several[-1] > 60 and evidence(100, [], model) == 0.0


def test_without_labels_or_rows(spark, docs):
    df = docs([(1, "a"), (2, None)])
    none = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert [r.score for r in toxicity(df, none).collect()] == [0.0, 0.0]
    assert toxicity(df.limit(0), none).count() == 0
