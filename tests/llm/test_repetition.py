import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm.repetition import RepetitionRules, _measure, keep_by_repetition, repetition_quality
from marginalia.llm.word_hashes import words_of

WORDS = r"[^\x20\x09-\x0D]+"


def brute(text):
    w = re.findall(WORDS, text or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(WORDS, line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


KEYS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b#|\u2003", max_size=120)), max_size=6))
def test_counts_equal_brute_force(texts):
    m = _measure(texts, RepetitionRules())
    for i, t in enumerate(texts):
        assert tuple(m[k][i] for k in KEYS) == brute(t)


def test_words_cross_slices(monkeypatch):
    import marginalia.llm.word_hashes as wh

    texts = ["one two three " * 20, None, "", "four " * 9 + "five"]
    whole = words_of(texts, chars=True)
    monkeypatch.setattr(wh, "SLICE_BYTES", 16)
    cut = words_of(texts, chars=True)
    assert whole.hashes.tolist() == cut.hashes.tolist() and whole.owner.tolist() == cut.owner.tolist() and whole.chars.tolist() == cut.chars.tolist()


def test_table(spark, docs):
    clean = " ".join(f"word{i}" for i in range(60))
    lines = "\n".join(["the very same line again"] * 3 + [" ".join(f"other{i}" for i in range(4))])
    df = docs([(1, None), (2, ""), (3, clean), (3, clean), (4, "spam " * 50), (5, lines)])
    rows = {r.doc_id: r for r in repetition_quality(df).collect()}
    assert repetition_quality(df).count() == 6
    assert not rows[1].kept and rows[1].base_failed and rows[2].n_words == 0
    assert rows[3].kept and not rows[4].kept and not rows[5].kept
    assert rows[5].n_dup_lines == 2 and rows[5].dup_line_chars == 40
    kept = keep_by_repetition(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [3, 3]
    assert repetition_quality(df.limit(0)).count() == 0 and keep_by_repetition(df.limit(0)).count() == 0
