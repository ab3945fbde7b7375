import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from marginalia.llm.mixing import Mix, mix_documents, mix_selection, source_domain

MIX = Mix(weights={"domain": {"web": 5, "books": 3}, "language": {"en": 3, "fr": 0}}, budget_percent=70, max_epochs=2, seed=3)


def deal(budget, children):
    """children: name, weight, cap."""
    out, open_ = {}, [c for c in children]
    while open_:
        total = sum(w for _, w, _ in open_)
        left = budget - sum(out.values())
        full = [c for c in open_ if c[1] > 0 and c[2] * total <= c[1] * left]
        if not full:
            for name, w, _ in open_:
                out[name] = w * left // total if total else 0
            return out
        first = min(full, key=lambda c: (c[2] / c[1], c[0]))
        out[first[0]] = first[2]
        open_.remove(first)
    return out


def domain(source):
    digits = "".join(c for c in source if c.isdigit())
    return ("web", "books", "forums")[int(digits) % 3] if digits else "other"


def brute(rows):
    docs = [(i, (domain(s or ""), lang or "", s or ""), len((t or "").split())) for i, t, lang, s in rows]
    tokens = Counter()
    for _, leaf, n in docs:
        tokens[leaf] += n
    caps = {k: v * MIX.max_epochs for k, v in tokens.items()}

    def level(prefix, budget, depth):
        names = sorted({k[depth] for k in caps if k[:depth] == prefix})
        weights = MIX.weights.get(("domain", "language", "source")[depth], {})
        given = deal(budget, [(n, weights.get(n, 1), sum(c for k, c in caps.items() if k[: depth + 1] == (*prefix, n))) for n in names])
        if depth == 2:
            return {(*prefix, n): g for n, g in given.items()}
        return {k: v for n, g in given.items() for k, v in level((*prefix, n), g, depth + 1).items()}

    budgets = level((), sum(tokens.values()) * MIX.budget_percent // 100, 0)
    picked = Counter()
    groups = defaultdict(list)
    for i, leaf, n in docs:
        groups[leaf].append((i, n))
    for leaf, members in groups.items():
        whole, partial = divmod(budgets[leaf], tokens[leaf]) if tokens[leaf] else (0, budgets[leaf])
        for e in range(whole):
            picked.update((i, e) for i, _ in members)
        before = 0
        for _, i, n in sorted((hashlib.md5(f"{MIX.seed}:{whole}:{i}".encode()).hexdigest(), i, n) for i, n in members):
            if before < partial:
                picked[i, whole] += 1
            before += n
    return picked


def test_equals_brute_force(spark, docs):
    langs, sources = ["en", "fr", "de", None], ["src0", "src1", "src2", "src10", "x", None]
    rows = [(i, None if i % 31 == 0 else "w " * ((i * 7) % 40), langs[(i // 3) % 4 if i % 5 else 0], sources[0 if i % 3 else i % 6]) for i in range(400)]
    df = docs(rows)
    got = Counter((r.doc_id, r.epoch) for r in mix_selection(df, source_domain(F.col("source")), MIX).collect())
    assert got == brute(rows)
    mixed = mix_documents(df, source_domain(F.col("source")), MIX)
    assert mixed.columns == df.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(i for (i, _), n in got.items() for _ in range(n))


def test_repeated_rows_and_empty_table(spark, docs):
    df = docs([(1, "a b c"), (1, "a b c"), (None, None)])
    assert {r.doc_id for r in mix_selection(df, source_domain(F.col("source")), Mix()).collect()} >= {1}
    assert mix_selection(df.limit(0), source_domain(F.col("source")), Mix()).count() == 0


def test_odd_sources(spark):
    names = ["src0", "src99999999999", "12345678901234567890123", "x٣", "", None, "src1x"]
    df = spark.createDataFrame([(s,) for s in names], "source string")
    got = [r[0] for r in df.select(source_domain(F.col("source"))).collect()]
    assert got == [("web", "books", "forums")[int(m.group()) % 3] if (m := re.search("[0-9]+$", s or "")) else "other" for s in names]


def test_other_columns_keep_their_names(spark):
    rows = [(k, "some words here", "en", f"src{k % 3}", "x", "y", 1) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `a.b` string, `row` string, `d``e` int")
    assert mix_documents(df, source_domain(F.col("source")), MIX).columns == df.columns
    assert mix_documents(df.limit(0), source_domain(F.col("source")), MIX).count() == 0
