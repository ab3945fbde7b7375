import random
import re
import time
from collections import defaultdict

from marginalia.llm import decontaminate
from marginalia.llm.decontaminate import UNITS, TemplateRules, canonical, candidates, drop_contaminated, find_contamination, index_benchmark, matches

RULES = TemplateRules()
ITEM = "Yesterday Alice had 3 apples and bought 5 more apples at the market near Paris. How many apples does Alice have after walking 12 km with the others?"


def found(text, item=ITEM, rules=RULES):
    return matches([text], index_benchmark([0], [item], rules), rules)


def test_verbatim_case_and_punctuation():
    assert found("so it goes " + ITEM + " and more") and found(ITEM.replace(".", " ").replace("apples", "Apples"))[0][3] == 0 and found(ITEM.upper())


def test_other_values_are_caught_only_if_consistent():
    other = ITEM.replace("Alice", "Bob").replace("3", "7").replace("5", "9").replace("Paris", "Rome").replace("12 km", "30 miles")
    assert found("Well. Then " + other)[0][3] > 0
    mixed = other.replace("does Bob", "does Carol")
    assert found(mixed, rules=TemplateRules(consistent=1.0)) == []


def test_clean_texts():
    assert found("Bob has 7 apples and that is all there is to say about it.") == []
    assert found("A B C D E F G H I J K L M N 1 2 3 4 5 6 7 8 9") == [] and found("") == [] and found(None) == []


def test_short_and_empty_items():
    b = index_benchmark([1, 2, 3], ["what is love about", "", None], RULES)
    assert [m[1] for m in matches(["tell me what is love about now", "what is that"], b, RULES)] == [0]


def test_items_that_say_too_little_are_listed(spark):
    """Items of a word or two would contaminate every text that holds them."""
    items = [(1, "Yes"), (2, "12 dollars"), (3, "What is it?"), (4, None), (5, ITEM)]
    b = index_benchmark([i for i, _ in items], [t for _, t in items], RULES)
    assert matches(["yes, it costs 12 dollars. What is it? Yes"], b, RULES) == []
    table = spark.createDataFrame(items, "item_id long, text string")
    assert {r.item_id for r in decontaminate.unsearchable_items(table).collect()} == {1, 2, 3, 4}
    assert decontaminate.unsearchable_items(table.limit(0)).count() == 0


def test_an_occurrence_among_many_chains_is_found():
    """Pieces of other occurrences between two halves of the item don't hide that these belong together."""
    hits = [(p, q, 8, 0) for p, q in [(0, 40), *((100 + 20 * k, 39 - k) for k in range(20)), (900, 41)]]
    assert any((0, 40, 8, 0) in c and (900, 41, 8, 0) in c for c in decontaminate._occurrences(hits))


def test_tables(spark, docs):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "nothing of this sort stands in any of the documents here"), (4, ITEM)], "item_id long, text string")
    df = docs([(1, "x. " + ITEM), (1, "x. " + ITEM), (2, None), (3, ""), (4, "clean words only and nothing else in here at all")])
    pairs = sorted((r.doc_id, r.item_id) for r in find_contamination(df, bench).collect())
    assert pairs == [(1, 1), (1, 1), (1, 4), (1, 4)]
    kept = drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert drop_contaminated(df, bench.limit(0)).count() == 5 and find_contamination(df.limit(0), bench).count() == 0


def test_blocks_of_the_benchmark(spark, docs, monkeypatch):
    monkeypatch.setattr("marginalia.llm.decontaminate.BLOCK_CHARS", 200)
    bench = spark.createDataFrame([(i, ITEM.replace("apples", f"fruit{chr(97 + i)}")) for i in range(8)], "item_id long, text string")
    df = docs([(10 + i, ITEM.replace("apples", f"fruit{chr(97 + i)}")) for i in range(8)])
    assert sorted((r.doc_id, r.item_id) for r in find_contamination(df, bench).collect() if r.windows_found == r.item_windows) == [(10 + i, i) for i in range(8)]
    assert drop_contaminated(df, bench).count() == 0


def test_several_occurrences_in_one_document():
    others = [ITEM.replace("Alice", a).replace("3", b).replace("5", c).replace("Paris", d) for a, b, c, d in (("Bob", "7", "9", "Rome"), ("Carol", "8", "4", "Oslo"), ("Dora", "6", "2", "Bonn"))]
    assert found(ITEM + " Then " + others[0])[0][3] == 0
    assert found("First " + " Then ".join(others))[0][3] > 0
    apart = ITEM.replace(" and bought", " so one reads it here in this long remark of many words and bought")
    assert found(others[0] + " Then " + apart) and found(" Then ".join(o.replace("does", "does the good old") for o in others))
    mixed = [o.replace("does " + n, "does Eve") for o, n in zip(others, ("Bob", "Carol", "Dora"), strict=True)]
    assert found(" Then ".join(mixed), rules=TemplateRules(consistent=1.0)) == []


def test_items_of_numbers():
    for item in ("What is 12 x 7?", "Solve 3x + 5 = 20", "1 2 4 8 16 32 64 128 256 512", "12 km 7 kg 9 ft", "Add 17 25 33 41 and 58 62 79 84 90 11"):
        assert found("so 5 " + item, item) and found(item.upper() + " 7", item) and found(item, item)[0][3] == 0
    assert found("What is 13 x 7?", "What is 12 x 7?") == [] and found("1 2 4 8 16 32 65 128 256 512", "1 2 4 8 16 32 64 128 256 512") == []
    mixed = ITEM + " " + " ".join(str(k) for k in range(100, 160))
    assert found(ITEM.replace("Alice", "Bob"), mixed) and found(" ".join(str(k) for k in range(100, 160)), mixed)
    bench = index_benchmark([0], ["In what year was it?"], RULES)
    assert [m[0] for m in matches(["there were 5", "In what year was it?", "there were 5. In what year was it?"], bench, RULES)] == [1, 2]


def test_partial_quotes_of_long_items():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    item, noise = " ".join(words), "so it goes on and on here"
    for size in (13, 27, 150):
        quote = " ".join(words[200 : 200 + size])
        assert found(f"{noise} {quote} {noise}", item)[0][2:4] == (size - 7, 0)
    assert found(" ".join(words[200:212]), item) == [] and found(" ".join(f"{' '.join(words[k : k + 12])} {noise}" for k in range(0, 150, 30)), item) == []
    assert found(" ".join(ITEM.split()[:14]) + " and so on", ITEM + " " + item)
    assert found("Yesterday Bob had 7 apples and bought 9 more apples at the market", ITEM + " " + item)[0][3] > 0


def brute_windows(text, n, literals):
    """Windows as tuples of strings, with places: names replaced, names kept, and those of few literals as they stand."""
    tokens = [(m.group().lower(), m.group(), m.start(), m.end()) for m in re.finditer(r"(?:[A-Za-z0-9\x80-\U0010ffff]|(?<=[0-9])[.,](?=[0-9]))+", text)]
    kinds, kept, exact = [], [], []
    for i, (low, raw, a, _) in enumerate(tokens):
        opening = i == 0 or re.search("[.!?:]", text[tokens[i - 1][3] : a])
        number = bool(re.search("[0-9]", raw))
        after_number = i > 0 and bool(re.search("[0-9]", tokens[i - 1][1]))
        name = not number and not opening and (raw[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or "À" <= raw[0] <= "Þ")
        unit = not number and not name and low in UNITS and after_number and not opening
        kinds.append("#" if number else "@" if name else "%" if unit else low)
        kept.append(low if name else kinds[-1])
        exact.append(number or low in UNITS and after_number)
    lows = [x[0] for x in tokens]
    out = []
    for p in range(len(tokens) - n + 1):
        for tag, shape in (("named", kinds), ("kept", kept)):
            if sum(x not in ("#", "@", "%") for x in shape[p : p + n]) >= literals:
                out.append(((tag, n, *shape[p : p + n]), p))
        if sum(not x for x in exact[p : p + n]) < literals:
            out.append((("exact", n, *lows[p : p + n]), p))
    return out, len(tokens)


def test_shared_windows_equal_brute_force(monkeypatch):
    rng = random.Random(8)
    words = "the Bob Anna 3 12 km kg. apples had more than who Rome? went 1,5 to see and".split()
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [text(rng.randrange(1, 25)) for _ in range(30)] + ["Read this and say how many of these there are: " + text(12) for _ in range(8)] + ["", None]
    docs = [text(rng.randrange(0, 60)) + " " + (items[rng.randrange(38)] or "") for _ in range(40)] + [None]
    for common in (1000, 2):
        monkeypatch.setattr(decontaminate, "COMMON", common)
        bench = index_benchmark(list(range(len(items))), items, TemplateRules(least_words=0))
        t = canonical(docs)
        first = [int(x) for x in __import__("numpy").searchsorted(t.owner, range(len(docs)))]
        got = {(d, i): sorted((p - first[d], q) for p, q, _, _ in hits) for d, i, hits in candidates(t, bench, RULES)}
        want = defaultdict(list)
        for i, item in enumerate(items):
            if not item:
                continue
            n = min(8, brute_windows(item, 1, 0)[1])
            mine = defaultdict(list)
            for w, q in brute_windows(item, n, min(n, 4))[0]:
                mine[w].append(q)
            for d, doc in enumerate(docs):
                for w, p in brute_windows(doc or "", n, min(n, 4))[0]:
                    want[d, i] += [(p, q) for q in mine.get(w, [])]
        want = {k: sorted(v) for k, v in want.items() if v}
        assert all(got[k] == want[k] for k in got)
        if common == 1000:
            assert set(got) == set(want)
        verdicts = matches(docs, bench, RULES)
        if common == 1000:
            every = verdicts
    assert verdicts == every  # common windows bring up fewer pairs, the same ones are contaminated


def test_planted_passages_and_clean_documents():
    """By construction: verbatim, with other values, and half of an item are found, mixed values and other text are not."""
    rng = random.Random(21)
    made = lambda: "".join(rng.choice(["ba", "do", "ki", "lu", "me", "no", "ra", "su"]) for _ in range(rng.randrange(2, 4)))
    prose = lambda n: " ".join(made() for _ in range(n))
    items = [f"{prose(6)} Name{k} {prose(4)} {k + 3} kg {prose(5)} Name{k} {prose(6)} {k + 90} {prose(6)}?" for k in range(40)]
    bench = index_benchmark(list(range(40)), items, RULES)
    for k, item in enumerate(items):
        other = item.replace(f"Name{k}", "Mira").replace(f" {k + 3} ", " 777 ").replace(f" {k + 90} ", " 888 ")
        words = item.split()
        texts = [f"{prose(30)} {item} {prose(30)}", f"{prose(30)} {other} {prose(9)}", f"{prose(9)} {' '.join(words[: len(words) * 2 // 3])}", item.upper(), prose(200), " ".join(words[:7])]
        assert [(d, i) for d, i, *_ in matches(texts, bench, RULES)] == [(d, k) for d in range(4)]


def test_preamble_of_many_items_costs_no_pairs():
    rng = random.Random(2)
    preamble = "Answer the following question as well as you can please"
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    items = [f"{preamble} " + " ".join(word() for _ in range(40)) for _ in range(3000)]
    bench = index_benchmark(list(range(3000)), items, RULES)
    docs = [f"{preamble} and so on {i}" for i in range(500)] + [items[7]]
    start = time.process_time()
    assert [(d, i) for d, i, *_ in matches(docs, bench, RULES)] == [(500, 7)]
    assert time.process_time() - start < 5
    # Items of next to nothing but numbers after the preamble: it alone is not a copy of them.
    sums = [f"{preamble}: " + " ".join(str(rng.randrange(10**6)) for _ in range(40)) for _ in range(50)]
    bench = index_benchmark(list(range(50)), sums, RULES)
    assert {d for d, *_ in matches([*docs[:20], sums[3]], bench, RULES)} == {20}
