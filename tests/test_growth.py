"""Plans and memory that have to stay as they are when the tables grow."""

import os
import random
import re
import time
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia.functions.dialect import SPARK
from marginalia.jobs import catalogue, sources, texts
from marginalia.operators import diff, grounding
from marginalia.streaming import lifecycle

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_party_match_broadcasts_nothing_that_grows(spark):
    """Names repeat, so files of a million of them are under the threshold of a broadcast."""
    assert "BroadcastHashJoin" not in plan(catalogue.QUERIES["reported_band_match"](spark, FOLDER))


def test_bibliography_needs_no_join(spark):
    """Most fields of a source are null, so a table of all of them looks small after columns are dropped, and was broadcast."""
    assert "Join" not in plan(catalogue.QUERIES["bibliography"](spark, FOLDER))


@pytest.mark.parametrize("name", ["subsequent_references", "citation_fixes"])
def test_pinpoints_of_all_types_are_made_once(spark, monkeypatch, name):
    """Only they are written; of the fields of a source nothing is made that the result doesn't show."""
    tables = []
    monkeypatch.setattr(sources, "written", lambda df, of: tables.append(df.columns) or df)
    catalogue.QUERIES[name](spark, FOLDER)
    assert [len(columns) for columns in tables] == [3]


def test_an_order_adds_its_events_to_the_state_together():
    """A message for each event was most of the time."""

    class State(list):
        asked = 0

        def exists(self):
            self.asked += 1
            return bool(self)

        def get(self):
            self.asked += 1
            return iter(self)

        def appendList(self, rows):  # noqa: N802
            self.asked += 1
            self.extend(rows)

    orders, state = lifecycle._Orders("pending"), State()
    orders.init(type("Handle", (), {"getListState": lambda self, name, schema: state})())
    rows = [pd.DataFrame({"us": [k, k], "id": [k, k], "expected": ["pending", "pending"], "following": ["pending", "pending"]}) for k in range(50)]
    for batch in (rows[:30], rows):
        (out,) = list(orders.handleInputRows((7,), iter(batch), None))
    assert out[["applied", "conflicts", "last_event"]].values.tolist() == [[50, 0, 49]] and list(orders.handleInputRows((7,), iter(rows), None)) == []
    assert len(state) == 50 and state.asked <= 8


def test_blocks_of_long_remainders():
    """The blocks of difflib, which takes a hundred times as long where half of the words are gaps."""
    draw = random.Random(5)
    for size in (3, 20, 60):
        a, b = ([draw.choice([0, 0, 1, 2, 3, 1 << 21]) for _ in range(size)] for _ in "ab")
        want = [tuple(x) for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x.size]
        got = [(i + k, j + k) for i, j, n in diff.blocks(a, b) for k in range(n)]
        assert got == [(i + k, j + k) for i, j, n in want for k in range(n)]
    a, b = ([k for j in range(300) for k in (0, j * step)] for step in (1, -1))
    b = [abs(k) + 5000 if k else 0 for k in b]
    start = time.perf_counter()
    assert sum(n for _, _, n in diff.blocks(a, b)) == 301 and time.perf_counter() - start < 2


@pytest.mark.parametrize("name", ["span_expand", "span_shorten"])
def test_pairs_of_numbers_are_dealt_by_their_number(spark, monkeypatch, name):
    """Once and as numbers; twice the rows make twice the tasks."""
    monkeypatch.setattr(texts, "_PAIRS_OF_A_TASK", 1000)
    dealt = re.findall(r"Exchange hashpartitioning\(a#\d+L, b#\d+L, (\d+)\)", plan(catalogue.QUERIES[name](spark, FOLDER)))
    assert dealt == [str(spark.read.parquet(f"{FOLDER}/lineitem.parquet").count() // 1000 + 1)]


def test_mentions_are_dealt_once(spark):
    """The orders by customer for the numbers of notes, twice, and mentions with notes by document; no plan is joined with itself."""
    text = plan(catalogue.QUERIES["rendered_notes"](spark, FOLDER))
    assert text.count("Exchange hashpartitioning") == 3 and text.count("FileScan parquet [l_orderkey") == 1


def test_texts_are_dealt_before_their_words_are_compared(spark):
    """A file of one row group was compared by one task."""
    assert "REBALANCE_PARTITIONS" in plan(catalogue.QUERIES["token_coverage_gap"](spark, FOLDER))


def test_words_are_those_of_each_match_in_lower_case(spark):
    """For every character, alone and next to others: the text is put in lower case as a whole, and stops are looked for first."""
    sign = F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c")
    signs = spark.range(0x110000, numPartitions=8).where("id NOT BETWEEN 55296 AND 57343").select(sign)
    rows = signs.selectExpr("concat(c, ' a', c, 'B ', c, '.A.', c, '.b ', c, c, '. A', c, '’', c, ' 1', c, '2.C.', c) AS x")
    one_by_one = F.expr(r"transform(regexp_extract_all(replace(regexp_replace(x, r'\b([A-Za-z])\.', '$1'), '’', chr(39)), r'[0-9]+|\p{L}+(?:\x27\p{L}+)?', 0), w -> lower(w))")
    assert rows.where(F.expr(grounding.words(SPARK, "x")) != one_by_one).count() == 0 and rows.count() > 1_100_000


def lacked(original, made):
    """The rule of grounding.missing, word by word, for lower-case letters and digits."""
    of, m = (re.findall(r"[0-9]+|[a-z]+", x) for x in (original, made))
    tells = lambda w: w not in grounding.NOISE and (len(w) > 1 or w.isdigit())
    bare = lambda w: w.lstrip("0") or "0" if w.isdigit() else w
    held = {w for w in m if tells(w)} | {bare(w) for w in m if w.isdigit()} | {a + b for a, b in zip(m, m[1:])}
    halves = {w for a, b in zip(of, of[1:]) if a + b in held for w in (a, b)}
    return [w for w in dict.fromkeys(of) if tells(w) and w not in held and bare(w) not in held and w not in halves]


def test_missing_words_equal_those_found_word_by_word(spark):
    draw = random.Random(11)
    word = lambda: draw.choice(["to", "in", "net", "ne", "work", "twork", "a", "ab", "b", "cab", "7", "07", "007", "70", "0", "00", "into", "netw", "ork", "x" * 70, "y" * 3, "x" * 70 + "y" * 3, "x" * 69, "xyyy"])
    text = lambda n: " ".join(word() for _ in range(draw.randint(0, n)))
    rows = []
    for k in range(1500):
        made = text(7)
        rows.append((k, " ".join(filter(None, [made, text(9)])) if k % 2 else text(12), made))
    got = spark.createDataFrame(rows, "k int, o string, m string").select("k", F.expr(grounding.missing(SPARK, "o", "m"))).collect()
    want = {k: lacked(o, m) for k, o, m in rows}
    assert dict(map(tuple, got)) == want and len({tuple(w) for w in want.values()}) > 300


@pytest.mark.parametrize("kind", ["numbers", "words"])
def test_long_texts_cost_what_they_are_long(spark, kind):
    """Numbers with leading zeros were looked for one by one, words of many letters cut at each of them."""
    if kind == "numbers":
        original, made, want = " ".join(f"00{k}" for k in range(1, 60000)), " ".join(str(k) for k in range(2, 120000, 2)), [f"00{k}" for k in range(1, 60000, 2)]
    else:
        long = "".join(random.Random(3).choices("abcdefgh", k=40000))
        original, made, want = f"zz {long[:30000]} {long[30000:]} yy", long, ["zz", "yy"]
    start = time.perf_counter()
    (got,) = spark.createDataFrame([(original, made)], "o string, m string").select(F.expr(grounding.missing(SPARK, "o", "m"))).first()
    assert got == want and time.perf_counter() - start < 8
