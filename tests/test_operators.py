import difflib
import hashlib
import hmac
import io
import random
import time
import zipfile

from pyspark.sql import functions as F

from marginalia.functions import text as t
from marginalia.functions.dialect import SPARK
from marginalia.operators import diff, fingerprints, grounding, plan, render, sequences, unify, verify
from marginalia.sources.docx import footnotes_of, read_footnotes


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_scalar_functions(spark):
    col = F.col("v")
    assert one(spark, t.norm_key(col), v="C.L.R, ’x’") == "clrx" and one(spark, t.norm_key(F.lit(None).cast("string")), v="") == ""
    assert one(spark, t.clean_field(col), v="  a \n b.,; ") == "a b" and one(spark, t.clean_field(col), v=" ., ") is None
    assert one(spark, F.expr(grounding.meaningful(SPARK, grounding.words(SPARK, "v"))), v="The Cat and the CAT v 7 b 1999") == ["cat", "7", "1999"]
    assert one(spark, F.expr(grounding.numbers(SPARK, "v", grounding.words(SPARK, "v"))), v="s 007 and 7 0 12, 150–5") == ["7", "0", "12", "150", "5", "155"]
    assert one(spark, t.fingerprint_form(col), v="“Été” — a–b,  c!") == "été - a-b c".replace("- ", "").replace("-", "")
    assert one(spark, t.legislation_key(col), v="Fire & Rescue Act (No 2)") == "fire and rescue act no 2"
    for n, want in ((1, "1st"), (2, "2nd"), (3, "3rd"), (4, "4th"), (11, "11th"), (12, "12th"), (13, "13th"), (21, "21st"), (111, "111th"), (112, "112th")):
        assert one(spark, t.ordinal(col), v=n) == want
    assert one(spark, t.html_plain(col), v="<p>a &amp;lt; b</p>") == "a &lt; b"
    assert one(spark, t.html_escape(col), v="<a & 'b'>\"") == "&lt;a &amp; &#39;b&#39;&gt;&quot;"
    assert one(spark, t.closing_stop(col), v="a") == "a." and one(spark, t.closing_stop(col), v="a?") == "a?"


def test_spans_shorten_and_expand(spark):
    rows = [("150", "155", "150–5"), ("150", "165", "150–65"), ("112", "115", "112–15"), ("99", "101", "99–101"), ("20", "10", "20–10"), ("1", "2", "1–2"), ("410", "411", "410–11")]
    df = spark.createDataFrame(rows, "a string, b string, want string").withColumn("span", t.shorten_span(F.col("a"), F.col("b")))
    first, last = t.expand_span(F.col("span"))
    for r in df.select("*", first.alias("f"), last.alias("l")).collect():
        assert r.span == r.want and (r.f, r.l) == (r.a, r.b)


def test_keyed_hash_is_hmac(spark):
    for key in (b"k", b"x" * 100):
        assert one(spark, t.keyed_hash(key, F.col("v")), v="é text") == hmac.new(key, "é text".encode(), hashlib.sha256).hexdigest()[:32]


def notes(spark, *content):
    """content: per note a list of (key, pinpoint)."""
    frame = spark.createDataFrame([("d", i) for i, _ in enumerate(content, 1)], "doc string, note int")
    rows = [("d", i, s, k, p) for i, note in enumerate(content, 1) for s, (k, p) in enumerate(note)]
    mentions = spark.createDataFrame(rows, "doc string, note int, seg int, key string, pinpoint string")
    return [(r.plan, r.suffix) for r in plan.citation_plan(frame, mentions).orderBy("note", "seg").collect()]


def test_citation_plans(spark):
    assert notes(spark, [("a", "4")], [("a", "4")], [("a", "5")]) == [("full", ""), ("ibid", ""), ("ibid", "5")]
    assert notes(spark, [("a", ""), ("b", "")], [("a", "")])[2] == ("subsequent", "")  # two sources before
    assert notes(spark, [("a", "")], [], [("a", "")])[1] == ("subsequent", "")  # a note without one between
    assert notes(spark, [("a", ""), ("a", "")])[1] == ("subsequent", "")  # same note
    assert notes(spark, [("a", "4")], [("a", "")])[1] == ("subsequent", "")  # pinpoint gone
    assert notes(spark, [("a", "")], [("a", "4")])[1] == ("ibid", "4")


def test_plan_equals_sequential_replay(spark):
    rng = random.Random(4)
    content = [[(rng.choice("abc"), rng.choice(["", "1", "2"])) for _ in range(rng.randrange(3))] for _ in range(60)]
    seen, want = set(), []
    for i, note in enumerate(content):
        for s, (k, p) in enumerate(note):
            before = content[i - 1] if i else []
            if k not in seen:
                want.append(("full", ""))
            elif s == 0 and len(before) == 1 and before[0][0] == k and not (p == "" and before[0][1] != ""):
                want.append(("ibid", p if p != before[0][1] else ""))
            else:
                want.append(("subsequent", ""))
            seen.add(k)
    assert notes(spark, *content) == want


def test_containment_boundaries(spark):
    line = lambda i: f"a line that is long enough {i}"
    doc = lambda ids: "\n".join(map(line, ids))
    rows = [(1, doc(range(5))), (2, doc(range(5))), (3, doc(range(4))), (4, doc(range(100, 110))), (5, doc([*range(100, 106), *range(200, 204)])), (6, doc([*range(100, 105), *range(300, 305)])), (7, None), (8, "short")]
    hashes = fingerprints.line_hashes(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    ranked = fingerprints.ranked_lines(hashes)
    got = {(r.new, r.earlier): r.shared for r in fingerprints.containment(ranked, 0.6).collect()}
    assert got == {(2, 1): 5, (5, 4): 6}
    assert {(r.new, r.earlier) for r in fingerprints.containment(ranked, 0.0).collect()} == {(2, 1), (5, 4), (6, 4), (6, 5)}


def test_unify_fold(spark):
    rows = [("d", 1, "x", None), ("d", 2, "x", "1"), ("d", 3, None, "1"), ("d", 4, "y", None), ("d", 5, None, None), ("d", 6, "x", "2"), ("e", 1, None, None), ("e", 2, None, None)]
    df = spark.createDataFrame(rows, "doc string, pos int, a string, b string")
    got = {(r.doc, r.pos): r.source for r in unify.unify(df, ["doc"], ["pos"], ["a", "b"]).collect()}
    assert [got["d", i] for i in range(1, 7)] == [1, 1, 1, 2, 3, 3] and got["e", 1] == got["e", 2] == 1


def test_verification(spark):
    records = [("HC", 2001, n, f"Smith v Crown{n}") for n in range(1, 21)] + [("HC", 2002, n, "x") for n in (1, 10)] + [("HC", 2003, n, "Lee v Kim") for n in range(1, 31)] + [("HC", 2001, 5, "Other name")]
    index = verify.build_index(spark.createDataFrame(records, "court string, year int, number int, title string"))
    claims = [("HC", 2001, 5, "Smith"), ("HC", 2001, 5, "Nobody"), ("HC", 2001, 24, "Smith"), ("HC", 2001, 23, "Smith"), ("HC", 2002, 99, "x"), ("HC", 2003, 99, "Lee"), ("FC", 2001, 1, "x")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(claims)], "id int, court string, year int, number int, name string")
    got = [r.outcome for r in verify.check_claims(df, index, 2003).orderBy("id").collect()]
    assert got == ["found", "name mismatch", "not found", "unchecked", "unchecked", "unchecked", "unchecked"]
    assert verify.build_index(spark.createDataFrame(records[:40], "court string, year int, number int, title string")).count() == 0


def test_sequences(spark):
    df = spark.createDataFrame([("u", i, k, v) for i, (k, v) in enumerate([("a", None), ("a", "x"), ("b", ""), ("a", "y"), ("b", None)], 1)], "u string, n int, k string, v string")
    assert [r.v for r in sequences.share_first(df, ["u", "k"], ["n"], "v").orderBy("n").collect()] == ["x", "x", "", "y", ""]
    assert {r.k: r.v for r in sequences.complete_first(df, ["u", "k"], ["n"], ["v"]).collect()} == {"a": "x", "b": None}
    assert [(r.island, r.n, r["first"]) for r in sequences.islands(df, "u", ["n"], F.col("k") == "a").orderBy("island").collect()] == [(1, 2, 1), (2, 1, 4)]
    failed = df.withColumn("failed", F.col("n") <= 3)
    r = sequences.failed_batches(failed, "u", "n", 3).first()
    assert r.whole_batch_failed and not r.payable and (r["n"], r.n_failed) == (5, 3)


def test_rendering(spark):
    base = dict.fromkeys("type name title year year_style volume issue report starting_page court_id judgment_number jurisdiction kind journal publisher edition document_type number forum date pinpoint".split())

    def shown(bibliography=False, **f):
        schema = ", ".join(f"{k} string" for k in base) + ", authors array<string>"
        row = {**base, "authors": None, **f}
        return spark.createDataFrame([tuple(row.values())], schema).select(render.full(bibliography).alias("x")).first().x

    assert shown(type="case", name="Ash v Birch", year="1987", volume="31", report="HLR", starting_page="59") == "*Ash v Birch* (1987) 31 HLR 59"
    assert shown(type="case", name="Ash v Birch", year="2012", court_id="HCA", judgment_number="7", pinpoint="[3]") == "*Ash v Birch* [2012] HCA 7, [3]"
    assert shown(type="case", name="A v B") == "*A v B* [MISSING: case citation (report or court details)]"
    assert shown(type="legislation", kind="act", title="Forest Act", year="1958", jurisdiction="Vic", pinpoint="s 3") == "*Forest Act 1958* (Vic) s 3"
    assert shown(type="legislation", kind="bill", title="Forest Bill", year="1958", jurisdiction="Cth") == "Forest Bill 1958 (Cth)"
    assert shown(type="legislation", kind="constitution", title="Constitution") == "*Constitution*"
    article = {"type": "journal_article", "authors": ["Ann Lee", "Bo Kim"], "title": "On Trees", "year": "2001", "volume": "27", "issue": "3", "journal": "Tree Law Review", "starting_page": "5", "pinpoint": "9"}
    assert shown(**article) == "Ann Lee and Bo Kim, ‘On Trees’ (2001) 27(3) *Tree Law Review* 5, 9"
    assert shown(True, **article) == "Lee, Ann and Bo Kim, ‘On Trees’ (2001) 27(3) *Tree Law Review* 5"
    assert shown(type="book", authors=["A B", "C D", "E F", "G H"], title="Woods", publisher="Leaf", edition="2", year="1999") == "A B et al, *Woods* (Leaf, 2nd ed, 1999)"
    assert shown(type="speech", authors=["A B"], title="T", forum="Hall", date="1 May 2000") == "A B, ‘T’ (Speech, Hall, 1 May 2000)"


def test_diff_rebuilds_and_equals_plain_matching():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(12))) + rng.choice(["", "\n", "  "]) for _ in range(2))
        cut = rng.randrange(len(a) + 1)
        old, new = [(a[:cut], True), (a[cut:], False)], [(b, False)]
        pieces = diff.diff_words(old, new)
        assert "".join(t for k, t, _ in pieces if k != "del") == b and "".join(t for k, t, _ in pieces if k != "ins") == a
        x, y = diff.words_of(old), diff.words_of(new)
        head = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        tail = next((i for i, (p, q) in enumerate(zip(x[head:][::-1], y[head:][::-1], strict=False)) if p != q), min(len(x), len(y)) - head)
        x_mid, y_mid = x[head : len(x) - tail], y[head : len(y) - tail]
        kept = head + tail + sum(m.size for m in difflib.SequenceMatcher(None, x_mid, y_mid, autojunk=False).get_matching_blocks())
        assert len(list(diff._matched(x, y))) == kept
    plain = lambda text: [(text, False)]
    assert diff.diff_words(plain("a b"), plain("a c")) == [("equal", "a ", False), ("del", "b", False), ("ins", "c", False)]
    assert diff.diff_words(plain("see Reed now"), [("see ", False), ("Reed", True), (" now", False)]) == [("equal", "see ", False), ("del", "Reed", False), ("ins", "Reed", True), ("equal", " now", False)]


def test_diff_of_long_texts():
    rng = random.Random(3)
    words = [str(rng.randrange(10**6)) for _ in range(30_000)]
    other = [w for w in words if rng.random() < 0.9] + ["x"]
    start = time.process_time()
    pieces = diff.diff_words([(" ".join(words), False)], [(" ".join(other), False)])
    assert time.process_time() - start < 10
    assert sum(len(t) for k, t, _ in pieces if k == "equal") > 0.85 * len(" ".join(words))


def test_diff_columns(spark):
    rows = [("same text", "same text"), (None, "new"), ("old", None), ("a b", "a c"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [[(p.op, p.text) for p in r.d] for r in df.select(diff.word_diff(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [[("equal", "same text")], [("ins", "new")], [("del", "old")], [("equal", "a "), ("del", "b"), ("ins", "c")], []]


def test_rendered_notes(spark):
    notes = spark.createDataFrame([(1, n) for n in range(1, 6)], "doc int, note int")
    rows = [(1, 1, 1, "a", "5", ""), (1, 2, 1, "a", "5", ""), (1, 3, 1, "a", "9", "See"), (1, 3, 2, "b", "", ""), (1, 4, 1, "a", "", ""), (1, 5, 1, "b", "2", "")]
    mentions = spark.createDataFrame(rows, "doc int, note int, seg int, key string, pinpoint string, signal string")
    sources = spark.createDataFrame([(1, "a", "*Reed v Calder*", "Reed"), (1, "b", "Lakes Inc. ", "Lakes")], "doc int, key string, cited string, short string")
    got = {r.note: r.text for r in plan.rendered_notes(plan.citation_plan(notes, mentions), sources).collect()}
    assert got == {1: "*Reed v Calder*, 5 (‘Reed’).", 2: "Ibid.", 3: "See ibid 9; Lakes Inc.  (‘Lakes’).", 4: "Reed (n 1).", 5: "Lakes (n 3) 2."}


def test_unify_equals_a_fold_in_order(spark):
    rng = random.Random(5)
    rows = [(g, i, *(rng.choice([None, None, "a", "b"]) for _ in range(3))) for g in range(30) for i in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "g int, i int, x string, y string, z string")
    got = {(r.g, r.i): r.source for r in unify.unify(df, ["g"], ["i"], ["x", "y", "z"]).collect()}
    for g in range(30):
        sources, known = [], {}
        for _, i, *details in sorted(r for r in rows if r[0] == g):
            key = tuple(details)
            if key not in known:
                fits = [k for k, s in enumerate(sources) if all(p is None or q is None or p == q for p, q in zip(s, details))]
                if len(fits) == 1:
                    sources[fits[0]] = [p if p is not None else q for p, q in zip(sources[fits[0]], details)]
                    known[key] = fits[0] + 1
                else:
                    sources.append(details)
                    known[key] = len(sources)
            assert got[g, i] == known[key]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def make_docx(body, notes, doctype=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"{doctype}<w:document {W}>{body}</w:document>")
        z.writestr("word/footnotes.xml", f"<w:footnotes {W}>{notes}</w:footnotes>")
    return out.getvalue()


def test_footnote_files(spark, tmp_path):
    ref = lambda i: f'<w:footnoteReference w:id="{i}"/>'
    notes = (
        '<w:footnote w:id="0" w:type="separator"/><w:footnote w:id="1"><w:p><w:r><w:t> Second</w:t></w:r></w:p></w:footnote>'
        '<w:footnote w:id="2"><w:p><w:r><w:rPr><w:i/></w:rPr><w:t>A v B</w:t></w:r><w:r><w:rPr><w:i w:val="0"/></w:rPr><w:t> (2001)</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p><w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t></w:r></w:p></w:footnote>'
    )
    data = make_docx(ref(2) + ref(1) + ref(2) + ref(9), notes)
    assert footnotes_of(data) == [(1, [{"text": "A v B", "italic": True}, {"text": " (2001)\nx\ty", "italic": False}]), (2, [{"text": "Second", "italic": False}]), (3, [])]
    (tmp_path / "a.docx").write_bytes(data)
    (tmp_path / "b.docx").write_bytes(make_docx(ref(1), notes, "<!DOCTYPE x>"))
    (tmp_path / "c.docx").write_bytes(b"no archive")
    rows = read_footnotes(spark, str(tmp_path)).collect()
    assert sorted((r.doc[-6:], r.note or 0, r.error is None) for r in rows) == [("a.docx", 1, True), ("a.docx", 2, True), ("a.docx", 3, True), ("b.docx", 0, False), ("c.docx", 0, False)]
