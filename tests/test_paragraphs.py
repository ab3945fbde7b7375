"""Mapping, edits, pointers and tracked changes against plain versions."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia.functions.richtext import RUNS
from marginalia.operators import edits, mapping, pointers, references
from marginalia.sources import docx_sink
from marginalia.sources.docx import footnotes_of, read_footnotes

# ---- pieces back in their places


def plain_spans(text, pieces):
    """Character by character: a folded text with the place of each of its characters."""
    fold = lambda c: " " if c.isspace() else {"‘": "'", "’": "'", "“": '"', "”": '"'}.get(c, c)
    norm, at = [], []
    for i, c in enumerate(text):
        c = fold(c)
        if not (c == " " and norm and norm[-1] == " "):
            norm.append(c)
            at.append(i)
    norm, cursor, out = "".join(norm), 0, []
    for piece in pieces:
        piece = "".join(map(fold, (piece or "").replace("*", "") if "*" not in text else piece or ""))
        needle = " ".join(piece.split())
        if needle:
            needle = " " * piece.startswith(" ") + needle + " " * piece.endswith(" ")
        start = next((k for k, i in enumerate(at) if i >= cursor), len(at))
        k = norm.find(needle, start) if needle else -1
        if k < 0:
            out.append(None)
        else:
            out.append((at[k], at[k + len(needle) - 1] + 1))
            cursor = out[-1][1]
    return out


def test_forward_spans_equal_a_plain_version(spark):
    draw = random.Random(4)
    letters = ["a", "b", " ", "  ", "\t", "\n", "’", "'", "“", '"', ".", "*", "(", "\\", "$", "é", " ", "　", "漢", "😀"]
    make = lambda n, letters=letters: "".join(draw.choices(letters, k=draw.randrange(n)))
    rows = [(k, make(30), [make(4) for _ in range(draw.randrange(6))]) for k in range(300)]
    rows += [(900, "Smith v Smith; Smith", ["Smith", " v ", "Smith", "; ", "Smith", "Smith"]), (901, None, ["a"]), (902, "a", None), (903, "", [""]), (904, "x y", [None, "*x* y"])]
    rows += [(1000 + k, " a  b ", p) for k, p in enumerate([["a ", " b"], [" a", "b "], [" a ", "b"], ["a b"], ["b", "a"]])]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k int, text string, pieces array<string>").select("k", mapping.forward_spans(F.col("text"), F.col("pieces")).alias("s")).collect()}
    for k, text, pieces in rows:
        if text is None or pieces is None:
            assert got[k] is None
        else:
            assert [s and (s.start, s.end) for s in got[k]] == plain_spans(text, pieces), (text, pieces)


def test_styles_stay_with_pieces(spark):
    runs = [("See ", False), ("Smith  v\tJones", True), (" (2001) 5; ", False), ("Smith v Jones", True)]
    df = spark.createDataFrame([(runs, ["Smith v Jones (2001)", "gone", "Smith v Jones"])], f"runs {RUNS}, pieces array<string>")
    got = df.select(mapping.styled_pieces(F.col("runs"), F.col("pieces")).alias("p"), mapping.gaps(F.lit("a bc d"), F.expr("array(named_struct('start', 2, 'end', 3), null)")).alias("g")).first()
    assert [p and [tuple(r) for r in p] for p in got.p] == [[("Smith  v\tJones", True), (" (2001)", False)], None, [("Smith v Jones", True)]]
    assert got.g == ["a ", "c d"]


# ---- edits


def plain_edits(runs, given):
    chars = [(c, bool(i)) for t, i in runs for c in (t if t is not None else [None])]
    limit, made = None, []
    for e in sorted(given, key=lambda e: e[0], reverse=True):
        a, b, new, italic = e
        part = chars[max(a, 0) : b]
        fits = 0 <= a < b <= len(chars) and all(c is not None for c, _ in part) and (limit is None or b <= limit)
        if fits and (new is not None or any(i != bool(italic) for _, i in part)):
            made.insert(0, e)
            limit = a
    for a, b, new, italic in made[::-1]:
        chars[a:b] = [(c, chars[a][1]) for c in new] if new is not None else [(c, bool(italic)) for c, _ in chars[a:b]]
    return chars, made


def test_edits_of_any_order_give_the_plain_text(spark):
    draw = random.Random(6)
    rows = []
    for k in range(200):
        runs = [(None if draw.random() < 0.2 else "".join(draw.choices("abcé😀 ", k=draw.randrange(5))), draw.random() < 0.5) for _ in range(draw.randrange(6))]
        given = [(a := draw.randrange(-1, 14), a + draw.randrange(5), draw.choice([None, "", "X", "long"]), draw.choice([True, False, None])) for _ in range(draw.randrange(7))]
        rows.append((k, runs, given))
    rows += [(900, None, None), (901, [("abc", False)], None), (902, None, [(0, 1, "x", None)])]
    df = spark.createDataFrame(rows, f"k int, runs {RUNS}, edits array<{edits.EDIT}>")
    for r in edits.apply_edits(df).collect():
        chars, made = plain_edits(r.runs or [], [tuple(e) for e in r.edits or []])
        assert [(c, run.italic) for run in r.new_runs for c in (run.text if run.text is not None else [None])] == chars
        assert [tuple(e) for e in r.made] == made
        new = [c for c, _ in chars]
        for (_, _, text, _), at in zip(made, r.made_at, strict=True):
            assert text is None or "".join(new[at.start : at.end]) == text


def test_runs_and_spans_lead_to_each_other(spark):
    runs = [("See ", False), (None, False), ("Smith", True), (" x", False)]
    df = spark.createDataFrame([(1, runs), (2, None)], f"p int, runs {RUNS}")
    assert [tuple(r)[1:] for r in edits.flattened(df, ["p"]).collect()] == [(0, "See ", False, 0, 4), (1, None, False, 4, 5), (2, "Smith", True, 5, 10), (3, " x", False, 10, 12)]
    at = df.where("p = 1").select(edits.runs_of(edits.placed(F.col("runs")), F.lit(6), F.lit(11)).alias("r")).first().r
    assert [tuple(r) for r in at] == [(2, 1, 5), (3, 0, 1)]


# ---- pointers


def test_ends_of_chains_cycles_and_breaks(spark):
    rows = [("d", k, k - 1 if k else None, k == 0) for k in range(200)] + [("c", 0, 1, False), ("c", 1, 2, False), ("c", 2, 0, False), ("c", 3, 2, False)] + [("b", 1, 7, False), ("b", 2, 1, False), ("s", 1, 1, False), ("s", 2, None, True), (None, 1, None, True)]
    got = {(r.doc, r.k): (r.end_k, r.steps) for r in pointers.ends(spark.createDataFrame(rows, "doc string, k int, up int, top boolean"), ["doc", "k"], ["doc", "up"], "top").collect()}
    assert len(got) == len(rows)
    assert all(got["d", k] == (0, k) for k in range(200))
    assert all(got[key] == (None, None) for key in [("c", 0), ("c", 1), ("c", 2), ("c", 3), ("b", 1), ("b", 2), ("s", 1)]) and got["s", 2] == (2, 0)
    assert pointers.ends(spark.createDataFrame([], "k int, up int, top boolean"), ["k"], ["up"], "top").count() == 0


def test_references_by_number_and_by_name(spark):
    rows = [
        ("d", 1, "smith", "Smith v R", None), ("d", 2, None, None, 1), ("d", 3, "smith", None, 2), ("d", 4, "jones", "Jones, Book", None),
        ("d", 5, "smith", None, 4), ("d", 6, "smith", "Smith, Article", None), ("d", 7, "smith", None, 4), ("d", 8, None, None, 9), ("d", 9, "jones", None, 9), ("d", 10, "nobody", None, 1),
    ]
    got = {r.note: (r.outcome, r.root, r.steps) for r in references.resolved(spark.createDataFrame(rows, "doc string, note int, name string, source string, refers_to int")).collect()}
    assert got == {1: ("source", 1, None), 2: ("by number", 1, 1), 3: ("by number", 1, 2), 4: ("source", 4, None), 5: ("by name", 1, None), 6: ("source", 6, None), 7: ("unresolved", None, None), 8: ("unresolved", None, None), 9: ("by name", 4, None), 10: ("unresolved", None, None)}


# ---- tracked changes

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
NOTES = (
    f'<?xml version="1.0" encoding="UTF-8"?><w:footnotes {W} xmlns:x="urn:x"><w:footnote w:id="0" w:type="separator"><w:p/></w:footnote>'
    '<w:footnote w:id="2"><w:p><w:r><w:footnoteRef/></w:r><w:r><w:t xml:space="preserve"> See </w:t></w:r><w:r><w:rPr><w:i/></w:rPr><w:t>Smith v Jones</w:t></w:r><w:r x:keep="1"><w:t> [2001] &amp; é 5</w:t></w:r></w:p></w:footnote>'
    '<w:footnote w:id="3"><w:p><w:r><w:t>first</w:t></w:r><w:del w:id="1"><w:r><w:delText>old</w:delText></w:r></w:del></w:p><w:p><w:r><w:t>second part</w:t></w:r></w:p></w:footnote></w:footnotes>'
)


def archive(notes=NOTES):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {W}><w:footnoteReference w:id="3"/><w:footnoteReference w:id="2"/></w:document>')
        z.writestr("word/footnotes.xml", notes)
        z.writestr("word/media/a.bin", bytes(range(256)), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def styled(*runs):
    return [(c, i) for t, i in runs for c in t]


def part(data, name="word/footnotes.xml"):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return z.read(name)


@pytest.mark.parametrize(
    "new",
    [
        [("See ", False), ("Smith v Jones", True), (" [2002] & é 5", False)],
        [("Smith v Jones", True), (" [2001] & é 5", False)],
        [("See Smith v ", False), ("Brown", True), (" <x> \t[2001]\n& é 5 more", False)],
        [("wholly other", True)],
        [("See ", False), ("Smith v Jones", True), (" [2001] & é 5", False), ("!", True)],
    ],
)
def test_a_changed_note_reads_as_the_new_text(new):
    made, said = docx_sink.with_changes(archive(), [(2, styled(*new))], "A & B", "2024-01-01T00:00:00Z")
    assert said == [{"note": 2, "refused": None}]
    got = dict(footnotes_of(made))
    assert styled(*[(r["text"], r["italic"]) for r in got[2]]) == styled(*new)
    old = dict(footnotes_of(archive()))
    assert got[1] == old[1] and part(made, "word/media/a.bin") == bytes(range(256)) and part(made, "word/document.xml") == part(archive(), "word/document.xml")
    raw = part(made).decode()
    assert raw[raw.index('<w:footnote w:id="3">') :] == NOTES[NOTES.index('<w:footnote w:id="3">') :]
    # Without the changes it is the old text.
    import re

    undone = re.sub(r"<w:ins .*?</w:ins>", "", raw, flags=re.S).replace("w:delText", "w:t")
    undone = re.sub(r"<w:del w:id=\"9[^>]*>(.*?)</w:del>", r"\1", undone, flags=re.S)
    assert dict(footnotes_of(archive(undone)))[2] == old[2]


def test_no_change_and_refusals():
    same = styled(("See ", False), ("Smith v Jones", True), (" [2001] & é 5", False))
    made, said = docx_sink.with_changes(archive(), [(2, same), (9, same), (1, styled(("firstly second part", False)))], "a", "d")
    assert part(made) == NOTES.encode() and said == [{"note": 9, "refused": "no such note"}, {"note": 1, "refused": "a change across paragraphs"}]
    made, said = docx_sink.with_changes(archive(), [(1, styled(("first\nsecond thing", False)))], "a", "d")
    assert dict(footnotes_of(made))[1] == [{"text": "first\nsecond thing", "italic": False}]


def test_sink_writes_files_and_what_was_refused(spark, tmp_path):
    docx_sink.register(spark)
    new = [("other words", False)]
    rows = [("a.docx", archive(), [(2, new), (7, new)]), ("x/b.docx", archive(), None), ("bad.docx", b"none", [(1, new)])]
    df = spark.createDataFrame(rows, docx_sink.SCHEMA).repartition(2)
    df.write.format("tracked_docx").mode("append").option("path", str(tmp_path / "out")).save()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["_changes.jsonl", "a.docx", "b.docx"]
    said = [json.loads(line) for line in (tmp_path / "out" / "_changes.jsonl").read_text().splitlines()]
    assert sorted((s["name"], s["note"] or 0, s["refused"] is None) for s in said) == [("a.docx", 2, True), ("a.docx", 7, False), ("bad.docx", 0, False)]
    texts = {(r.doc[-6:], r.note): "".join(x.text for x in r.runs) for r in read_footnotes(spark, str(tmp_path / "out")).collect()}
    assert texts["a.docx", 2] == "other words" and texts["b.docx", 2].startswith("See Smith")
    with pytest.raises(Exception, match="append"):
        df.write.format("tracked_docx").mode("overwrite").option("path", str(tmp_path / "out")).save()


def test_an_abort_leaves_nothing(tmp_path):
    from pyspark.sql.types import Row

    writer = docx_sink._Writer(str(tmp_path / "out"), "a", "d")
    staged = writer.write(iter([Row(name="a.docx", content=archive(), notes=None)]))
    assert staged.names
    writer.abort([staged, None])
    assert list((tmp_path / "out").iterdir()) == []
