"""Rules for sources by type, on cases of our own after the shapes of the style guide's examples."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions.dialect import SPARK
from marginalia.operators import explain, formats, grounding, names, normalise
from marginalia.sources import jsonl, sinks

SCHEMA = ", ".join(["type string", *(f"`{f}` string" for f in normalise.TEXTS), *(f"`{f}` array<string>" for f in normalise.ARRAYS), *(f"`{f}` boolean" for f in normalise.FLAGS), "pinpoints array<struct<kind:string,value:string,plural:boolean>>"])


def source(spark, of_type, pins=(), **fields):
    row = {"type": of_type, "pinpoints": [{"kind": k, "value": v, "plural": p} for k, v, p in pins]} | fields
    df = spark.read.schema(SCHEMA).json(spark.sparkContext.parallelize([json.dumps(row)]))
    return normalise.normalise(df, of_type) if of_type in normalise.RULES and of_type != "case" else df


def made(spark, of_type, *columns, **fields):
    row = source(spark, of_type, **fields).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def cited(spark, of_type, pins=(), as_entry=False, **fields):
    df = source(spark, of_type, pins, **fields).withColumn("pinpoints", F.expr(formats.clean_pinpoints(SPARK))).withColumn("pin", F.lit("") if as_entry else F.expr(formats.pinpoints(SPARK)))
    return df.select(F.expr(formats.RULES[of_type](SPARK, as_entry))).first()[0]


def test_legislation(spark):
    assert made(spark, "legislation", "title", "year", "jurisdiction", title="Rivers Act 1993", jurisdiction="victoria") == ("Rivers Act", "1993", "Vic")
    assert made(spark, "legislation", "title", "kind", "jurisdiction", title="Commonwealth Constitution", kind="act") == ("Australian Constitution", "constitution", "Cth")


def test_people(spark):
    assert made(spark, "book", "authors", authors=["Professor Mira Calder AO", " The Hon Dr  Tom Reed QC,", "Professor Okoro", ""]) == ["Mira Calder", "Tom Reed", "Professor Okoro"]
    assert made(spark, "newspaper", "authors", "et_al", authors=["Ada Berg et al."], title="x") == (["Ada Berg"], True)
    assert made(spark, "website", "website_name", "authors", authors=["Harbour Library"], title="x") == ("Harbour Library", [])
    assert made(spark, "parliamentary_debates", "speaker", "chamber", "jurisdiction", "date", speaker="Senator the Hon Mira Calder QC", chamber="H of R", jurisdiction="Cth", date="3rd March 2022") == ("Mira Calder", "House of Representatives", "Commonwealth", "3 March 2022")


def test_other_types(spark):
    assert made(spark, "report", "title", "document_type", title="Review of Rivers: Final Report") == ("Review of Rivers", "Final Report")
    assert made(spark, "submission", "author", "submission_number", "body", "inquiry", author="Name withheld", submission_number="Submission No. 119", inquiry="Royal Commission into Lakes") == (None, "119", "Royal Commission into Lakes", None)
    assert made(spark, "speech", "lecture", lecture="the 27th Annual River Lecture", title="x") == "River Lecture" and made(spark, "speech", "lecture", lecture="Keynote address", title="x") is None
    assert made(spark, "dictionary", "edition", "retrieved", "online", "definition", "entry", edition="5th edn", retrieved="online at 3rd May 2020", definition="def 4", entry="‘river’") == ("5", "3 May 2020", True, "4", "river")
    assert made(spark, "social_media", "username", "platform", username="river", platform="twitter") == ("@river", "Twitter")
    assert made(spark, "treaty", "treaty_series", "parties", treaty_series="999 U.N.T.S. 171", parties=[" A ,", ""]) == ("999 UNTS 171", ["A"])
    got = made(spark, "un_document", "resolution", "session", "meeting", "plenary", "committee", "agenda_items", "document_number", resolution="General Assembly Resolution 61/295", session="54th sess", meeting="93rd plen mtg", committee="Third Committee", agenda_items=["Agenda items 42, 88 and 166"], document_number="U.N. Doc A/RES/61/295")
    assert got == ("GA Res 61/295", "54", "93", True, "3", ["42", "88", "166"], "A/RES/61/295")
    assert made(spark, "media_release", "body", "document_number", authors=["River Watch"], bodies=True, body="river watch", document_number="No. 5", title="x") == (None, "5")
    assert made(spark, "explanatory_memorandum", "title", "year", "document_type", title="Rivers Bill 2009") == ("Rivers Bill", "2009", "Explanatory Memorandum")


def test_cases_by_dimensions(spark):
    series = spark.createDataFrame([("Harbour Law Reports", "HLR", "round", 1950), ("H.L.R.", "HLR", "round", 1950)], "variant string, abbreviation string, style string, square_before int")
    courts = spark.createDataFrame([("Harbour Court", "HbC")], "variant string, abbreviation string")

    def case(**fields):
        df = source(spark, "case", **fields)
        return tuple(normalise.normalise(normalise.with_dimensions(df, series, courts), "case").select("name", "report", "year_style", "starting_page", "court_id").first())

    assert case(name="Reed v. Calder Pty. Ltd (No 2)", report="harbour law reports", year="1949", starting_page="5") == ("Reed v Calder Pty Ltd [No 2]", "HLR", "square", "5", None)
    assert case(name="Reed", court_id="H.L.R.", judgment_number="562", year="1990") == ("Reed", "HLR", "round", "562", None)
    assert case(name="Reed", court_id="harbour court", judgment_number="5", year="1990") == ("Reed", None, "square", None, "HbC")
    assert case(name="Reed", report="ZZR.", year="1990") == ("Reed", "ZZR", None, None, None)


def test_keys(spark):
    key = lambda kind, **fields: normalise.keyed(source(spark, kind, **fields)).select("source_key").first()[0]
    assert key("legislation", title="Rivers Act", year="1993", jurisdiction="Vic.") == key("legislation", title=" rivers act 1993", jurisdiction="victoria") == "legislation:riversact:1993:vic"
    assert key("case", report="HLR", volume="5", starting_page="9", name="A v B") == "case:hlr:5:9" and key("case", name="A v. B") == "case:name:avb"
    assert key("book", authors=["Ada van der Berg"], title="On Rivers", year="2001").split("\x1f")[0] == "book:berg:onrivers"
    assert key("treaty", title="T", parties=["B", "A"], opened_for_signature="1 May 1999", treaty_series="9 UNTS 1") == "treaty:t\x1fa–b\x1f1999\x1f9unts1"
    assert key("un_document", document_number="A/RES/5") == "un:a/res/5"


def test_formats(spark):
    assert cited(spark, "book_chapter", [("page", "53", False)], authors=["Mira Calder"], chapter_title="Flow", editors=["Tom Reed", "Ada Berg"], book_title="Rivers", publisher="Lawbook Co", edition="2", year="2008", starting_page="41") == "Mira Calder, ‘Flow’ in Tom Reed and Ada Berg (eds), *Rivers* (Lawbook, 2nd ed, 2008) 41, 53"
    assert cited(spark, "newspaper", authors=["Ada Berg"], title="Tide", newspaper="The Shore", date="1 May 2001", url="https://a.b/c") == "Ada Berg, ‘Tide’, *The Shore* (online, 1 May 2001) <https://a.b/c>"
    assert cited(spark, "newspaper", title="Tide", newspaper="The Shore", section="Weekend", place="Harbour", date="1 May 2001", page="3") == "‘Tide’, *Weekend*, *The Shore* (Harbour, 1 May 2001) 3"
    assert cited(spark, "website", [("paragraph", "4", False)], title="About", website_name="River Watch", url="https://a.b") == "‘About’, *River Watch* (Web Page) [4] <https://a.b>"
    assert cited(spark, "parliamentary_debates", [("page", "8939", False)], jurisdiction="Vic", chamber="LA", date="1 May 2001", speaker="Tom Reed", speaker_position="Treasurer") == "Victoria, *Parliamentary Debates*, Legislative Assembly, 1 May 2001, 8939 (Tom Reed, Treasurer)"
    assert cited(spark, "treaty", [("article", "3", False)], title="Rivers Pact", parties=["Utopia", "Erewhon"], signed=True, opened_for_signature="1 May 1999", treaty_series="[1999] ATS 3", entry_into_force="1 May 1999") == "*Rivers Pact*, Utopia–Erewhon, [1999] ATS 3 (signed and entered into force 1 May 1999) art 3"
    assert cited(spark, "un_document", title="On Rivers", resolution="GA Res 61/295", official_records="GAOR", session="61", meeting="107 plen mtg", agenda_items=["68"], supplement="49", document_number="A/RES/61/295", date="2 October 2007", adopted="13 September 2007") == "*On Rivers*, GA Res 61/295, UN GAOR, 61st sess, 107th plen mtg, Agenda Item 68, Supp No 49, UN Doc A/RES/61/295 (2 October 2007, adopted 13 September 2007)"
    assert cited(spark, "legal_encyclopedia", [("paragraph", "235-270", False)], publisher="Lake Press Pty Ltd", title="Laws", volume="vol 12", date="1 May 2001", title_number="235", title_name="Rivers", chapter="1 Flow").startswith("Lake Press, *Laws*, vol 12 (at 1 May 2001) 235 Rivers, ‘1 Flow’")
    assert cited(spark, "speech", as_entry=True, authors=["Ada van der Berg", "Tom Reed"], title="T", lecture="the River Lecture", forum="Hall", date="1 May 2001") == "van der Berg, Ada and Tom Reed, ‘T’ (River Lecture, Hall, 1 May 2001)"
    assert cited(spark, "social_media", username="river", platform="Twitter", date="1 May 2001", time="1:02 pm", time_zone="AEST", url="u") == "@river (Twitter, 1 May 2001, 1:02 pm AEST) <u>"
    assert cited(spark, "dictionary", title="D", entry="river", entry_designation="n1", definition="def 2", retrieved="1 May 2001") == "*D* (online at 1 May 2001) ‘river’ (n1, def 2)"
    assert cited(spark, "committee_evidence", committee="Evidence to River Committee", legislature="P", location="H", date="1 May 2001") == "Evidence to River Committee, P, H, 1 May 2001"


@pytest.mark.parametrize(
    ("pins", "want"),
    [
        ([("page", "121-127", False)], "121–7"), ([("page", "215-219", False), ("page", "5", False)], "215–19, 5"), ([("page", "15", False), ("paragraph", "20", False)], "15 [20]"),
        ([("paragraph", "[45]-[47]", False)], "[45]–[47]"), ([("section", "20-110(1)(a)", False)], "s 20-110(1)(a)"), ([("section", "57-64", True)], "ss 57–64"), ([("volume", "1", False), ("page", "339", False)], "vol 1, 339"),
        ([("page", "[5]", False)], "[5]"), ([("page", "p. 9,", False)], "9"), ([("footnote", "3", False)], "n 3"), ([("part", "3A", False), ("division", "2", False)], "pt 3A div 2"), ([], ""),
    ],
)
def test_pinpoints(spark, pins, want):
    df = source(spark, "other", pins, text="x").withColumn("pinpoints", F.expr(formats.clean_pinpoints(SPARK)))
    assert df.select(F.expr(formats.pinpoints(SPARK))).first()[0] == want


def test_repeated_references(spark):
    def again(kind, pin="", **fields):
        df = source(spark, kind, **fields).withColumns({"pin": F.lit(pin), "first_note": F.lit("3")}).withColumn("short_title", F.expr(formats.short_name(SPARK)))
        return df.select(F.expr(formats.subsequent(SPARK))).first()[0]

    assert again("case", "[5]", name="R v Duarte [No 2]") == "*Duarte* (n 3) [5]" and again("case", name="Reed v Calder") == "*Reed* (n 3)"
    assert again("website", authors=["Ada van der Berg", "Tom Reed"], title="x") == "van der Berg and Reed (n 3)"
    assert again("book", authors=["A B", "C D", "E F", "G H"], title="x") == "*B et al* (n 3)"
    assert again("submission", author="River Watch", body="x") == "River Watch (n 3)"


def test_names_of_cases(spark):
    def both(cited_, title):
        row = names.read(names.read(spark.createDataFrame([(cited_, title)], "cited string, title string"), "cited", "c"), "title", "t")
        row = row.withColumns({"mine": F.expr(names.telling(SPARK, "cited")), "theirs": F.expr(names.telling(SPARK, "title"))})
        return tuple(row.select(F.expr(names.shares_word(SPARK, "mine", "theirs")), F.expr(names.names_each_side(SPARK, "c", "t"))).first())

    full = "Australian Competition & Consumer Commission v George Weston Foods Limited & Anor"
    assert both("ACCC v George Weston Foods Ltd", full) == (True, True)
    assert both("ACCC v Harbour Foods Pty Ltd", full)[1] is True and both("ACCC v Harbour Pty Ltd", full) == (False, False)
    assert both("R v R", "Re an Application")[0] is True
    assert both("Re Colina; Ex parte Torney", "Re Colina and another; ex parte Torney") == (True, True)
    assert both("Kvelde v State of New South Wales", "Kvelde v New South Wales")[1] and not both("Kvelde v Victoria", "Kvelde v New South Wales")[1]
    assert both("Johnson v Reed", "John Holland v Reed") == (True, False)  # sides are matched by whole words
    assert both("Smith v NSW", "Smith v State of New South Wales")[1] and both("New South Wales v Smith", "NSW v Smith")[1]
    assert both("Berg v Aust Bros", "Berg v Australian Brothers Pty Ltd")[1] and both(None, "A v B") == (True, True) and both("Reed v Berg", None)[1] is False


def test_party_match_equals_a_scan(spark):
    """Against every record of the band compared with every claim, on names that share words, letters, both or none."""
    rng = random.Random(7)
    sides = ["Reed", "Calder Pty Ltd", "ACCC", "Australian Competition and Consumer Commission", "Aust Bros", "Australia Brothers", "the Queen", "R", "NSW", "State of New South Wales", "Minister for Rivers", "Minister", "Rivers Harbour Trust", "RHT", "No 7"]
    name = lambda: rng.choice([f"{rng.choice(sides)} v {rng.choice(sides)}", f"Re {rng.choice(sides)}; Ex parte {rng.choice(sides)}", rng.choice(sides)])
    records = [(rng.choice(["HC", "FC"]), rng.choice([2001, 2002, 2003, None]), rng.choice([1, 2, 3, None]), name()) for _ in range(150)] + [(None, 2002, 1, "Reed v Berg"), ("HC", 2002, 1, None)]
    claims = [(i, rng.choice(["HC", "FC"]), rng.choice([2002, 2003, 2004]), name()) for i in range(120)] + [(900, "HC", None, "Reed"), (901, None, 2002, "Reed"), (902, "HC", 2002, None), (903, "HC", 2002, "R v R"), (904, "HC", 2002, "")]
    left = spark.createDataFrame(claims, "claim int, court string, year int, name string")
    right = spark.createDataFrame(records, "court string, year int, number int, title string")
    got = {r[0]: tuple(r[1:]) for r in names.party_match(left, right, "claim").collect()}
    compared = names.read(left.withColumnRenamed("court", "c"), "name", "c").crossJoin(names.read(right.withColumnsRenamed({"year": "y"}), "title", "t"))
    pairs = compared.where("c = court AND coalesce(y BETWEEN year - 1 AND year, year IS NOT NULL) AND size(c_sides) > 0").where(names.names_each_side(SPARK, "c", "t"))
    last = lambda m: (m[0] is None, m[0] or 0, m[1] is None, m[1] or 0, m[2])
    want = {}
    for r in pairs.select("claim", "y", "number", "title").collect():
        want[r[0]] = min(want.get(r[0], tuple(r[1:])), tuple(r[1:]), key=last)
    assert got == want and 30 < len(want) < 125
    assert names.party_match(left, right.limit(0), "claim").count() == 0 and names.party_match(left.limit(0), right, "claim").count() == 0


def test_grounding(spark):
    def of(original, made_):
        row = spark.createDataFrame([(original, made_)], "o string, m string").select(F.expr(grounding.missing(SPARK, "o", "m")), F.expr(grounding.invented(SPARK, "o", "m"))).first()
        return row[0], row[1]

    assert of("See N.S.W. O’Donovan, 150–5 at 007", "NSW o'donovan 155 7") == (["150", "5"], [])
    assert of("Web Page of the Rivers", "webpage rivers") == ([], []) and of("webpage", "Web Page") == ([], [])
    assert of("(1993) 12 HLR 5", "HLR 5, 1994") == (["1993", "12"], ["1994"])
    assert of(None, None) == ([], [])
    assert of("net work net", "network") == ([], []) and of("net work a net", "worknet") == (["net", "work"], []) and of("007 08", "7") == (["08"], [])
    long = " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'efghijklmn'[i // 1000]}" for i in range(10000))
    assert of(long, long) == ([], []) and of(long, "")[0] == long.split()  # long texts, all or nothing kept


def test_kinds_of_changes(spark):
    kinds = lambda b, a: spark.createDataFrame([(b, a)], "b string, a string").select(F.expr(explain.kinds(SPARK, "b", "a"))).first()[0]
    assert kinds("ibid 5", "Ibid 5.") == ["ibid", "full_stop"] and kinds("x", "x") == [] and kinds(None, "") == []
    assert kinds("Reed v Calder, above n 3 at p. 5", "*Reed* (n 3) 5.") == ["n_reference", "italic", "pinpoint_label", "full_stop"]
    assert kinds("*see* Reed (No 2)  12-15.", "see *Reed [No 2]* 12–15.") == ["roman", "case_number", "span", "spaces"]
    assert kinds("a", "b") == ["other"]
    fixed = lambda x: spark.createDataFrame([(x,)], "x string").select(F.expr(explain.fixed_body(SPARK, "x"))).first()[0]
    assert fixed("under s 57-64 , and s 5A") == "under ss 57–64, and s 5A"


def test_json_lines(spark, tmp_path):
    lines = ['{"type": "decision", "citation": "Reed v Calder [2001] HbC 5", "text": "long"}', "", "no json", '{"type": "act", "citation": "x"}', '{"type": "decision"}', '{"type": "decision", "citation": "A v B [2002] HbC 7 "}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    path = f"file://{tmp_path}/a.jsonl"
    assert sorted(map(tuple, jsonl.decisions(spark, path).collect())) == [("HbC", 2001, 5, "Reed v Calder"), ("HbC", 2002, 7, "A v B")]
    records = jsonl.read_records(spark, path, {"type": "string"}).cache()
    assert [(r.n, r.example) for r in jsonl.bad_lines(records).collect()] == [(1, "no json")] and jsonl.good_records(records).count() == 4


def test_sinks(spark, tmp_path):
    rows = [(1, "case", "*Reed v Calder* (2001) 5 HLR 1"), (1, "book", "Berg, Ada, *On Rivers*"), (1, "book", "Berg, Ada, *On Rivers*"), (1, "speech", "‘A’"), (1, "book", "Adams, Zoe"), (2, "other", "")]
    df = spark.createDataFrame(rows, "doc int, type string, entry string")
    got = sorted((r.section, r.ord, r.entry) for r in sinks.bibliography(df).collect())
    assert got == [("A Articles/Books/Reports", 0, "Adams, Zoe"), ("A Articles/Books/Reports", 1, "Berg, Ada, *On Rivers*"), ("B Cases", 0, rows[0][2]), ("E Other", 0, "‘A’")]
    sinks.write_bibliography(df, f"file://{tmp_path}/b")
    text = spark.read.text(f"file://{tmp_path}/b", wholetext=True).first().value
    assert text.startswith("A Articles/Books/Reports\nAdams, Zoe\nBerg, Ada, *On Rivers*\n\nB Cases\n")
    sinks.write_report(df, f"file://{tmp_path}/r")
    assert spark.read.json(f"file://{tmp_path}/r").count() == 6


def test_sources_and_pinpoints(spark):
    def fixed(of_type, *columns, pins=(), **fields):
        df = source(spark, of_type, pins, **fields)
        for step in normalise.citation_steps(SPARK, of_type):
            df = df.withColumns({f: F.expr(x) for f, x in step.items()})
        row = df.select("pinpoints", *columns).first()
        return ([(p.kind, p.value) for p in row[0]], *row[1:])

    assert fixed("book_chapter", "starting_page", pins=[("page", "38", False)], chapter_title="x") == ([], "38")
    assert fixed("book_chapter", "starting_page", pins=[("page", "38–40", False)], chapter_title="x") == ([("page", "38–40")], None)
    assert fixed("parliamentary_debates", "speaker", "speaker_position", "judges", judges="Mr Reed, Treasurer") == ([], "Reed", "Treasurer", None)
    assert fixed("committee_evidence", "speaker", pins=[("page", "SL&C 12", False)], speaker="Ada Berg", judges="x") == ([("page", "12")], "Ada Berg")
    assert fixed("dictionary", "definition", pins=[("other", "(def 4)", False), ("page", "3", False)], title="D") == ([("page", "3")], "4")
    assert fixed("legal_encyclopedia", "volume", pins=[("volume", "12", False), ("page", "5", False)], title="L") == ([("paragraph", "5")], "12")


@pytest.mark.parametrize(
    ("written", "name"),
    [
        ("Regina v Smith", "R v Smith"),
        ("Rex v. Doe", "R v Doe"),
        ("Smith v Regina", "Smith v The Queen"),
        ("Smith V The king", "Smith v The King"),
        ("King v King", "King v King"),
        ("Regina", "Regina"),
        ("Smith v Jones No 2", "Smith v Jones [No 2]"),
        ("Smith v Jones (No. 2)", "Smith v Jones [No 2]"),
        ("Smith v Jones [no 3 and 4]", "Smith v Jones [No 3 and 4]"),
        ("Reed VS Calder pty. ltd.", "Reed v Calder pty ltd"),
        ("*‘Re  Wakim’*", "Re Wakim"),
        ("Casino 2 v Reed", "Casino 2 v Reed"),
        ("St. Ives v Reed", "St. Ives v Reed"),
    ],
)
def test_names_of_cases(spark, written, name):
    df = spark.createDataFrame([(written,)], "name string")
    for step in normalise.case_name_steps(SPARK):
        df = df.withColumns({k: F.expr(v) for k, v in step.items()})
    assert df.first().name == name


@pytest.mark.parametrize(
    ("value", "text"),
    [("20, 30-35", "20, 30–5"), ("5, 121-127", "5, 121–7"), ("312-313", "312–13"), ("215-219, 436-462", "215–19, 436–62"), ("1234567-1234589", "1234567–89"), ("99-101", "99–101"), ("35-30", "35–30"), ("1.5-1.9", "1.5–1.9"), ("10-20 and 30-31", "10–20 and 30–1")],
)
def test_lists_of_spans(spark, value, text):
    df = source(spark, "book", [("page", value, False)]).withColumn("pinpoints", F.expr(formats.clean_pinpoints(SPARK)))
    assert df.select(F.expr(formats.pinpoints(SPARK))).first()[0] == text


@pytest.mark.parametrize(
    ("written", "name"),
    [("Ms Ada Berg, LLB, PhD", "Ada Berg"), ("Ada Berg O.A.M.", "Ada Berg"), ("Hon Ada Berg", "Hon Ada Berg"), ("Hon. Ada Berg", "Ada Berg"), ("The Hon Ada Berg AC QC", "Ada Berg"), ("Prof Berg", "Prof Berg"), ("Ada BA", "Ada BA"), ("Justice KM Hayne", "Justice KM Hayne"), ("Ada Berg Ph.D.", "Ada Berg")],
)
def test_persons(spark, written, name):
    assert made(spark, "book", "authors", authors=[written]) == [name]
