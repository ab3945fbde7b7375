"""Queries over sources of all types, written in many ways: put in one form, keyed, rendered, and referred to again.

The rows are orders; their keys choose how each field is written. The expressions of the fields are SQL that both engines read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.dialect import DUCK, SPARK, Spark
from marginalia.operators import explain, formats, normalise
from marginalia.sources import sinks
from marginalia.sources.tables import table
from marginalia.workspace import written

_K = "o_orderkey"


def _pick(by: int, *values: str) -> str:
    """One of some values by the key."""
    return f"CASE ({_K} // {by}) % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _texts(by: int, *values: str | None) -> str:
    return _pick(by, *("NULL" if v is None else f"'{v}'" for v in values))


_N = "CAST(o_custkey AS STRING)"
_YEAR = "CAST(1950 + o_custkey % 70 AS STRING)"
_DATE = _texts(2, "3rd March 2022", " 21st  May 1999.", "1 June 2001", None, "22nd of July 2010,")
_PLACE = _texts(3, "Cth", "new south wales", "Vic.", None, "N.S.W.", "Utopia")
_PERSON = _texts(1, "Professor Mira Calder AO", " Dr  Tom  Reed, ", "Ada van der Berg", "Harbour Trust", "The Hon Ines Duarte KC", "Professor Okoro")
_SPEAKER = _texts(1, "Senator the Hon Mira Calder QC", "Sir Tom Reed", "Ms Ada Berg, MP", None, "Mr Reed")
_URL = _texts(5, None, " https://example.com/a ")
_TITLE = f"{_texts(4, chr(8216) + 'On Rivers' + chr(8217), ' On  Lakes ', 'On Seas:')} || ' ' || {_N}"
_AUTHORS = (_PERSON, f"'Second Author' || {_N}", "'Third Person et al'", "'Fourth'")


def _list(d: Spark, items: tuple[str, ...]) -> str:
    """None to all of the items."""
    return f"CASE {_K} % {len(items) + 1} " + " ".join(f"WHEN {n} THEN {d.array(items[:n])}" for n in range(1, len(items) + 1)) + " END"


def _fields(d: Spark, kind: str) -> dict[str, str]:
    """The fields of a type as they are written."""
    people = {"authors": _list(d, _AUTHORS), "bodies": _pick(6, "NULL", "true", "false"), "et_al": _pick(7, "NULL", "true", "false")}
    editors = {"editors": _list(d, ("'Ed One'", "' Prof Ed Two'")), "translators": _list(d, ("'Tr One'",)), "publisher": _texts(3, "Lawbook Co.", "Harbour Press Pty Ltd", None, " Federation Press,"), "edition": _texts(2, "2", "3rd", None, "rev", "11"), "year": _YEAR}
    online = {"online": _pick(4, "NULL", "true", "false"), "retrieved": _texts(3, None, "online at 3rd May 2020", "last accessed 1 June 2021.")}
    own = {
        "case": {"name": _texts(4, "Reed v. Calder Pty. Ltd", " *R vs Duarte (No 2)* ", "Ex parte Berg"), "year": _YEAR, "volume": _texts(2, " 12 ", None, "7."), "report": _texts(1, "NATION_3", None, "n.a.t.i.o.n_4", "ZZR", None), "starting_page": _N, "court_id": _texts(1, None, "REGION_1", "Region_2", None, "NATION_5"), "judgment_number": _N, "judges": "' Reed J. '"},
        "legislation": {"title": _texts(1, "Rivers Act 1993", " Lakes Act ", "Constitution", "Commonwealth Constitution", "Seas Act 2001 "), "year": _pick(2, "NULL", _YEAR, "''"), "jurisdiction": _PLACE, "kind": "'act'"},
        "journal_article": people | {"title": _TITLE, "journal": "' Journal of Rivers '", "year": _YEAR, "volume": "' 4. '", "issue": _texts(2, "2", None), "starting_page": _N},
        "book": people | editors | {"title": _TITLE, "volume": _texts(3, None, "2")},
        "book_chapter": people | editors | {"chapter_title": _TITLE, "book_title": "' Book of Rivers '", "starting_page": _pick(5, "NULL", _N)},
        "report": {"author": _PERSON, "bodies": _pick(2, "NULL", "true"), "title": _texts(1, "Review of Rivers: Final Report", "Lakes — annual report", "Seas"), "document_type": _texts(2, None, "Report", "Inquiry"), "document_number": _texts(3, None, "12."), "date": _DATE},
        "research_paper": people | {"title": _TITLE, "document_type": _texts(2, "Working Paper", None), "document_number": _texts(3, "12.", None), "institution": _texts(1, "Harbour Trust", None, "River Institute,"), "date": _DATE, "url": _URL},
        "explanatory_memorandum": {"title": "' Rivers Bill 2009 '", "year": _pick(2, "NULL", _YEAR), "document_type": _texts(3, None, "Explanatory Statement"), "jurisdiction": _PLACE},
        "parliamentary_debates": {"jurisdiction": _PLACE, "chamber": _texts(1, "HoR", "senate", "L.C.", None, "Grand Council"), "date": _DATE, "speaker": _SPEAKER, "speaker_position": _texts(2, None, "Treasurer")},
        "submission": {"author": _texts(1, "Anonymous", "Dr Mira Calder AM", "River Watch", None), "bodies": _pick(2, "NULL", "true", "false"), "submission_number": _texts(3, "Submission No. 119", "no 7", "12", None), "body": _texts(2, "to the Senate Committee", None, "Royal Commission into Rivers"), "legislature": _texts(1, None, "Parliament of Utopia"), "inquiry": _texts(1, "Inquiry into Lakes", "The Royal Commission into Seas", None), "date": _DATE},
        "committee_evidence": {"committee": _texts(1, "Evidence to River Committee", "Lake Committee", None), "legislature": _texts(2, "Parliament of Utopia", None), "location": "'Harbour'", "date": _DATE, "speaker": _SPEAKER, "speaker_position": _texts(3, None, "Treasurer")},
        "convention_debates": {"title": _texts(1, " Debates of the Convention.", ".", "Convention"), "location": "'Harbour, '", "date": _DATE, "speaker": _SPEAKER},
        "speech": people | {"title": _TITLE, "lecture": _texts(1, "the 27th River Lecture", "Keynote address", None, "Annual Lake Oration", "Speech delivered at"), "forum": _texts(2, "Harbour Hall", None), "date": _DATE, "url": _URL},
        "media_release": people | {"title": _TITLE, "release_type": _texts(2, None, "Press Release"), "document_number": _texts(3, "No. 5", "NO 12/3", None), "body": _texts(1, "harbour trust", "River Watch", None), "date": _DATE, "url": _URL},
        "dictionary": online | {"title": _TITLE, "edition": _texts(2, "5th edn", "6", None, "2nd ed.", "rev"), "year": _YEAR, "entry": f"'“river' || {_N} || '”'", "entry_designation": _texts(5, None, "n1"), "definition": _texts(1, "def 4", "Definition. 2", None, "sense b")},
        "legal_encyclopedia": online | {"publisher": _texts(2, "Lake Press Ltd", None, "Harbour"), "title": _TITLE, "volume": _texts(3, "vol. 12", "Volume 3", None), "date": _DATE, "title_number": _texts(1, "235", None), "title_name": _texts(2, "Rivers", None), "chapter": _texts(4, "1 ‘Flow’", None)},
        "social_media": {"username": _texts(1, "river", "@lake", "Two Words"), "author_name": _texts(2, None, "Mira"), "title": _TITLE, "platform": _texts(3, "twitter", "You Tube", None, "Faces"), "date": _DATE, "time": _texts(2, None, "1:02 pm"), "time_zone": _texts(3, None, "AEST"), "url": _URL, "archived_url": _URL},
        "newspaper": people | {"title": _TITLE, "newspaper": "' The Tide '", "section": _texts(2, None, "Weekend"), "periodical": _pick(3, "NULL", "true"), "place": _texts(4, "Harbour", None), "date": _DATE, "page": _texts(2, None, " 3. "), "url": _URL, "archived_url": _URL},
        "website": people | {"title": _TITLE, "website_name": _texts(2, None, " River Watch. "), "document_type": _texts(3, None, "Blog Post"), "date": _DATE, "url": _URL, "archived_url": _URL},
        "treaty": {"title": _TITLE, "parties": _list(d, ("' Utopia,'", "'Erewhon'")), "opened_for_signature": _DATE, "signed": _pick(3, "NULL", "true", "false"), "treaty_series": _texts(1, "999 U.N.T.S. 171", "[1998] ATS 3", None), "entry_into_force": _texts(2, "1 June 2001", "not yet in force", None)},
        "un_document": {"author": _texts(1, None, "River Committee,"), "title": _texts(2, None, "‘On Rivers’"), "resolution": _texts(1, "General Assembly Resolution 61/295", "S.C. Res. 1325", "ECOSOC Dec no 2001/3", None, "Plain 5"), "official_records": _texts(2, "UN GAOR", "General Assembly Official Records", "other", None), "committee": _texts(3, "Third Committee", None, "6th Comm"), "session": _texts(1, "54th sess", "61", None), "session_part": _texts(4, None, "2nd part"), "meeting": _texts(2, "93rd plen mtg", "5th mtg", None), "agenda_items": _list(d, ("'Agenda Items 42, 88 and 166'", "'item'")), "supplement": _texts(3, "Supp No 49", None), "document_number": _texts(1, "UN Doc A/RES/61/295", "U.N. Docs A/63/804 and Corr.1", None), "date": _DATE, "adopted": _texts(2, None, "adopted on 3rd May 2007")},
        "other": {"text": f"'  Plain text ' || {_N} || ' '"},
    }
    return own[kind]


_PINS = {"kind": ("page", "paragraph", "section", "volume", "page", "footnote", "other"), "value": ("121-127", "[45]-[47]", "20-110(1)", "1", "215-19", "5", "cl 3")}


def _raw(d: Spark, kind: str) -> dict[str, str]:
    """Every field of the table of sources; null what the type has not."""
    integer = "//" if d is DUCK else "DIV"
    fields = {f: x.replace(" // ", f" {integer} ") for f, x in _fields(d, kind).items()}
    kinds = dict.fromkeys(normalise.TEXTS, "STRING") | dict.fromkeys(normalise.ARRAYS, "VARCHAR[]" if d is DUCK else "ARRAY<STRING>") | dict.fromkeys(normalise.FLAGS, "BOOLEAN")
    out = {"type": f"'{kind}'"} | {f: f"CAST({fields.get(f, 'NULL')} AS {kinds[f]})" for f in normalise.FIELDS}
    struct = (lambda k, v, p: f"struct_pack(kind := {k}, value := {v}, plural := {p})") if d is DUCK else (lambda k, v, p: f"named_struct('kind', {k}, 'value', {v}, 'plural', {p})")
    some = lambda by, values: _texts(by, *values).replace(" // ", f" {integer} ")
    one, two = (struct(some(by, _PINS["kind"]), f"CASE WHEN {_K} % 11 = 0 THEN 'p. ' ELSE '' END || {some(by, _PINS['value'])}", f"{_K} % 3 = 0") for by in (1, 2))
    out["pinpoints"] = f"CASE WHEN {_K} % 4 = 0 THEN {d.array([one])} WHEN {_K} % 4 = 1 THEN {d.array([one, two])} END"
    return out


def sources(spark: SparkSession, sf_dir: str, kind: str, rows: DataFrame | None = None) -> DataFrame:
    """rows: the orders with columns of their own, which stay as they are; else the table. With the customer of each, so that nothing is joined for it."""
    rows = table(spark, sf_dir, "orders").select(_K, "o_custkey") if rows is None else rows
    return rows.select(*rows.columns, *[F.expr(x).alias(f) for f, x in _raw(SPARK, kind).items() if f not in rows.columns])


def _pinned(spark: SparkSession, sf_dir: str, steps: list[dict[str, str]], *keep: str) -> DataFrame:
    """The orders with what `steps` make of their pinpoints. These are the same for sources of all types, so they are made once and written."""
    rows = table(spark, sf_dir, "orders").select(_K, "o_custkey", F.expr(_raw(SPARK, "other")["pinpoints"]).alias("pinpoints"))
    for step in steps:
        rows = rows.withColumns({f: F.expr(x) for f, x in step.items()})
    return written(rows.select(_K, "o_custkey", *keep), "pins")


def _dimensions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    series = nation.select(F.col("n_name").alias("variant"), F.expr("'N' || n_nationkey || 'R'").alias("abbreviation"), F.expr("CASE WHEN n_nationkey % 2 = 0 THEN 'round' ELSE 'square' END").alias("style"), F.expr("1960 + n_nationkey").alias("square_before"))
    return series, region.select(F.col("r_name").alias("variant"), F.expr("'R' || r_regionkey || 'C'").alias("abbreviation"))


def normalised(spark: SparkSession, sf_dir: str, kind: str, rows: DataFrame | None = None) -> DataFrame:
    rows = sources(spark, sf_dir, kind, rows)
    if kind == "case":
        rows = normalise.with_dimensions(rows, *_dimensions(spark, sf_dir))
    return normalise.normalise(rows, kind)


def _shown(d: Spark, f: str) -> str:
    return f"{d.join(f, '|')} AS {f}" if f in normalise.ARRAYS else f


def _normal_query(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = normalise.keyed(normalised(spark, sf_dir, kind))
        return rows.selectExpr(_K, "source_key", *[_shown(SPARK, f) for f in normalise.fields_of(kind)])

    query.__doc__ = f"Sources of the type {kind} in one form, with the key of each."
    return query


def _with_pins(d: Spark) -> list[dict[str, str]]:
    return [{"pinpoints": formats.clean_pinpoints(d)}, {"pin": formats.pinpoints(d)}]


def _format_query(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = normalised(spark, sf_dir, kind)
        for step in _with_pins(SPARK):
            rows = rows.withColumns({f: F.expr(x) for f, x in step.items()})
        rows = rows.withColumn("cited", F.expr(formats.RULES[kind](SPARK, False))).withColumn("pin", F.lit(""))
        return rows.select(_K, "cited", F.expr(formats.RULES[kind](SPARK, True)).alias("entry"))

    query.__doc__ = f"Citations of the type {kind} in full and as bibliography entries."
    return query


#: Types whose names differ in how a repeated reference is made.
_AGAIN = ("case", "book", "report", "social_media", "submission", "treaty", "un_document", "website")


def subsequent_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated references to sources of several types by their default short names."""
    out, pinned = None, _pinned(spark, sf_dir, _with_pins(SPARK), "pin")
    for kind in _AGAIN:
        rows = normalised(spark, sf_dir, kind, pinned)
        for step in ({"short_title": formats.short_name(SPARK), "first_note": f"CAST({_K} % 90 + 1 AS STRING)"},):
            rows = rows.withColumns({f: F.expr(x) for f, x in step.items()})
        made = rows.select(_K, "type", F.expr(formats.subsequent(SPARK)).alias("reference"))
        out = made if out is None else out.unionByName(made)
    return out


_BEFORE = "CASE p_partkey % 7 WHEN 0 THEN 'see  ' || p_name || ' at p. ' || p_size WHEN 1 THEN 'ibid ' || p_size WHEN 2 THEN '*' || p_name || '* above n 3' WHEN 3 THEN p_name || ' (No 2) (1993) 12 N.S.W.L.R. 5, 20-25, per Reed J' WHEN 4 THEN p_name || ', \"' || p_type || '\" s 57-64.' WHEN 5 THEN p_name || '.' ELSE p_name || ' , s ' || p_size || ' - 70' END"
_AFTER = "CASE p_partkey % 7 WHEN 0 THEN 'See *' || p_name || '* ' || p_size || '.' WHEN 1 THEN 'Ibid ' || p_size || '.' WHEN 2 THEN p_name || ' (n 3).' WHEN 3 THEN '*' || p_name || ' [No 2]* (1993) 12 NSWLR 5, 20–5 (Reed J) (‘' || p_name || '’).' WHEN 4 THEN p_name || ', ‘' || p_type || '’ ss 57–64.' WHEN 5 THEN p_name || '.' ELSE p_name || '’s' END"


def change_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of changes between notes as written and as formatted, with running text put right and checked."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_BEFORE).alias("b"), F.expr(_AFTER).alias("a"))
    return rows.selectExpr("p_partkey", f"{SPARK.join(explain.kinds(SPARK, 'b', 'a'), ',')} AS kinds", f"{explain.fixed_body(SPARK, 'b')} AS body", f"{explain.possessives(SPARK, 'a')} AS possessives", f"{explain.missing_stop(SPARK, 'b')} AS missing_stop")


def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliography entries of each customer's sources by section, in order."""
    out = None
    for kind in ("newspaper", "treaty", "explanatory_memorandum", "submission"):
        rows = normalised(spark, sf_dir, kind).withColumn("pin", F.lit(""))
        made = rows.select(F.col("o_custkey").alias("doc"), "type", F.expr(formats.RULES[kind](SPARK, True)).alias("entry"))
        out = made if out is None else out.unionByName(made)
    return sinks.bibliography(out)


_FIXED = ("book_chapter", "parliamentary_debates", "committee_evidence", "convention_debates", "dictionary", "legal_encyclopedia")
_FIXED_FIELDS = ("starting_page", "speaker", "speaker_position", "judges", "definition", "volume")


_JUDGES = {"judges": f"CASE WHEN {_K} % 3 = 0 THEN ' Ms Ada Berg, Treasurer' END"}


def _fixed_pins(d: Spark) -> list[dict[str, str]]:
    pins = d.rename("pinpoints", {"kind": "x.kind", "value": f"CASE WHEN {_K} % 7 = 0 THEN '(def 4)' WHEN {_K} % 5 = 0 THEN 'SL&C 12' ELSE x.value END", "plural": "x.plural"})
    return [{"pinpoints": pins}, {"pinpoints": formats.clean_pinpoints(d)}]


def _citation_steps(d: Spark, kind: str) -> list[dict[str, str]]:
    first, *more = _fixed_pins(d)
    return [_JUDGES | first, *more, *normalise.citation_steps(d, kind)]


def _pins_shown(d: Spark) -> str:
    return d.join(d.each("pinpoints", lambda x: f"{x}.kind || ' ' || {x}.value"), "|")


def citation_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sources and their pinpoints owe each other, by type."""
    out, pinned = None, _pinned(spark, sf_dir, _fixed_pins(SPARK), "pinpoints")
    for kind in _FIXED:
        rows = normalised(spark, sf_dir, kind, pinned)
        for step in (_JUDGES, *normalise.citation_steps(SPARK, kind)):
            rows = rows.withColumns({f: F.expr(x) for f, x in step.items()})
        made = rows.select(_K, "type", *_FIXED_FIELDS, F.expr(_pins_shown(SPARK)).alias("pins"))
        out = made if out is None else out.unionByName(made)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"normalise_{k}": _normal_query(k) for k in normalise.RULES}
QUERIES |= {f"format_{k}": _format_query(k) for k in formats.RULES}
QUERIES |= {"subsequent_references": subsequent_references, "change_kinds": change_kinds, "bibliography": bibliography, "citation_fixes": citation_fixes}


# ---- the same in DuckDB


def _sql_normalised(kind: str) -> str:
    raw = ", ".join(f"{x} AS {f}" for f, x in _raw(DUCK, kind).items())
    out = f"WITH s0 AS (SELECT {_K}, {raw} FROM orders)"
    last = "s0"
    if kind == "case":
        key = lambda x: normalise.norm_key(DUCK, x)
        out += f""", series AS (SELECT {key('n_name')} AS k, 'N' || n_nationkey || 'R' AS abbreviation, CASE WHEN n_nationkey % 2 = 0 THEN 'round' ELSE 'square' END AS style, 1960 + n_nationkey AS square_before FROM nation),
 courts AS (SELECT {key('r_name')} AS k, 'R' || r_regionkey || 'C' AS abbreviation FROM region),
 dims AS (SELECT s0.*, a.abbreviation AS matched_report, b.abbreviation AS court_report, c.abbreviation AS matched_court,
  CASE WHEN coalesce(report, '') = '' AND c.abbreviation IS NULL THEN b.style ELSE a.style END AS report_style, CASE WHEN coalesce(report, '') = '' AND c.abbreviation IS NULL THEN b.square_before ELSE a.square_before END AS square_before
  FROM s0 LEFT JOIN series a ON a.k = {key('report')} LEFT JOIN series b ON b.k = {key('court_id')} LEFT JOIN courts c ON c.k = {key('court_id')})"""
        last = "dims"
    return _sql_steps(out, last, normalise.RULES[kind](DUCK), "n")[0]


def _sql_steps(with_: str, last: str, steps: list[dict[str, str]], name: str, columns: frozenset[str] = frozenset()) -> tuple[str, str]:
    known = set(normalise.FIELDS) | {"pinpoints", "type"} | columns
    for i, step in enumerate(steps):
        replaced = ", ".join(f"({x}) AS {f}" for f, x in step.items() if f in known)
        added = "".join(f", ({x}) AS {f}" for f, x in step.items() if f not in known)
        with_ += f",\n {name}{i} AS (SELECT *{f' REPLACE ({replaced})' if replaced else ''}{added} FROM {last})"
        known |= set(step)
        last = f"{name}{i}"
    return with_, last


def _last(kind: str) -> str:
    return f"n{len(normalise.RULES[kind](DUCK)) - 1}"


def _sql_normal(kind: str) -> str:
    shown = ", ".join(_shown(DUCK, f) for f in normalise.fields_of(kind))
    return f"{_sql_normalised(kind)}\nSELECT {_K}, {normalise.source_key(DUCK)} AS source_key, {shown} FROM {_last(kind)}"


def _sql_format(kind: str) -> str:
    with_, last = _sql_steps(_sql_normalised(kind), _last(kind), _with_pins(DUCK), "p")
    with_ += f",\n c AS (SELECT *, {formats.RULES[kind](DUCK, False)} AS cited FROM {last}), e AS (SELECT * REPLACE ('' AS pin) FROM c)"
    return f"{with_}\nSELECT {_K}, cited, {formats.RULES[kind](DUCK, True)} AS entry FROM e"


def _sql_again(kind: str) -> str:
    steps = [*_with_pins(DUCK), {"short_title": formats.short_name(DUCK), "first_note": f"CAST({_K} % 90 + 1 AS STRING)"}]
    with_, last = _sql_steps(_sql_normalised(kind), _last(kind), steps, "p")
    return f"SELECT * FROM ({with_}\nSELECT {_K}, type, {formats.subsequent(DUCK)} AS reference FROM {last})"


ORACLE_SQL: dict[str, str] = {f"normalise_{k}": _sql_normal(k) for k in normalise.RULES}
ORACLE_SQL |= {f"format_{k}": _sql_format(k) for k in formats.RULES}
ORACLE_SQL["subsequent_references"] = " UNION ALL ".join(_sql_again(k) for k in _AGAIN)
ORACLE_SQL["change_kinds"] = f"SELECT p_partkey, {DUCK.join(explain.kinds(DUCK, 'b', 'a'), ',')} AS kinds, {explain.fixed_body(DUCK, 'b')} AS body, {explain.possessives(DUCK, 'a')} AS possessives, {explain.missing_stop(DUCK, 'b')} AS missing_stop FROM (SELECT p_partkey, {_BEFORE} AS b, {_AFTER} AS a FROM part)"


def _sql_entries(kind: str) -> str:
    return f"SELECT * FROM ({_sql_normalised(kind)}, e AS (SELECT n.*, o.o_custkey AS doc, '' AS pin FROM {_last(kind)} n JOIN orders o USING ({_K}))\nSELECT doc, type, {formats.RULES[kind](DUCK, True)} AS entry FROM e)"


_ENTRIES = " UNION ALL ".join(_sql_entries(k) for k in ("newspaper", "treaty", "explanatory_memorandum", "submission"))
ORACLE_SQL["bibliography"] = f"""WITH every AS ({_ENTRIES}), once AS (SELECT DISTINCT doc, CASE WHEN type = 'newspaper' THEN 'A Articles/Books/Reports' WHEN type = 'treaty' THEN 'D Treaties' WHEN type = 'explanatory_memorandum' THEN 'C Legislation' ELSE 'E Other' END AS section,
 lower(regexp_replace(entry, '^[''‘*]+', '')) AS key, entry FROM every WHERE length(entry) > 0)
SELECT doc, section, (row_number() OVER (PARTITION BY doc, section ORDER BY key, entry) - 1)::INT AS ord, entry FROM once"""


def _sql_fixed(kind: str) -> str:
    with_, last = _sql_steps(_sql_normalised(kind), _last(kind), _citation_steps(DUCK, kind), "f")
    return f"SELECT * FROM ({with_}\nSELECT {_K}, type, {', '.join(_FIXED_FIELDS)}, {_pins_shown(DUCK)} AS pins FROM {last})"


ORACLE_SQL["citation_fixes"] = " UNION ALL ".join(_sql_fixed(k) for k in _FIXED)
