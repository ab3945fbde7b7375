"""Citations as text, italics between asterisks: one column expression that chooses by source type.

Columns of a citation: type, name or title, authors (array), year, year_style (round, square), volume, issue, report,
starting_page, court_id, judgment_number, jurisdiction, kind, journal, publisher, edition, document_type, number,
forum, date and pinpoint. What a type needs and lacks is written as [MISSING: field].
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import ordinal


def missing(field: str) -> Column:
    return F.lit(f"[MISSING: {field}]")


def needed(field: str) -> Column:
    return F.coalesce(F.nullif(F.col(field), F.lit("")), missing(field))


def italic(value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit("*"), value, F.lit("*"))).otherwise("")


def quoted(value: Column) -> Column:
    return F.concat(F.lit("‘"), value, F.lit("’"))


def optional(before: str, value: Column, after: str = "") -> Column:
    """The value with what goes around it, or '' without one."""
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.concat(F.lit(before), value, F.lit(after)))


def invert(name: Column) -> Column:
    """Family name first, for a bibliography; one-word names stay."""
    words = F.split(name, " ")
    return F.when(F.size(words) < 2, name).otherwise(F.concat(F.element_at(words, -1), F.lit(", "), F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), " ")))


def names(people: Column, invert_first: bool = False) -> Column:
    """A; A and B; A, B and C; A et al for more than three."""
    if invert_first:
        people = F.transform(people, lambda p, i: F.when(i == 0, invert(p)).otherwise(p))
    n = F.size(people)
    first = F.element_at(people, 1)
    joined = F.concat(F.array_join(F.slice(people, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(people, -1))
    return F.when(people.isNull() | (n < 1), missing("authors")).when(n == 1, first).when(n <= 3, joined).otherwise(F.concat(first, F.lit(" et al")))


def year(default: str = "round") -> Column:
    y = needed("year")
    style = F.coalesce(F.col("year_style"), F.lit(default))
    return F.when(style == "square", F.concat(F.lit("["), y, F.lit("]"))).otherwise(F.concat(F.lit("("), y, F.lit(")")))


def case(bibliography: bool = False) -> Column:
    reported = F.concat(F.lit(" "), year(), optional(" ", F.col("volume")), F.lit(" "), F.col("report"), F.lit(" "), needed("starting_page"))
    neutral = F.concat(F.lit(" ["), needed("year"), F.lit("] "), F.col("court_id"), F.lit(" "), needed("judgment_number"))
    place = F.when(F.coalesce("report", F.lit("")) != "", reported).when(F.coalesce("court_id", F.lit("")) != "", neutral).otherwise(F.concat(F.lit(" "), missing("case citation (report or court details)")))
    return F.concat(italic(F.coalesce("name", F.lit(""))), place, F.lit("") if bibliography else optional(", ", F.col("pinpoint")))


def legislation(bibliography: bool = False) -> Column:
    title = needed("title")
    bill = F.concat(title, F.lit(" "), needed("year"))
    alone = (F.col("kind") == "constitution") & (F.coalesce("year", F.lit("")) == "")
    dated = italic(F.concat(title, F.lit(" "), needed("year")))
    head = F.when(F.col("kind") == "bill", bill).when(alone, italic(title)).otherwise(dated)
    where = F.when(alone, "").when(F.coalesce("jurisdiction", F.lit("")) != "", F.concat(F.lit(" ("), F.col("jurisdiction"), F.lit(")"))).otherwise(F.concat(F.lit(" "), missing("jurisdiction")))
    return F.concat(head, where, F.lit("") if bibliography else optional(" ", F.col("pinpoint")))


def journal_article(bibliography: bool = False) -> Column:
    issue = F.when(F.coalesce("issue", F.lit("")) == "", "").when(F.col("issue").rlike("^[0-9]"), F.concat(F.lit("("), F.col("issue"), F.lit(")"))).otherwise(F.concat(F.lit(" "), F.col("issue")))
    has_volume = F.coalesce("volume", F.lit("")) != ""
    number = F.when(has_volume, F.concat(F.lit("("), needed("year"), F.lit(") "), F.col("volume"), issue)).otherwise(F.concat(F.lit("["), needed("year"), F.lit("]"), issue))
    pin = F.lit("") if bibliography else optional(", ", F.col("pinpoint"))
    return F.concat(names(F.col("authors"), bibliography), F.lit(", "), quoted(needed("title")), F.lit(" "), number, F.lit(" "), italic(needed("journal")), F.lit(" "), needed("starting_page"), pin)


def edition(value: Column) -> Column:
    """2 gives 2nd ed; rev gives rev ed; the first edition is written too if it was given."""
    number = F.try_to_number(F.regexp_extract(value, "^([0-9]{1,6})", 1), F.lit("999999")).cast("int")
    return F.when(number.isNull(), F.concat(value, F.lit(" ed"))).otherwise(F.concat(ordinal(number), F.regexp_extract(value, "^[0-9]+(.*)$", 1), F.lit(" ed")))


def book(bibliography: bool = False) -> Column:
    parts = F.array_compact(F.array(F.nullif("publisher", F.lit("")), F.when(F.coalesce("edition", F.lit("")) != "", edition(F.col("edition"))), needed("year")))
    has_volume = F.coalesce("volume", F.lit("")) != ""
    pin = F.lit("") if bibliography else F.when(has_volume, optional(", ", F.col("pinpoint"))).otherwise(optional(" ", F.col("pinpoint")))
    return F.concat(names(F.col("authors"), bibliography), F.lit(", "), italic(needed("title")), F.lit(" ("), F.array_join(parts, ", "), F.lit(")"), optional(" vol ", F.col("volume")), pin)


def document(default: str, bibliography: bool = False) -> Column:
    """Speeches, media releases and reports: author, title and a bracket of type and number, forum and date."""
    kind = F.concat(F.coalesce(F.nullif("document_type", F.lit("")), F.lit(default)), optional(" ", F.col("number")))
    parts = F.array_compact(F.array(kind, F.nullif("forum", F.lit("")), needed("date")))
    title = italic(needed("title")) if default == "Report" else quoted(needed("title"))
    pin = F.lit("") if bibliography else optional(" ", F.col("pinpoint"))
    return F.concat(names(F.col("authors"), bibliography), F.lit(", "), title, F.lit(" ("), F.array_join(parts, ", "), F.lit(")"), pin)


def full(bibliography: bool = False) -> Column:
    """The citation in full; as a bibliography entry: first author inverted, no pinpoint."""
    kind = F.col("type")
    out = F.when(kind == "case", case(bibliography)).when(kind == "legislation", legislation(bibliography)).when(kind == "journal_article", journal_article(bibliography)).when(kind == "book", book(bibliography))
    for name, default in (("speech", "Speech"), ("media_release", "Media Release"), ("report", "Report")):
        out = out.when(kind == name, document(default, bibliography))
    return out.otherwise(F.coalesce("title", "name", F.lit("")))


def subsequent(short_title: Column, first_note: Column, pinpoint: Column) -> Column:
    return F.concat(short_title, F.lit(" (n "), first_note.cast("string"), F.lit(")"), optional(" ", pinpoint))
