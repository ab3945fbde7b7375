"""Text with styles: arrays of runs (text, italic), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUNS = "array<struct<text:string,italic:boolean>>"


def run(text: Column, italic: bool | Column) -> Column:
    flag = italic if isinstance(italic, Column) else F.lit(italic)
    return F.struct(text.alias("text"), flag.alias("italic"))


def styled(text: Column, italic: bool | Column = False) -> Column:
    """One run; none for an empty or null text."""
    return F.when(F.length(text) > 0, F.array(run(text, italic))).otherwise(F.array().cast(RUNS))


def merged(runs: Column) -> Column:
    """Neighbours of one style joined, empty runs dropped."""

    def add(out: Column, r: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(run(F.concat(last["text"], r["text"]), r["italic"])))
        fresh = F.concat(out, F.array(run(r["text"], r["italic"])))
        return F.when(F.coalesce(F.length(r["text"]), F.lit(0)) == 0, out).when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["italic"] == r["italic"]), joined).otherwise(fresh)

    return F.aggregate(runs, F.array().cast(RUNS), add)


def appended(a: Column, b: Column) -> Column:
    return merged(F.concat(a, b))


def text_of(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def markup(runs: Column) -> Column:
    """Italic runs between asterisks."""
    return F.array_join(F.transform(runs, lambda r: F.when(r["italic"], F.concat(F.lit("*"), r["text"], F.lit("*"))).otherwise(r["text"])), "")


def html(runs: Column) -> Column:
    from marginalia.functions.text import html_escape

    return F.array_join(F.transform(runs, lambda r: F.when(r["italic"], F.concat(F.lit("<em>"), html_escape(r["text"]), F.lit("</em>"))).otherwise(html_escape(r["text"]))), "")


def sliced(runs: Column, start: Column, end: Column) -> Column:
    """The characters from start (0-based) to before end, with their styles."""

    def cut(state: Column, r: Column) -> Column:
        at, out = state["at"], state["out"]
        n = F.length(r["text"])
        a, b = F.greatest(start - at, F.lit(0)), F.least(end - at, n)
        piece = F.when(b > a, F.concat(out, F.array(run(F.substr(r["text"], a + 1, b - a), r["italic"])))).otherwise(out)
        return F.struct((at + n).alias("at"), piece.alias("out"))

    return F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(RUNS).alias("out")), cut, lambda s: s["out"])


def visible(runs: Column) -> Column:
    """What a reader sees: white space is never italic, edges are trimmed."""
    pieces = F.flatten(F.transform(runs, lambda r: F.transform(F.regexp_extract_all(r["text"], F.lit(r"[ \t\n\r]+|[^ \t\n\r]+"), F.lit(0)), lambda p: run(p, r["italic"] & ~p.rlike(r"^[ \t\n\r]")))))
    out = merged(pieces)
    whole = text_of(out)
    lead = F.length(whole) - F.length(F.regexp_replace(whole, r"^[ \t\n\r]+", ""))
    return merged(sliced(out, lead, F.length(F.regexp_replace(whole, r"[ \t\n\r]+$", ""))))


def changed(before: Column, after: Column) -> Column:
    return markup(visible(before)) != markup(visible(after))
