"""Pieces of a text back in their places: spans of the original that were copied, in order, without overlap.

A piece is looked for behind the end of the last one found, so repeated pieces take successive places. Runs of white space count as
one space and curly quotes as straight ones; edges of a piece keep one space if they have one. A piece that isn't found
(or is empty) has no span and moves nothing. Where the original has no asterisks, those of a piece are marks of style and are left out.

Everything is a column expression over one row: the text, and an array of pieces. A row's work grows with pieces times text, so
a row is a note or a paragraph. Null texts have no spans; a null piece is not found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.richtext import sliced, text_of

#: White space as Unicode has it, for Java and RE2 alike.
SPACE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPAN = "struct<start:int,end:int>"


def _once(value: Column, rule: Callable[[Column], Column]) -> Column:
    """A rule of a value that is made once."""
    return F.element_at(F.transform(F.array(value), rule), 1)


def _pattern(piece: Column) -> Column:
    """A regular expression for a piece without regard to the kind and number of spaces and the shape of quotes."""
    first = F.when(piece.rlike(f"^{SPACE}"), f"{SPACE}+").otherwise("")
    last = F.when(piece.rlike(f"{SPACE}$"), SPACE).otherwise("")
    body = F.regexp_replace(F.regexp_replace(piece, f"^{SPACE}+|{SPACE}+$", ""), r"([\\.\[\]{}()*+?^$|\-&~#])", r"\\$1")
    body = F.regexp_replace(body, "['‘’]", "['‘’]")
    body = F.regexp_replace(body, '["“”]', '["“”]')
    # The replacement holds backslashes, which stand for themselves when doubled.
    body = F.regexp_replace(body, f"{SPACE}+", SPACE.replace("\\", "\\\\") + "+")
    return F.when(body != "", F.concat(first, body, last))


def forward_spans(text: Column, pieces: Column) -> Column:
    """For each piece its span (code points, end exclusive) or null."""

    def found(state: Column, rest: Column, seen: Column, parts: Column) -> Column:
        # Lengths of what stands before and behind the piece: in code points, as offsets of a match wouldn't be.
        start = (state["cursor"] + F.length(rest) - F.length(seen) + F.length(parts[0])).cast("int")
        end = (state["cursor"] + F.length(rest) - F.length(F.try_element_at(parts, F.lit(2)))).cast("int")
        hit = F.coalesce(F.size(parts) == 2, F.lit(False))
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(F.when(hit, end).otherwise(state["cursor"]).alias("cursor"), F.concat(state["spans"], F.array(F.when(hit, span))).alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        cursor = state["cursor"]
        plain = F.when(F.contains(text, F.lit("*")), piece).otherwise(F.replace(piece, F.lit("*"), F.lit("")))
        # Of a run of spaces only the first one can be taken, so what the last piece left of it is passed over.
        inside = (cursor > 0) & F.substr(text, F.greatest(cursor, F.lit(1)), F.lit(1)).rlike(SPACE)
        behind = lambda rest: F.when(inside, F.regexp_replace(rest, f"^{SPACE}+", "")).otherwise(rest)
        return _once(F.substr(text, cursor + 1), lambda rest: _once(behind(rest), lambda seen: _once(F.split(seen, _pattern(plain), 2), lambda parts: found(state, rest, seen, parts))))

    none = F.struct(F.lit(0).alias("cursor"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    return F.when(text.isNotNull(), F.aggregate(pieces, none, step, lambda s: s["spans"]))


def styled_pieces(runs: Column, pieces: Column) -> Column:
    """Each piece as the original has it, with its styles; null where it isn't found."""
    return F.transform(forward_spans(text_of(runs), pieces), lambda s: F.when(s.isNotNull(), sliced(runs, s["start"], s["end"])))


def gaps(text: Column, spans: Column) -> Column:
    """What stands before, between and behind the spans found: one more text than spans."""
    kept = F.filter(spans, lambda s: s.isNotNull())
    starts = F.concat(F.array(F.lit(0)), F.transform(kept, lambda s: s["end"]))
    stops = F.concat(F.transform(kept, lambda s: s["start"]), F.array(F.length(text)))
    return F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda g: F.substr(text, g["a"] + 1, g["b"] - g["a"]))
