"""What changed between a footnote as written and as formatted: one kind for each sort of change, in a fixed order.

Rules in SQL text for both dialects of marginalia.functions.dialect, over texts with italics between asterisks. Each
detector is a predicate of both texts; what no detector accounts for is `other`. Also fixes and checks of running text.
"""

from __future__ import annotations

from marginalia.functions.dialect import Spark
from marginalia.operators.normalise import trimmed


def _plain(x: str) -> str:
    return f"replace({x}, '*', '')"


def _new(d: Spark, before: str, after: str, pattern: str) -> str:
    """Something that the pattern finds in the text after and that the text before has not."""
    return f"{d.size(d.keep(d.all(_plain(after), pattern), lambda x: f'NOT contains({_plain(before)}, {x})'))} > 0"


def _gone(d: Spark, before: str, after: str, pattern: str) -> str:
    return _new(d, after, before, pattern)


def detectors(d: Spark, before: str, after: str) -> dict[str, str]:
    """Predicates by kind, in the order in which the kinds are shown."""
    b, a = _plain(before), _plain(after)
    parts = lambda x: d.all(x, r"\*[^*]+\*")
    stays = lambda x, other: f"NOT contains({other}, {x}) AND contains({_plain(other)}, {_plain(x)})"
    return {
        "ibid": f"{d.has(a, r'\b[Ii]bid\b')} AND (NOT {d.has(b, r'(?i)\bibid\b')} OR {d.has(a, '^Ibid')} AND {d.has(b, r'^\s*ibid')})",
        "n_reference": _new(d, before, after, r"\(n [0-9]+\)"),
        "short_title": _new(d, before, after, r"\(‘[^’]+’\)"),
        "italic": f"{d.size(d.keep(parts(after), lambda x: stays(x, before)))} > 0",
        "roman": f"{d.size(d.keep(parts(before), lambda x: stays(x, after)))} > 0",
        "case_number": f"{d.has(b, r'\(No [0-9]+\)')} AND {d.has(a, r'\[No [0-9]+\]')}",
        "judges": f"{d.has(b, r'\bper [A-Z]')} AND {d.has(a, r'\([A-Z][^()]* (?:CJ|JJ?|P|AJA|JA)\)')}",
        "pinpoint_label": _gone(d, before, after, r"(?i)\b(?:pp?\.?|pages?|at|para(?:graph)?s?\.?)\s+\[?[0-9]+"),
        "section_label": _new(d, before, after, r"\bss? [0-9]+"),
        "span": f"{d.has(b, r'[0-9]\s*-\s*[0-9]')} AND {d.has(a, '[0-9]–[0-9]')}",
        "abbreviation": _gone(d, before, after, r"\b[A-Z]\.(?:[A-Z]\.)+|\b[A-Z][a-z]{1,3}\.(?: |,)"),
        "quotes": f"{d.has(b, r'[\x22“”]|\x27[^\x27]+\x27')} AND {d.has(a, '‘[^’]+’')}",
        "full_stop": f"{d.has(a, r'[.!?]\s*$')} AND NOT {d.has(b, r'[.!?]\s*$')}",
        "spaces": f"{d.has(b, r'^\s|\s\s|\s$')} AND NOT {d.has(a, r'^\s|\s\s|\s$')}",
    }


def kinds(d: Spark, before: str, after: str) -> str:
    """The kinds of changes between two texts, as an array; nothing for equal texts, null texts count as empty."""
    b, a = f"coalesce({before}, '')", f"coalesce({after}, '')"
    found = d.keep(d.array([f"CASE WHEN {rule} THEN '{kind}' END" for kind, rule in detectors(d, b, a).items()]), lambda x: f"{x} IS NOT NULL")
    other = d.array(["'other'"])
    return f"CASE WHEN {b} = {a} THEN {d.keep(other, lambda x: 'false')} ELSE {d.let(found, lambda k: f'CASE WHEN {d.size(k)} = 0 THEN {other} ELSE {k} END', 'kinds')} END"


def fixed_body(d: Spark, x: str) -> str:
    """Running text: s 57-64 as ss 57–64 (letters after numbers stay), no space before a note mark's stop, spans of pages with an en dash."""
    sections = d.sub(x, r"\bs\s+([0-9]+[A-Z]{0,2})\s*[-–]\s*([0-9]+[A-Z]{0,2})\b", r"ss \1–\2")
    pages = d.sub(sections, r"\b(pp?\.?|at) ([0-9]+)-([0-9]+)\b", r"\1 \2–\3")
    return d.sub(pages, r"[ \t]+([,.;:])", r"\1")


def possessives(d: Spark, x: str) -> str:
    """How many possessives of names of sources in italics a text has: *Reed*’s."""
    return d.size(d.all(f"coalesce({x}, '')", r"\*[^*]+\*[’\x27]s\b"))


def missing_stop(d: Spark, x: str) -> str:
    """Does a text begin a new sentence at its end without having closed the last one."""
    return f"NOT {d.has(trimmed(d, x), r'[.!?’”)]$')}"
