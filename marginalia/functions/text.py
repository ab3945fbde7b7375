"""Scalar text functions as column expressions; all run in the JVM inside code generation.

Character classes are spelled \\p{L}, \\p{N}: Java's \\w and \\s are ASCII, other engines' may not be.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as these functions mean it.
SPACE = r"[ \t\n\r\x0B\x0C]"


def norm_key(value: Column) -> Column:
    """The key by which variants of a name meet: lower case, without . ' , and white space; null gives ''."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[.,'’‘]|" + SPACE, "")


def clean_field(value: Column) -> Column:
    """White space collapsed, edges trimmed, closing .,;: dropped; nothing left gives null."""
    collapsed = F.trim(F.regexp_replace(value, SPACE + "+", " "))
    return F.nullif(F.regexp_replace(collapsed, r"[ .,;:]+$", ""), F.lit(""))


def word_list(value: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def unify_quotes(value: Column) -> Column:
    return F.translate(value, "‘’‚‛“”„‟–—−‐‑", "''''\"\"\"\"-----")


def fingerprint_form(value: Column) -> Column:
    """What two writings of a line share: quotes and dashes unified, lower case, letters, digits and single spaces."""
    plain = F.regexp_replace(F.lower(unify_quotes(value)), r"[^\p{L}\p{N}_ \t\n\r\x0B\x0C]", "")
    return F.trim(F.regexp_replace(plain, SPACE + "+", " "))


def countable(form: Column, least: int = 12) -> Column:
    """A line whose form is long enough to tell documents apart and isn't a bare back reference."""
    return (F.length(form) >= least) & ~form.rlike(r"^ibid( [0-9]+)?$") & ~form.rlike(r"^(above|supra) n [0-9]+$")


def keyed_hash(key: bytes, value: Column, digits: int = 32) -> Column:
    """HMAC-SHA-256 of the text, first hex digits, composed of sha2; equal to any other HMAC."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(value, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(F.lit(bytearray(outer)), first), 256), 1, digits)


def legislation_key(title: Column) -> Column:
    """Lower-case words joined by one space, & as and."""
    return F.array_join(word_list(F.replace(title, F.lit("&"), F.lit(" and "))), " ")


def ordinal(n: Column) -> Column:
    tail = F.when(F.pmod(n, F.lit(100)).between(10, 20), "th")
    for d, s in ((1, "st"), (2, "nd"), (3, "rd")):
        tail = tail.when(F.pmod(n, F.lit(10)) == d, s)
    return F.concat(n.cast("string"), tail.otherwise("th"))


def shorten_span(first: Column, last: Column) -> Column:
    """first-last with an en dash; the second number keeps the digits that differ, two of them for a teen.
    Numbers of different length, or not ascending, stay whole. Both are strings of digits."""
    n = F.length(last)
    differs = F.array_position(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(first, i, F.lit(1)) != F.substr(last, i, F.lit(1))), F.lit(True))
    teen = (n >= 2) & (F.substr(last, n - 1, F.lit(1)) == "1")
    start = F.when(teen, F.least(differs, (n - 1).cast("long"))).otherwise(differs)
    comparable = (F.length(first) == n) & (first < last)
    return F.concat(first, F.lit("–"), F.when(comparable, F.substr(last, start.cast("int"))).otherwise(last))


def expand_span(text: Column) -> tuple[Column, Column]:
    """Both full numbers of a-b, where b may be shortened."""
    first, short = F.regexp_extract(text, "^([0-9]+)[–-]([0-9]+)$", 1), F.regexp_extract(text, "^([0-9]+)[–-]([0-9]+)$", 2)
    missing = F.greatest(F.length(first) - F.length(short), F.lit(0))
    return first, F.concat(F.substr(first, F.lit(1), missing), short)


def html_plain(value: Column) -> Column:
    """Tags dropped, the five basic character references decoded, & last."""
    out = F.regexp_replace(value, "<[^>]+>", "")
    for reference, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(reference), F.lit(sign))
    return out


def html_escape(value: Column) -> Column:
    """& first, then < > " '."""
    out = value
    for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(sign), F.lit(reference))
    return out


def closing_stop(value: Column) -> Column:
    """A full stop at the end unless . ! or ? stands there."""
    return F.when(value.rlike(r"[.!?]$"), value).otherwise(F.concat(value, F.lit(".")))


def redact_ids(value: Column) -> Column:
    """Identifiers of 32 hex digits in groups keep their first eight."""
    return F.regexp_replace(value, r"(?i)\b([0-9a-f]{8})-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "$1…")


def year_in(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"\b([0-9]{4})\b", 1), F.lit(""))


def surname(name: Column) -> Column:
    """Before the comma, else the last word."""
    trimmed = F.trim(name)
    return F.when(trimmed.contains(","), F.trim(F.substring_index(trimmed, ",", 1))).otherwise(F.substring_index(trimmed, " ", -1))


def title_and_year(title: Column, year: Column) -> tuple[Column, Column]:
    """A year at the end of a title is its year, unless one is given."""
    found = F.regexp_extract(title, r"^(.*\S)\s+([0-9]{4})$", 2)
    use = F.coalesce(year, F.lit("")) == ""
    return F.when(use & (found != ""), F.regexp_extract(title, r"^(.*\S)\s+([0-9]{4})$", 1)).otherwise(title), F.when(use, F.nullif(found, F.lit(""))).otherwise(year)


def case_name(name: Column) -> Column:
    """Quotes and asterisks unwrapped, stops of short abbreviations dropped, vs as v, a bracketed number in square brackets."""
    out = F.regexp_replace(F.trim(name), "^[*\"'‘“]+|[*\"'’”]+$", "")
    out = F.regexp_replace(out, r"\b([A-Z][a-z]{1,3})\.", "$1")
    out = F.regexp_replace(out, r"\s+(?:vs?\.?|V)\s+", " v ")
    return F.regexp_replace(out, r"\(No ([0-9]+)\)$", "[No $1]")
