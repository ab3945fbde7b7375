"""Offset-preserving deobfuscation of personal data.

Plain identifiers are found in the text as it stands. Then transducers rewrite the text, each keeping
for every character it emits the source range it came from: homoglyphs, wide and styled characters to
ASCII and invisible characters to nothing; spelled digits ("four two", "vier") to digits; written
"at", "dot", "plus" and their bracketed forms to signs. The same detectors run on the result and each
hit is mapped back to source characters. Hits that overlap a plain one of their kind are left out.

Null and empty texts have no spans; each row is judged on its own, repeated rows alike; a text of any length is read whole, in
time that grows with its length. Other columns of the table are not used. Offsets are code points.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from marginalia.llm.spans import Span, apart_from, digest, find_spans

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@label.label...; each @ is looked at once, so the time is linear."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def detect(text: str) -> list[Span]:
    """Spans by kind as listed, then start."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return found


# Letters of other scripts that look like Latin ones, and signs that stand for ASCII ones.
_LOOKALIKES = dict(zip("АВЕКМНОРСТХУІЈЅаеорсухіјѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρ", "ABEKMHOPCTXYIJSaeopcyxijsdqwhABEZHIKMNOPTYXaovp", strict=True))
_SIGNS = {"。": ".", "．": ".", "․": ".", "·": ".", "•": ".", "﹒": ".", "＠": "@", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "＋": "+", " ": " ", " ": " ", " ": " "}
_INVISIBLE = frozenset("­​‌‍⁠﻿᠎")
_ODD = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ſ]")
# The words for the digits 0 to 9 in the languages of the corpus.
_DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_SPELLED = {w: str(d) for words in _DIGIT_WORDS.values() for d, w in enumerate(words.split())} | {"oh": "0"}
_NUMBER_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_TIMES = {"double": 2, "doble": 2, "triple": 3}
_REPEATED = rf"(?:{'|'.join(_TIMES)})[\x20\t]++(?:{_NUMBER_WORD}|[0-9])"
_BETWEEN = {"dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-", "tiret": "-", "guion": "-", "strich": "-"}
_JOINING = rf"[\x20\t]*+(?:[,;/.()-]|\b(?:{'|'.join(_BETWEEN)})\b)?+[\x20\t]*+"
_DIGITS = rf"(?:{_REPEATED}|{_NUMBER_WORD}|[0-9]++)"
_SPELLED_RUN = re.compile(rf"(?i)(?<![^\W_])(?:(?:plus\b[\x20]*+|\+[\x20]*+)?{_DIGITS}(?:{_JOINING}{_DIGITS}(?![^\W_]))+)")
#: The first of the number words that an edited run holds, with what follows it: a superset of spell_digits.
_SPELLED_HINT = re.compile(rf"(?i)(?<![^\W\d_])(?:{_NUMBER_WORD}|{'|'.join(_TIMES)}){_JOINING}(?:{_NUMBER_WORD}|{'|'.join(_TIMES)}|[0-9])")
_PIECE = re.compile(rf"(?i){_REPEATED}|{_NUMBER_WORD}|[0-9]+|\b(?:{'|'.join(_BETWEEN)})\b|plus|\+|[,;/.()\-]|[\x20\t]+")
#: What addresses in disguise are made of. Bare words count between spaces only; `glued` ones are joined to their neighbours.
_ADDRESS_PIECE = re.compile(
    r"(?P<space>\x20+)|(?P<at_mark>[\[({<]\x20*+(?i:at|@|a|arroba|arobase)\x20*+[\])}>])|(?P<dot_mark>[\[({<]\x20*+(?i:dot|\.|punkt|punto|point)\x20*+[\])}>])"
    r"|(?P<at_word>(?<=\x20)(?:at|AT|arroba|arobase)(?=\x20))|(?P<dot_word>(?<=\x20)(?:dot|DOT|punkt|punto|point)(?=\x20))"
    r"|(?P<at_glued>[_-](?:at|AT)[_-])|(?P<dot_glued>[_-](?:dot|DOT)[_-])|(?P<at>@)|(?P<dot>\.)|(?P<name>(?:(?![_-](?:at|AT|dot|DOT)[_-])[A-Za-z0-9_%+-])+)"
)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
# Frequent top-level domains; only before these does a weak sign ("(a)", a dot and a space) count.
_TOP_DOMAINS = frozenset("com net org edu gov info io de fr es uk eu ch at it nl us ca co".split())
#: Every disguised sign that write_signs takes: a superset of it.
_AT_HINT = re.compile(
    r"(?i)[\[({<]\x20*+(?:at|@|a|arroba|arobase|dot|punkt|punto|point|\.)\x20*+[\])}>]|\x20(?:dot|punkt|punto|arroba|arobase)\x20|[_-](?:at|dot)[_-]|\x20@|@\x20"
    r"|@[a-z0-9-]+\.\x20|@[a-z0-9.-]+\x20+point\x20|\x20point\x20+[a-z0-9._%+-]+@|\x20at\x20+[a-z0-9-]+\.[a-z0-9-]"
)
#: Letters that stand for digits between digits.
_DIGIT_LOOKALIKES = re.compile(r"(?:(?<=[0-9])|(?<=[0-9][\x20-]))[OoIl]++(?=[0-9])|(?<=[0-9])[OoIl]++(?=[\x20-][0-9])")
#: A name that no word of running text before a bare "at" looks like.
_NAMED = re.compile(r"(?=.*[A-Za-z])[A-Za-z0-9]+(?:[0-9]|[._+-][A-Za-z0-9])[A-Za-z0-9._+-]*")
_IP_DOT = r"(?:\x20*+[\[({<]\x20*+(?:dot|\.|punkt|punto|point)\x20*+[\])}>]\x20*+|\x20++(?:DOT|dot|punkt|punto|point)\x20++|\.)"
_IP_DOTS = re.compile(rf"[0-9]{{1,3}}(?:{_IP_DOT}[0-9]{{1,3}}){{3}}")
_DOT = re.compile(_IP_DOT)


class Mapped:
    """A text with, for each character, the range of source characters that it stands for."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.text = text
        self.starts = list(range(len(text))) if starts is None else starts
        self.ends = list(range(1, len(text) + 1)) if ends is None else ends

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """edits: (start, end, replacement), in order and apart. Each new character stands for the whole replaced range."""
        out, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            out += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            at = b
        return Mapped("".join(out) + self.text[at:], starts + self.starts[at:], ends + self.ends[at:])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def _plain_character(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    if new := _LOOKALIKES.get(c) or _SIGNS.get(c):
        return new
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded != c and folded.isascii() else c


def fold_homoglyphs(m: Mapped) -> Mapped:
    edits = [(x.start(), x.end(), new) for x in _ODD.finditer(m.text) if (new := _plain_character(x.group())) != x.group()]
    return m.rewritten(edits) if edits else m


def fold_digit_letters(m: Mapped) -> Mapped:
    edits = [(i, i + 1, "0" if m.text[i] in "Oo" else "1") for x in _DIGIT_LOOKALIKES.finditer(m.text) for i in range(*x.span())]
    return m.rewritten(edits) if edits else m


def _as_digits(word: str) -> str:
    """What a piece of a spelled number stands for: digits, a sign or nothing."""
    if word in _SPELLED or word in _BETWEEN:
        return _SPELLED.get(word) or _BETWEEN[word]
    first, *last = word.split()
    if last:
        return _TIMES[first] * _SPELLED.get(last[-1], last[-1])
    return "+" if word == "plus" else word if word[0].isdigit() or word in ".+-" else ""


def spell_digits(m: Mapped) -> Mapped:
    """Runs with two or more written digits become digits; written dots and dashes in them become signs."""
    edits = []
    for run in _SPELLED_RUN.finditer(m.text):
        pieces = [(run.start() + p.start(), run.start() + p.end(), p.group().lower()) for p in _PIECE.finditer(run.group())]
        written = sum(w in _SPELLED or w.split()[:1] != [] and w.split()[0] in _TIMES for _, _, w in pieces)
        if written >= 2 or any(w.split() and w.split()[0] in _TIMES for _, _, w in pieces):
            edits += [(a, b, new) for a, b, w in pieces if (new := _as_digits(w) if w.strip() else "") != m.text[a:b]]
    return m.rewritten(edits) if edits else m


class _Address:
    """The pieces of a text between which written addresses are looked for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.pieces = [(x.lastgroup, *x.span()) for x in _ADDRESS_PIECE.finditer(text)]

    def _kind(self, i: int) -> str | None:
        return self.pieces[i][0] if 0 <= i < len(self.pieces) else None

    def _touch(self, i: int, j: int) -> bool:
        return self.pieces[min(i, j)][2] == self.pieces[max(i, j)][1]

    def _dot(self, i: int, step: int, point: bool) -> tuple[int, int, int] | None:
        """A dot sign that starts with piece i (going by step): the last piece of it, and its span."""
        first = i
        if self._kind(i) == "space":
            i += step
        if self._kind(i) not in ("dot", "dot_mark", "dot_word", "dot_glued") or i != first and not self._touch(first, i):
            return None
        kind, a, b = self.pieces[i]
        if kind == "dot_word" and (i == first or self.text[a:b] == "point" and not point):
            return None
        last = i
        if self._kind(i + step) == "space" and self._touch(i, i + step):
            last = i + step
        elif kind == "dot_word":
            return None
        if kind in ("dot", "dot_glued") and (i != first or last != i):
            after = self.pieces[last + 1] if step > 0 and kind == "dot" and i == first and last + 1 < len(self.pieces) else None
            if not after or self.text[after[1] : after[2]] not in _TOP_DOMAINS:
                return None
        return last, min(self.pieces[first][1], self.pieces[last][1]), max(self.pieces[first][2], self.pieces[last][2])

    def names(self, i: int, step: int, point: bool, free: int) -> tuple[int, int, list[tuple[int, int]]] | None:
        """Names joined by dot signs, from piece i by step: the outermost piece, its far end, and the dots."""
        if self._kind(i) != "name" or i < free:
            return None
        dots: list[tuple[int, int]] = []
        outer = i
        while True:
            _, a, b = self.pieces[outer]
            if step > 0:
                label = _LABEL.match(self.text, a, b)
                if not label:
                    return (outer - 1, dots.pop()[0], dots) if dots else None
                if label.end() < b:
                    return outer, label.end(), dots
            if not free <= outer + step < len(self.pieces) or not self._touch(outer, outer + step):
                break
            dot = self._dot(outer + step, step, point)
            if not dot or self._kind(dot[0] + step) != "name" or dot[0] + step < free or not self._touch(dot[0], dot[0] + step):
                break
            dots.append(dot[1:])
            outer = dot[0] + step
        return outer, self.pieces[outer][2] if step > 0 else self.pieces[outer][1], dots

    def signs(self) -> Iterator[tuple[int, int, str]]:
        """Every at sign is looked at once, names are followed outwards from it."""
        free = 0
        for i, (kind, a, b) in enumerate(self.pieces):
            if kind not in ("at", "at_mark", "at_word", "at_glued") or i < free:
                continue
            left, right = i - 1, i + 1
            if kind != "at_glued":
                left -= self._kind(left) == "space" and self._touch(left, i)
                right += self._kind(right) == "space" and self._touch(i, right)
            if left < free or right >= len(self.pieces) or not all(self._touch(k, k + 1) for k in range(left, right)):
                continue
            word = self.text[a:b]
            point = word not in ("at", "AT")
            local, domain = self.names(left, -1, point, free), self.names(right, 1, point, free)
            if not local or not domain or not domain[2]:
                continue
            at = (self.pieces[left][2], self.pieces[right][1])
            end = domain[1]
            written = any(self.text[x:y] != "." and re.search(r"\w", self.text[x:y]) for x, y in domain[2])
            host = self.text[at[1] : end]
            named = _NAMED.fullmatch(self.text, local[1], at[0]) and re.search(r"\.[A-Za-z]{2,}$", host)
            top = self.text[domain[2][-1][1] : end].lower() in _TOP_DOMAINS
            if kind == "at_word" and not written and not named or kind == "at_glued" and not written or kind == "at_mark" and word[1:-1].strip() in ("a", "A") and not top:
                continue  # "at example.com" in running text
            yield from ((x, y, ".") for x, y in (*local[2], *domain[2]))
            yield *at, "@"
            free = domain[0] + 1


def write_signs(m: Mapped) -> Mapped:
    """Disguised addresses: written or bracketed at and dot become signs. A bare "at" counts only before a written dot, or between what looks like an address."""
    edits = [(a, b, new) for a, b, new in _Address(m.text).signs() if m.text[a:b] != new]
    for x in _IP_DOTS.finditer(m.text):
        edits += [(*y.span(), ".") for y in _DOT.finditer(m.text, *x.span()) if y.group() != "."]
    edits.sort()
    apart = [e for i, e in enumerate(edits) if not i or e[0] >= edits[i - 1][1]]
    return m.rewritten(apart) if apart else m


def _disguises(text: str) -> list[Callable[[Mapped], Mapped]]:
    out: list[Callable[[Mapped], Mapped]] = []
    if not text.isascii() and _ODD.search(text):
        out.append(fold_homoglyphs)
    return out


def identifiers_in(text: str) -> tuple[list[Span], list[Span]]:
    """The plain spans, and all spans; both by kind as listed, then start."""
    base = detect(text)
    m = Mapped(text)
    for step in _disguises(text):
        m = step(m)
    m = fold_digit_letters(m)
    if _SPELLED_HINT.search(m.text):
        m = spell_digits(m)
    if _AT_HINT.search(m.text):
        m = write_signs(m)
    if m.text == text:
        return base, base
    found = list(base)
    free = {kind: apart_from([s for s in base if s[0] == kind]) for kind in KINDS}
    for kind, a, b in detect(m.text):
        span = (kind, *m.source(a, b))
        if free[kind](span):
            found.append(span)
    return base, sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def scan_identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, `base` spans and all `found` spans (kind, start, end)."""
    return find_spans(docs, id_col, text_col, identifiers_in)


def identifier_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return digest(scan_identifiers(docs, id_col, text_col), id_col, KINDS)
