"""Secret scans: fixed patterns, and a battery of randomness tests on every token that may be a key.

Candidates are runs of key characters, cut at "=", whole and in their parts between "/" and other joins; of those found inside one
another the strongest stays. A candidate's encoding is the smallest alphabet that holds its characters (hex, letters of one case,
base32, base36 of one case, letters, base62, base64). Three tests ask whether its characters are uniform draws from that
alphabet: chi-squared over cells of the alphabet, runs about the median, serial correlation. For a key their p-values are
uniform; for ordinary text they crowd near 0, with density `crowding` * p ** (crowding - 1). A text model of
class changes (digit, lower, upper) and letter frequencies, in the token's own encoding, gives the likelihood under
ordinary text. The product of these four likelihood ratios, text over uniform draws, bounds the p-value under ordinary
text (Markov's inequality); so every test of the battery adds to or takes from the evidence of a token. Within a text these
p-values go through a Benjamini-Hochberg step whose weights grow with the token's length, so that short tokens need
stronger evidence and a text with many candidates does not collect chance finds.

Null and empty texts have no spans; a text of any length is read whole, in time that grows with its length (times its
logarithm). Each row is judged on its own, repeated rows alike. Other columns of the table are not used; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from marginalia.llm.spans import Span, apart_from, digest, find_spans

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_KEYWORD = re.compile(r"(?ai)passw|secret|token|api_?key")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_VALUE, _SEGMENT, _PART = re.compile(r"[^=]+"), re.compile(r"[^/=]+"), re.compile(r"[A-Za-z0-9]+")


@dataclass(frozen=True)
class RandomnessRules:
    """alpha: false-discovery rate; crowding: see above; even_length: the length with weight 1; least_length: of a candidate."""

    alpha: float = 0.002
    crowding: float = 0.3
    even_length: int = 24
    least_length: int = 16


_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pattern and characters in order, by size.
_ALPHABETS = (
    (re.compile(r"[0-9a-f]+"), "0123456789abcdef"),
    (re.compile(r"[0-9A-F]+"), "0123456789ABCDEF"),
    (re.compile(r"[a-z]+"), _LOWER),
    (re.compile(r"[A-Z]+"), _UPPER),
    (re.compile(r"[A-Z2-7]+"), _UPPER + "234567"),
    (re.compile(r"[0-9a-z]+"), _DIGITS + _LOWER),
    (re.compile(r"[0-9A-Z]+"), _DIGITS + _UPPER),
    (re.compile(r"[A-Za-z]+"), _UPPER + _LOWER),
    (re.compile(r"[A-Za-z0-9]+"), _DIGITS + _UPPER + _LOWER),
    (re.compile(r"[A-Za-z0-9+/_-]+"), _DIGITS + _UPPER + _LOWER + "+/"),
)


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with df degrees >= x), by the Wilson-Hilferty cube root."""
    if x <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _encoding(body: str) -> str | None:
    """The characters of the smallest alphabet that holds body."""
    return next((characters for pattern, characters in _ALPHABETS if pattern.fullmatch(body)), None)


def _values(body: str, characters: str) -> list[int]:
    order = {c: i for i, c in enumerate(characters)}
    order |= {"-": 62, "_": 63} if len(characters) == 64 else {}
    return [order[c] for c in body]


def uniformity(values: Sequence[int], size: int) -> tuple[float, float, float]:
    """p-values of three tests that hold for uniform draws: cell counts, runs about the median, serial correlation."""
    n = len(values)
    cells = min(size, max(2, n // 4))
    counts = [0] * cells
    for v in values:
        counts[v * cells // size] += 1
    expected = [(-(-(c + 1) * size // cells) - -(-c * size // cells)) * n / size for c in range(cells)]
    chi = chi2_tail(sum((o - e) ** 2 / e for o, e in zip(counts, expected, strict=True) if e), cells - 1)
    high = [2 * v >= size for v in values]
    a, b = sum(high), n - sum(high)
    if not a or not b:
        return chi, 0.0, 0.0
    runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    mean, var = 2 * a * b / n + 1, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1)) if n > 1 else 0
    p_runs = two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    mid = sum(values) / n
    spread = sum((v - mid) ** 2 for v in values)
    r = sum((x - mid) * (y - mid) for x, y in zip(values, values[1:], strict=False)) / spread if spread else 1.0
    return chi, p_runs, two_sided((r + 1 / n) * math.sqrt(n))


# Letters of prose in the languages of the corpus, per 1,000; signs that join words.
_LETTERS = dict(zip(_LOWER, (85, 16, 31, 45, 145, 14, 18, 30, 73, 4, 6, 45, 27, 82, 62, 23, 6, 65, 72, 72, 40, 13, 11, 4, 9, 7), strict=True))
_JOINS = dict.fromkeys("-_/+", 20)
_ALL = sum(_LETTERS.values()) + sum(_JOINS.values())
_WITHIN = {c: math.log(n / _ALL) for c, n in (_LETTERS | _JOINS).items()} | {c.upper(): math.log(n / sum(_LETTERS.values())) for c, n in _LETTERS.items()} | dict.fromkeys(_DIGITS, -math.log(10))
_CLASS = dict.fromkeys(_LOWER + "-_/+", 0) | dict.fromkeys(_UPPER, 1) | dict.fromkeys(_DIGITS, 2)
#: Two styles of writing, words in one case and words with capitals: chances from lower (or a join), upper and digit to each of these.
_STYLES = [
    [[math.log(x) for x in row] for row in rows]
    for rows in (((0.94, 0.03, 0.03), (0.03, 0.94, 0.03), (0.06, 0.06, 0.88)), ((0.82, 0.13, 0.05), (0.75, 0.20, 0.05), (0.15, 0.15, 0.70)))
]


def text_ratio(body: str, size: int) -> float:
    """Logarithm of the likelihood of a token as ordinary text over that as uniform draws from size characters."""
    kinds = [_CLASS[c] for c in body]
    within = sum(_WITHIN[c] for c in body) - math.log(3)
    styles = [sum(style[x][y] for x, y in zip(kinds, kinds[1:], strict=False)) for style in _STYLES]
    top = max(styles)
    text = within + top + math.log(sum(math.exp(x - top) for x in styles) / len(styles))
    return text + len(body) * math.log(size)


def battery_ratio(tests: Sequence[float], crowding: float) -> float:
    """Logarithm of the likelihood of the battery's p-values for ordinary text over that for uniform draws."""
    return sum(math.log(crowding) + (crowding - 1) * math.log(max(p, 1e-12)) for p in tests)


def candidates(text: str, least: int) -> Iterator[tuple[int, str]]:
    """Where each token that may be a key starts, and the token: runs of key characters without padding, and their parts.

    A run is cut at "=" (names and values of settings and URLs) and each piece is a candidate; so are the parts of a piece between "/",
    and the parts of these between other joins, since a path, a prefix or a name may stand before a key.
    """
    for m in _CANDIDATE.finditer(text):
        for piece in _VALUE.finditer(text, m.start(), m.end()):
            seen = set()
            for cut in (None, _SEGMENT, _PART):
                for part in (piece,) if cut is None else cut.finditer(text, piece.start(), piece.end()):
                    body = part.group().strip("-_/+")
                    start = part.start() + part.group().index(body)
                    if len(body) >= least and (start, len(body)) not in seen:
                        seen.add((start, len(body)))
                        yield start, body


def random_tokens(text: str, rules: RandomnessRules) -> list[Span]:
    tried: list[tuple[float, float, Span]] = []
    for start, body in candidates(text, rules.least_length):
        if body.isdigit() or not (characters := _encoding(body)):
            continue
        size = len(characters)
        log_p = text_ratio(body, size)
        if log_p + 3 * math.log(rules.crowding) < 0:  # else even the best battery is not enough
            log_p += battery_ratio(uniformity(_values(body, characters), size), rules.crowding)
        p = math.exp(min(0.0, log_p))
        tried.append((p, len(body) / rules.even_length, ("random", start, start + len(body))))
    if not tried:
        return []
    mean = sum(w for _, w, _ in tried) / len(tried)
    scale = max(1.0, mean)  # weights average at most 1: short tokens lose, long ones gain only at their cost
    ranked = sorted((p / (w / scale), s) for p, w, s in tried)
    last = max((i for i, (q, _) in enumerate(ranked, 1) if q <= rules.alpha * i / len(ranked)), default=0)
    # Of candidates inside one another the strongest stays.
    kept: list[Span] = []
    for _, span in ranked[:last]:
        at = bisect_left(kept, span[1], key=lambda s: s[1])
        if (at == 0 or kept[at - 1][2] <= span[1]) and (at == len(kept) or span[2] <= kept[at][1]):
            kept.insert(at, span)
    return kept


def secrets_in(text: str, rules: RandomnessRules = RandomnessRules()) -> tuple[list[Span], list[Span]]:
    """The spans of the fixed patterns, and all spans; both by start, then kind."""
    base: list[Span] = []
    if _KEYWORD.search(text):
        base += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    if "AKIA" in text:
        base += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    base += [("hex", *m.span()) for m in _HEX.finditer(text)]
    more = list(filter(apart_from(base), random_tokens(text, rules)))
    order = lambda s: (s[1], (*KINDS, "random").index(s[0]))
    return sorted(base, key=order), sorted(base + more, key=order)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RandomnessRules = RandomnessRules()) -> DataFrame:
    """One row per row of docs: the id, `base` spans and all `found` spans (kind, start, end)."""
    return find_spans(docs, id_col, text_col, lambda text: secrets_in(text, rules))


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return digest(scan_secrets(docs, id_col, text_col), id_col, KINDS)
