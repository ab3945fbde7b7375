"""Main text of web pages by two passes of block rules.

The markup is cut into blocks at block-level tags. Pass one classifies each block by its link density, its length and its
density of stop words: good, bad, or ambiguous (short, a heading, of middling length or density). What stands in a menu, a
footer and the like (by element, or by class, id and role) is bad. In pass two an ambiguous block inherits the label of
the nearest decided block, where a block of another box (element that holds blocks) counts as `apart` blocks farther;
a heading inherits from what follows it. Of two as near the bad one wins, unless the block's own density speaks
for it. Where no block is good, the blocks of the box that holds most text are judged together.

An article element is a prior: if the densities find more good text outside it than `unlike` times what it holds, it is
ignored; else blocks outside it are bad, those inside it can only be bad for what they are (chrome, lists of links) or
by their neighbours inside, and are good where nothing near is decided. On a page in whose text hardly any stop word is
found (another language) length and link density decide alone.

Scripts, styles and other text that isn't shown are skipped. Character references are decoded, white space inside a
block (line breaks too) becomes one space, blocks are joined by line feeds. Null and empty pages give an empty text,
truncated markup counts up to its end, repeated rows are judged alike, and a page of any length is read whole in time
that grows with its length. No shuffle: one pass, page by page. Other columns of the table are not used.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'"<>])*+)(?:>|(?=<)|\Z)|<[/A-Za-z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?ai)\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# HTML elements by their part in the layout.
_BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_HIDDEN = frozenset("script style noscript template head title textarea select iframe svg math object audio video canvas map datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CHROME = frozenset("nav footer aside form menu dialog button".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_CONTENT = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of lists and tables; their box is the list or table.
_ITEMS = frozenset("li dt dd tr td th tbody thead tfoot caption".split())
# Words of class and id names that mark what isn't the article.
_CHROME_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus discussion replies respond share sharing social related recommended pagination pager widget copyright legal skip search".split())
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he in is it its not of on or that the this they to was were which who will with you "
    "au aux avec ce cette dans de des du elle en est et il la le les mais ne on ou par pas pour que qui se son sur un une "
    "als am auch auf aus bei das dem den der des die du ein eine er es für hat ich im ist mit nicht sich sie sind und von war wie zu "
    "al como con del el era es lo los las más no para pero por se si sin su sus y".split()
)


@dataclass(frozen=True)
class BlockRules:
    """Lengths in characters; densities as shares."""

    short: int = 70
    long: int = 200
    max_links: float = 0.33
    stop_low: float = 0.15
    stop_high: float = 0.30
    apart: int = 4
    link_items: int = 3
    unlike: float = 4.0


@dataclass
class Block:
    text: str
    links: float
    chrome: bool
    content: bool
    heading: bool
    box: int = 0
    item: bool = False


def _is_chrome(name: str, attrs: str) -> bool:
    if name in _CHROME:
        return True
    if name in ("html", "body", "main") or not attrs:
        return False
    for key, value in _ATTR.findall(attrs):
        value, key = value.strip("\"'"), key.lower()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if key in ("class", "id") and any(w.lower() in _CHROME_WORDS for w in _CAMEL.findall(value)):
            return True
    return False


def blocks_of(page: str) -> tuple[list[Block], bool]:
    """The blocks of a page in order, and whether it marks an article."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # open elements: name; is it or what holds it chrome; content; box
    boxes = 0
    unclosed: set[str] = set()
    opened: Counter[str] = Counter()
    parts: list[str] = []
    link_chars = chars = anchors = 0
    marked = heading = False
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal parts, link_chars, chars
        text = " ".join("".join(parts).split())
        if text:
            name, chrome, content, box = stack[-1] if stack else ("", False, False, 0)
            out.append(Block(text, link_chars / chars if chars else 0.0, chrome, content, heading, box, name in _ITEMS))
        parts, link_chars, chars = [], 0, 0

    def push(name: str, chrome: bool, content: bool) -> None:
        nonlocal boxes
        _, above_chrome, above_content, box = stack[-1] if stack else ("", False, False, 0)
        if name not in _ITEMS and name != "span":
            boxes += 1
            box = boxes
        stack.append((name, chrome or above_chrome, content or above_content, box))
        opened[name] += 1

    def add(raw: str) -> None:
        nonlocal link_chars, chars
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        size = len(text) - text.count(" ")
        chars += size
        link_chars += size if anchors else 0

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end() if m.end() > m.start() else m.start() + 1
        if m.group("cdata"):
            add(m.group("cdata"))
        if not m.group("name"):
            continue
        name, closing = m.group("name").lower(), bool(m.group("close"))
        if name in _HIDDEN and not closing and not m.group("attrs").endswith("/"):
            end = None if name in unclosed else re.compile(rf"(?ai)</{re.escape(name)}\b[^>]*>").search(page, at)
            if end:
                at = end.end()
            elif name not in ("head", "svg", "math", "object", "map"):
                at = n
            else:
                unclosed.add(name)
            if name == "title" or name == "head":
                flush()
        elif name == "a":
            anchors = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        elif name in _BLOCKS or name in ("span", "ins", "amp-ad"):
            chrome = not closing and _is_chrome(name, m.group("attrs"))
            if name not in _BLOCKS and not chrome and not (closing and opened[name]):
                if not closing and opened[name]:
                    push(name, False, False)
                continue
            flush()
            if closing:
                heading = False
                while opened[name]:
                    gone = stack.pop()[0]
                    opened[gone] -= 1
                    if gone == name:
                        break
            else:
                in_content = bool(stack) and stack[-1][2]
                anchors = 0 if name in _CONTENT else anchors
                heading = name in _HEADINGS
                if name in _CONTENT and not chrome:
                    if stack and stack[-1][1] and not in_content:  # an article ends whatever was left open
                        stack.clear()
                        opened.clear()
                    marked = True
                    push(name, False, True)
                elif name == "header" and not in_content:
                    push(name, True, False)
                elif name not in _VOID and (chrome or name != "p" and not heading):
                    push(name, chrome, False)
        # other elements are inline: nothing between their text and its neighbours
    flush()
    return out, marked


_WORD = re.compile(r"[^\W\d_]+")


def stop_words(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = _WORD.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)), len(words)


GOOD, BAD, AMBIGUOUS = "good", "bad", "ambiguous"


def density(count: tuple[int, int]) -> float:
    return count[0] / count[1] if count[1] else 0.0


def surely_sparse(count: tuple[int, int], rules: BlockRules) -> bool:
    """Fewer stop words than stop_low asks for, by two deviations."""
    stops, n = count
    return stops + 2 * math.sqrt(stops) + 2 < rules.stop_low * n


def first_pass(blocks: Sequence[Block], counts: Sequence[tuple[int, int]], inside: bool, rules: BlockRules, known_language: bool = True) -> list[str]:
    """A label for each block by itself. inside: blocks of an article, against which a low density of stop words does not speak."""
    lists = Counter(b.box for b in blocks if b.item and b.links > rules.max_links)
    out = []
    for b, count in zip(blocks, counts, strict=True):
        d = density(count)
        if b.chrome:
            label = BAD
        elif b.links > rules.max_links:
            label = AMBIGUOUS if b.heading or inside and not (b.item and lists[b.box] >= rules.link_items) else BAD
        elif b.heading or len(b.text) < rules.short:
            label = AMBIGUOUS
        elif (not known_language or d >= rules.stop_low) and (inside or len(b.text) > rules.long):
            label = GOOD
        else:
            label = BAD if known_language and surely_sparse(count, rules) and len(b.text) > rules.long and not inside else AMBIGUOUS
        out.append(label)
    return out


def second_pass(blocks: Sequence[Block], counts: Sequence[tuple[int, int]], first: Sequence[str], inside: bool, rules: BlockRules) -> list[str]:
    """Labels without ambiguous ones: each of these takes that of the nearest decided block."""
    n = len(blocks)
    near: list[list[tuple[int, str]]] = [[] for _ in range(n)]
    for order in (range(n), range(n - 1, -1, -1)):
        # The last decided block of all, and of each box: no other one of that side can be nearer.
        last: int | None = None
        by_box: dict[int, int] = {}
        for i in order:
            b = blocks[i]
            if first[i] != AMBIGUOUS:
                last = by_box[b.box] = i
            elif not (b.heading and order.step > 0):  # a heading looks ahead only
                if b.box in by_box:
                    near[i].append((abs(by_box[b.box] - i), first[by_box[b.box]]))
                if last is not None and blocks[last].box != b.box:
                    near[i].append((abs(last - i) + rules.apart, first[last]))
    out = []
    for i, label in enumerate(first):
        if label == AMBIGUOUS:
            likely = density(counts[i]) >= rules.stop_high and len(blocks[i].text) >= rules.short
            fallback = GOOD if inside or likely else BAD
            label = min(near[i], key=lambda x: (x[0], x[1] == (BAD if likely else GOOD)))[1] if near[i] else fallback
        out.append(label)
    return out


def _fullest_box(blocks: Sequence[Block], counts: Sequence[tuple[int, int]], first: Sequence[str], rules: BlockRules, known_language: bool) -> list[str]:
    """Without a good block: those of the box that holds most text are judged together, good if they are long or have enough stop words."""
    size: Counter[int] = Counter()
    plain = [not b.chrome and b.links <= rules.max_links for b in blocks]
    for b, mine in zip(blocks, plain, strict=True):
        size[b.box] += len(b.text) if mine else 0
    box = max(size, key=lambda k: (size[k], -k), default=None)
    which = [i for i, b in enumerate(blocks) if b.box == box and plain[i]]
    together = density((sum(counts[i][0] for i in which), sum(counts[i][1] for i in which)))
    out = list(first)
    if which and size[box] >= rules.short and (size[box] > rules.long or not known_language or together >= rules.stop_low):
        for i in which:
            out[i] = GOOD
    return out


def labels_of(blocks: Sequence[Block], marked: bool, rules: BlockRules = BlockRules()) -> list[bool]:
    """Which blocks are main text. marked: does the page mark an article."""
    counts = [(0, 0) if b.chrome else stop_words(b.text) for b in blocks]
    plain_text = [c for b, c in zip(blocks, counts, strict=True) if b.links <= rules.max_links]
    known_language = sum(x for x, _ in plain_text) >= 0.03 * sum(n for _, n in plain_text)

    def judged(which: list[int], inside: bool) -> list[str]:
        some, of_some = [blocks[i] for i in which], [counts[i] for i in which]
        first = first_pass(some, of_some, inside, rules, known_language)
        if not inside and GOOD not in first:
            first = _fullest_box(some, of_some, first, rules, known_language)
        return second_pass(some, of_some, first, inside, rules)

    labels = judged(list(range(len(blocks))), inside=False)
    if marked:
        article = [i for i, b in enumerate(blocks) if b.content]
        held = sum(len(blocks[i].text) for i in article if not blocks[i].chrome)
        outside = sum(len(b.text) for b, label in zip(blocks, labels, strict=True) if label == GOOD and not b.content)
        if article and outside <= rules.unlike * held:
            labels = [BAD] * len(blocks)
            for i, label in zip(article, judged(article, inside=True), strict=True):
                labels[i] = label
    return [label == GOOD for label in labels]


def main_text(page: str | None, rules: BlockRules = BlockRules()) -> str:
    if not page:
        return ""
    blocks, marked = blocks_of(page)
    return "\n".join(b.text for b, good in zip(blocks, labels_of(blocks, marked, rules), strict=True) if good)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: BlockRules = BlockRules()) -> DataFrame:
    """One row per page: id, url, text and n_chars, its code points."""
    source = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias(url_col), F.col(html_col).alias("_html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), rules) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, url_col, "text", "n_chars"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:2]]
    return source.mapInArrow(extract, f"{', '.join(kinds)}, text string, n_chars bigint")
