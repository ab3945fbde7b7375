"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders, so that a question with other figures or
other people keeps its template. Hashed windows of `window` template tokens of the benchmark meet those of
every document, and so do windows in which only numbers and units were replaced, for texts that are written in
other case; for each document and item that share windows the slots are then checked: one value of
the item must always have become the same value of the document. A document is contaminated by an item
if it has at least `coverage` of the item's windows with consistent slots: all that it has of the item together, or
one occurrence (a document may hold the item several times with other values each), or the verbatim windows alone.
However long the item, `run` of its words in a row with consistent slots also contaminate. How common such a run is in
the documents isn't counted: a stock phrase of that length that an item holds counts as a quote of the item.

The documents are read once a block, without a shuffle; the benchmark, a stated query set, is dealt with in blocks of
about BLOCK_CHARS characters. Tasks compute the windows of a block's items; the block is broadcast as sorted hashes with
the items that a window brings up. A window that more than COMMON items share (a preamble of all questions) brings up only
those items that such windows alone could contaminate by; the others are brought up by their rarer windows, and then all
their windows count. So what many items have in common does not pair every document with every item, and nothing is lost. Windows with fewer than `min_literals` literals
(arithmetic, tables) say too little as templates; they are compared as they stand, numbers included, and count
towards the coverage of all windows of the item, so that any verbatim copy is found. Items without tokens are never
found; items shorter than a window count as one window. Items of fewer than `least_words` words and numbers say too little to be found: they contaminate nothing and `unsearchable_items` lists them. Null and empty texts are clean. Repeated items and repeated
documents are judged each on its own. Texts of any length are read whole. Columns of other names do not matter. Empty
tables give an empty result, and an empty benchmark contaminates nothing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.word_hashes import SPACE, hash_runs, mix64, parts, random_odd, slices, windows
from marginalia.workspace import written

#: Kinds of windows: names replaced, names kept, every token kept.
KEPT, NAMED, EXACT = range(3)
BLOCK_CHARS = 16_000_000
#: Items that a window may have before it counts as common.
COMMON = 32
NUM, NAME, UNIT = (np.uint64(x) for x in (0x6E756D, 0x6E616D65, 0x756E6974))
# Units of measure and money that may follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents pound pounds meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres mile miles inch inches foot feet degree degrees".split()
_DIGIT, _UPPER, _TOKEN = (np.zeros(256, bool) for _ in range(3))
_DIGIT[48:58] = _UPPER[65:91] = True
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class TemplateRules:
    window: int = 8
    min_literals: int = 4
    least_words: int = 4
    coverage: float = 0.4
    consistent: float = 0.8
    run: int = 13


@dataclass
class Template:
    """Tokens of several texts: template hash, hash of the token itself, placeholder type (0: a literal), and owner."""

    shape: np.ndarray
    value: np.ndarray
    slot: np.ndarray
    owner: np.ndarray


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    return np.sort(hash_runs(raw, ~SPACE[raw]).hashes)


_UNIT_HASHES = _unit_hashes()


def _within(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def canonical(texts: Sequence[str | None]) -> Template:
    pieces: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.int64))]
    for joined, ends, first in slices([t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]):
        raw = np.frombuffer(joined, np.uint8)
        token, digit = _TOKEN[raw], _DIGIT[raw]
        token[1:-1] |= ((raw[1:-1] == 46) | (raw[1:-1] == 44)) & digit[:-2] & digit[2:]  # 1,234.5 is one number
        runs = hash_runs(_LOWER[raw], token)
        if not len(runs.starts):
            continue
        owner = first + np.searchsorted(ends, runs.starts, side="right")
        digits = np.concatenate([[0], np.cumsum(digit)])
        number = digits[runs.stops] > digits[runs.starts]
        stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
        opening = np.ones(len(owner), bool)  # first of its text or sentence
        opening[1:] = (owner[1:] != owner[:-1]) | (stops[runs.starts[1:]] > stops[runs.stops[:-1]])
        head = raw[runs.starts]
        second = raw[np.minimum(runs.starts + 1, len(raw) - 1)]
        capital = _UPPER[head] | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        name = capital & ~opening & ~number
        unit = ~number & ~name & _within(runs.hashes, _UNIT_HASHES)
        unit[1:] &= number[:-1] & ~opening[1:]
        unit[:1] = False
        slot = np.select([number, name, unit], [1, 2, 3], 0).astype(np.int8)
        shape = np.select([number, name, unit], [NUM, NAME, UNIT], runs.hashes)
        pieces.append((shape, runs.hashes, slot, owner))
    return Template(*(np.concatenate(x) for x in zip(*pieces, strict=True)))


@dataclass
class Benchmark:
    """Items one after the other: their tokens, and their windows with places; sorted hashes of windows with the items that they bring up; how many windows are templates, and how many there are."""

    ids: list[int]
    values: list[np.ndarray]
    slots: list[np.ndarray]
    windows: list[tuple[np.ndarray, np.ndarray, int]]
    sizes: np.ndarray
    totals: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    lengths: list[int]


@dataclass
class Indexed:
    """An item: its id, the values and slots of its tokens, the hashes and places of its windows, their length, how many places are templates, and how many there are."""

    id: int
    value: np.ndarray
    slot: np.ndarray
    hashes: np.ndarray
    places: np.ndarray
    length: int
    templates: int
    total: int


def index_item(item_id: int, text: str | None, rules: TemplateRules) -> Indexed:
    t = canonical([text])
    n = min(rules.window, len(t.shape))
    if len(t.shape) < rules.least_words:
        none = np.zeros(0, np.int64)
        return Indexed(item_id, t.value, t.slot, none.astype(np.uint64), none, 0, 0, 0)
    h, at, kind = _specific_windows(t, n, min(n, rules.min_literals))
    return Indexed(item_id, t.value, t.slot, h, at, n, len(np.unique(at[kind != EXACT])), len(np.unique(at)))


def assemble(items: Sequence[Indexed], rules: TemplateRules) -> Benchmark:
    """The block of these items."""
    hashes = np.concatenate([np.zeros(0, np.uint64), *(x.hashes for x in items)])
    item = np.repeat(np.arange(len(items)), [len(x.hashes) for x in items])
    place = np.concatenate([np.zeros(0, np.int64), *(x.places for x in items)])
    order = np.lexsort((item, hashes))
    h, k = hashes[order], item[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
    starts = np.flatnonzero(np.concatenate([[True], h[new][1:] != h[new][:-1]])) if len(h) else np.zeros(0, np.int64)
    shared = np.diff(np.append(starts, int(new.sum())))
    common = h[new][starts[shared > COMMON]]
    # Places of an item that are in common windows, and how many it takes to contaminate by them.
    is_common = _within(hashes, common)
    held = np.array([len(np.unique(p)) for p in np.split(place[is_common], np.searchsorted(item[is_common], np.arange(1, len(items))))]) if len(items) else np.zeros(0)
    templates, totals, lengths = (np.array([getattr(x, c) for x in items], np.int64) for c in ("templates", "total", "length"))
    needed = rules.coverage * np.where((templates > 0) & (4 * templates >= totals), templates, totals)
    needed = np.minimum(np.ceil(needed), np.maximum(rules.run - lengths + 1, 1))
    open_ = held >= needed
    keep = new & (~_within(h, common) | open_[k]) if len(h) else new
    return Benchmark([x.id for x in items], [x.value for x in items], [x.slot for x in items], [(x.hashes, x.places, x.length) for x in items], templates, totals, h[keep], k[keep], sorted({x.length for x in items if x.length} | {rules.window}))


def index_benchmark(ids: list[int], texts: Sequence[str | None], rules: TemplateRules) -> Benchmark:
    return assemble([index_item(i, t, rules) for i, t in zip(ids, texts, strict=True)], rules)


def _specific_windows(t: Template, n: int, literals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, places and kinds of the windows of n tokens inside one text: templates that hold enough literal tokens, the others as they stand."""
    hashes, places, kinds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
    count = len(t.shape) - n + 1
    if count <= 0:
        return hashes[0], places[0], kinds[0]
    inside = t.owner[:count] == t.owner[n - 1 :]
    is_name = t.slot == 2
    for kind in (NAMED, KEPT):
        shape, slot = (t.shape, t.slot) if kind == NAMED else (np.where(is_name, t.value, t.shape), np.where(is_name, 0, t.slot))
        held = np.concatenate([[0], np.cumsum(slot == 0)])
        at = np.flatnonzero(inside & (held[n:] - held[:-n] >= literals))
        with np.errstate(over="ignore"):
            hashes.append(mix64(windows(shape, n)[at] + np.uint64(2 * n + (kind == NAMED))))
        places.append(at)
        kinds.append(np.full(len(at), kind, np.int8))
    number = t.slot == 1
    unit = ~number & _within(t.value, _UNIT_HASHES)  # in any case of letters, so that the choice of windows does not hang on it
    unit[1:] &= number[:-1] & (t.owner[1:] == t.owner[:-1])
    unit[:1] = False
    held = np.concatenate([[0], np.cumsum(~number & ~unit)])
    at = np.flatnonzero(inside & (held[n:] - held[:-n] < literals))
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j, r in enumerate(random_odd(n, stream=n)):
            out += t.value[at + j] * r
        hashes.append(mix64(mix64(out) + np.uint64(1 << 40)))
    places.append(at)
    kinds.append(np.full(len(at), EXACT, np.int8))
    return np.concatenate(hashes), np.concatenate(places), np.concatenate(kinds)


#: Place in the document and in the item, tokens of the window, and its kind.
Hit = tuple[int, int, int, int]


def candidates(t: Template, bench: Benchmark, rules: TemplateRules) -> Iterator[tuple[int, int, list[Hit]]]:
    """Text, item and all windows that they share, for the pairs that a window brings up."""
    for n in bench.lengths:
        h, at, kind = _specific_windows(t, n, min(n, rules.min_literals))
        hit = np.flatnonzero(_within(h, bench.hashes))
        if not len(hit):
            continue
        low, high = np.searchsorted(bench.hashes, h[hit], "left"), np.searchsorted(bench.hashes, h[hit], "right")
        which = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(int((high - low).sum()))
        pairs = np.unique(np.column_stack([np.repeat(t.owner[at[hit]], high - low), bench.item[which]]), axis=0)
        order = np.lexsort((h, t.owner[at]))
        h, at, kind = h[order], at[order], kind[order]
        edges = np.searchsorted(t.owner[at], np.arange(int(t.owner[-1]) + 2))
        for doc, item in pairs.tolist():
            hashes, places, length = bench.windows[item]
            if length != n:
                continue
            a, b = edges[doc], edges[doc + 1]
            first, last = a + np.searchsorted(h[a:b], hashes, "left"), a + np.searchsorted(h[a:b], hashes, "right")
            hits = [(int(at[i]), int(q), n, int(kind[i])) for x, y, q in zip(first.tolist(), last.tolist(), places.tolist(), strict=True) for i in range(x, y)]
            yield doc, item, hits


def matches(texts: Sequence[str | None], bench: Benchmark, rules: TemplateRules) -> list[tuple[int, int, int, int, float]]:
    """(index of the text, index of the item, windows of the item found, values changed, consistent share) of the contaminated."""
    t = canonical(texts)
    out = []
    for doc, item, hits in candidates(t, bench, rules):
        if (verdict := _judged(hits, t, bench, item, rules)) is not None:
            out.append((doc, item, *verdict))
    return sorted(out)


def _judged(hits: list[Hit], t: Template, bench: Benchmark, item: int, rules: TemplateRules) -> tuple[int, int, float] | None:
    """Windows found, values changed and consistent share: of all hits if these contaminate, else of the largest part that does."""
    value, slot = bench.values[item], bench.slots[item]

    def enough(some: list[Hit]) -> bool:
        """Of the windows that are templates, where these are a quarter of all at least, or of all windows."""
        templates = len({q for _, q, _, kind in some if kind != EXACT})
        return 4 * bench.sizes[item] >= bench.totals[item] and 0 < templates >= rules.coverage * bench.sizes[item] or len({q for _, q, _, _ in some}) >= rules.coverage * bench.totals[item]

    def weighed(some: list[Hit]) -> tuple[int, int, float] | None:
        covered = len({q for _, q, _, _ in some})
        pairs = {(p + j, q + j) for p, q, n, kind in some for j in range(n) if slot[q + j] and (kind == NAMED or slot[q + j] != 2)}
        became: dict[tuple[int, int], Counter] = defaultdict(Counter)
        for p, q in pairs:
            became[int(slot[q]), int(value[q])][int(t.value[p])] += 1
        same = sum(max(c.values()) for c in became.values())
        share = same / len(pairs) if pairs else 1.0
        return (covered, sum(k[1] not in c for k, c in became.items()), share) if share >= rules.consistent else None

    whole = enough(hits)
    if whole and (verdict := weighed(hits)) is not None:
        return verdict
    if not whole and len({q for _, q, _, _ in hits}) + hits[0][2] - 1 < rules.run:
        return None
    verbatim = [h for h in hits if (t.value[h[0] : h[0] + h[2]] == value[h[1] : h[1] + h[2]]).all()]
    parts_ = [some for some in (*_occurrences(hits), verbatim) if enough(some)] + _runs(hits, rules.run) + _runs(verbatim, rules.run)
    passed = [x for some in parts_ if (x := weighed(some)) is not None]
    return max(passed, key=lambda x: (x[0], x[2]), default=None)


def _occurrences(hits: list[Hit]) -> list[list[Hit]]:
    """Hits by place of the item in the document, by places so near that a few words were put in or left out, and by such groups that follow one another as in the item."""
    by_place: dict[int, list[Hit]] = defaultdict(list)
    for h in hits:
        by_place[h[0] - h[1]].append(h)
    near: list[list[Hit]] = []
    last = None
    for d in sorted(by_place):
        if last is not None and d - last <= hits[0][2] // 2:
            near[-1] += by_place[d]
        else:
            near.append(list(by_place[d]))
        last = d
    # Each group goes on with the chain that stopped last before it; `stops` is in order, chains stand beside it.
    stops: list[int] = []
    chains: list[list[Hit]] = []
    for group in sorted(near, key=min):
        first, stop = min(q for _, q, _, _ in group), max(q for _, q, _, _ in group)
        at = bisect_left(stops, first) - 1
        chain = []
        if at >= 0:
            del stops[at]
            chain = chains.pop(at)
        chain += group
        at = bisect_right(stops, stop)
        stops.insert(at, stop)
        chains.insert(at, chain)
    return [*by_place.values(), *near, *chains]


def _runs(hits: list[Hit], words: int) -> list[list[Hit]]:
    """Hits by unbroken stretches of at least so many words of the item in the document."""
    stretches: list[list[Hit]] = []
    for h in sorted(hits, key=lambda h: (h[0] - h[1], h[1])):
        before = stretches[-1][-1] if stretches else None
        if before and h[0] - h[1] == before[0] - before[1] and h[1] <= before[1] + 1:
            stretches[-1].append(h)
        else:
            stretches.append([h])
    return [x for x in stretches if x[-1][1] - x[0][1] + x[0][2] >= words]


_ITEMS = "id bigint, value binary, slot binary, hashes binary, places binary, length bigint, templates bigint, total bigint"


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, rules: TemplateRules) -> Iterator[Benchmark]:
    """The benchmark in blocks of bounded size; tasks compute its windows."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.length("text")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    blocks = 1 + ((size["n"] or 0) + 64 * size["rows"]) // BLOCK_CHARS

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, 1):
                items = [index_item(i, text, rules) for i, text in zip(part.column(0).to_pylist(), texts, strict=True)]
                arrays = [pa.array([getattr(x, c).tobytes() for x in items], pa.binary()) for c in ("value", "slot", "hashes", "places")]
                numbers = [pa.array([getattr(x, c) for x in items], pa.int64()) for c in ("length", "templates", "total")]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays, *numbers], names=["id", "value", "slot", "hashes", "places", "length", "templates", "total"])

    indexed = rows.mapInArrow(index, _ITEMS).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    if blocks > 1:
        indexed = written(indexed, "benchmark-items")
    for k in range(blocks):
        got = indexed.where(F.col("block") == k).drop("block").toArrow().sort_by([("id", "ascending"), ("value", "ascending")]).to_pylist()
        read = lambda raw, kind: np.frombuffer(raw, kind)
        yield assemble([Indexed(r["id"], read(r["value"], np.uint64), read(r["slot"], np.int8), read(r["hashes"], np.uint64), read(r["places"], np.int64), r["length"], r["templates"], r["total"]) for r in got], rules)


def unsearchable_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", rules: TemplateRules = TemplateRules()) -> DataFrame:
    """The items that are too short to be searched for: id and number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, 1):
                words = [len(canonical([text]).shape) for text in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64())], names=[id_col, "words"])

    rows = benchmark.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text"))
    return rows.mapInArrow(count, f"`{id_col}` bigint, words bigint").where(F.col("words") < rules.least_words)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rules: TemplateRules = TemplateRules()
) -> DataFrame:
    """A row per contaminated document and item: windows found of the item's, slot values changed, consistent share."""
    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text"))
    schema = f"`{id_col}` bigint, `{item_col}` bigint, windows_found bigint, item_windows bigint, values_changed bigint, consistent double"
    out = None
    for bench in benchmark_blocks(benchmark, item_col, item_text, rules):
        shared = docs.sparkSession.sparkContext.broadcast(bench)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for part, texts in parts(batch, 1):
                    hits = matches(texts, index, rules)
                    ids = part.column(0).to_pylist()
                    rows = [(ids[d], index.ids[i], n, int(index.totals[i]), c, s) for d, i, n, c, s in hits]
                    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
                    kinds = [pa.int64()] * 5 + [pa.float64()]
                    names = [id_col, item_col, "windows_found", "item_windows", "values_changed", "consistent"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        found = source.mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rules: TemplateRules = TemplateRules()) -> DataFrame:
    """The rows of docs, with all their columns, that no item contaminates."""
    columns, at = docs.columns, docs.columns.index(text_col)
    out = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    for bench in benchmark_blocks(benchmark, item_col, item_text, rules):
        shared = docs.sparkSession.sparkContext.broadcast(bench)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in parts(batch, at):
                    keep = np.ones(len(texts), bool)
                    keep[[d for d, *_ in matches(texts, shared.value, rules)]] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(clean, out.schema)
    return out.toDF(*columns)
