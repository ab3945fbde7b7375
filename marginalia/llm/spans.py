"""A scan of whole texts for spans: one pass, no shuffle; what is found is decided by a function on one text."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: kind, start, end in code points, end exclusive.
Span = tuple[str, int, int]
SPAN_FIELDS = "array<struct<kind:string,start:bigint,`end`:bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_spans(docs: DataFrame, id_col: str, text_col: str, find: Callable[[str], tuple[Sequence[Span], Sequence[Span]]]) -> DataFrame:
    """One row per row of docs: the id, `base` and `found` (all spans), both in the order that `find` gives them."""
    source = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))
    none: tuple[list[Span], list[Span]] = ([], [])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            base, found = [], []
            for text in batch.column(1):
                x, y = find(text.as_py()) if text.is_valid else none
                base.append(rows(x))
                found.append(rows(y))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _SPAN_TYPE), pa.array(found, _SPAN_TYPE)], names=[id_col, "base", "found"])

    return source.mapInArrow(scan, f"`{id_col}` {source.schema[0].dataType.simpleString()}, base {SPAN_FIELDS}, found {SPAN_FIELDS}")


def joined(spans: str):
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str, kinds: Sequence[str]) -> DataFrame:
    """Counts of the base spans by kind, the SHA-256 of the base spans and all spans as text."""
    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    return found.select(id_col, *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"))


def sha256_of(spans: Sequence[Span]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def apart_from(others: Sequence[Span]) -> Callable[[Span], bool]:
    """A test of whether a span overlaps none of the others; each call takes logarithmic time."""
    order = sorted((a, b) for _, a, b in others)
    starts, reach = [a for a, _ in order], list(accumulate((b for _, b in order), max))

    def apart(span: Span) -> bool:
        before = bisect_left(starts, span[2])  # others that start before the span's end
        return not before or reach[before - 1] <= span[1]

    return apart
