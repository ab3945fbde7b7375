"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths (numpy, all texts of an Arrow batch together) mark every word
that lies in an n-gram found twice or more in its text; the share of the text's word characters so
covered, and the share in repeated lines, decide. No shuffle: one pass over (id, text).

Null and empty texts have no words and fail the base rule. Repeated rows are judged each on its own;
nothing depends on the order of rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.word_hashes import parts, windows, words_of

_BLANK = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class RepetitionRules:
    """Limits of the base rule and of the method: the largest share of word characters in repeated n-grams or lines."""

    min_words: int = 10
    max_repeat_percent: int = 20
    ngram_limits: tuple[tuple[int, float], ...] = ((3, 0.55), (5, 0.30), (7, 0.25), (10, 0.22))
    max_dup_line_chars: float = 0.40


def _covered(words, n: int) -> np.ndarray:
    """For each word: is it in an n-word window that its text has twice or more?"""
    h = windows(words.hashes, n)
    covered = np.zeros(len(words.hashes) + 1, np.int32)
    if len(h):
        at = np.flatnonzero(words.owner[: len(h)] == words.owner[n - 1 :])
        with np.errstate(over="ignore"):
            key = h[at] ^ ((words.owner[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        found = at[order[twice]]
        np.add.at(covered, found, 1)
        np.add.at(covered, found + n, -1)
    return np.cumsum(covered[:-1]) > 0


def _repeated_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the characters of their words."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0, 0
    seen: set[str] = set()
    n = chars = 0
    for line in lines:
        if line in seen:
            n += 1
            chars += sum(map(len, line.translate(_TO_SPACE).split(" ")))
        elif line.strip(_BLANK):
            seen.add(line)
    return n, chars


_TO_SPACE = {ord(c): " " for c in _BLANK}


def _measure(texts: list[str | None], rules: RepetitionRules) -> dict[str, np.ndarray]:
    words = words_of(texts, chars=True)
    count = lambda w: np.bincount(words.owner, weights=w, minlength=len(texts)).astype(np.int64)
    out = {"n_words": count(np.ones(len(words.owner))), "word_chars": count(words.chars)}
    out["n_symbols"] = np.array([sum(map(t.count, _SYMBOLS)) if t else 0 for t in texts], np.int64)
    lines = np.array([_repeated_lines(t) if t else (0, 0) for t in texts], np.int64).reshape(-1, 2)
    out["n_dup_lines"] = lines[:, 0]
    chars = np.maximum(out["word_chars"], 1)
    good = lines[:, 1] <= rules.max_dup_line_chars * chars
    for n, most in rules.ngram_limits:
        covered = _covered(words, n)
        in_ngrams = count(words.chars * covered)
        out[f"chars_in_dup_{n}grams"] = in_ngrams
        good &= in_ngrams <= most * chars
        if n == 5:
            out["n_repeat_words"] = count(covered)
    if "n_repeat_words" not in out:
        out["n_repeat_words"] = count(_covered(words, 5))
    out["dup_line_chars"] = lines[:, 1]
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"])
    out["kept"] = ~out["base_failed"] & good
    return out


def repetition_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row per row of docs: the id, the counts, the characters in repeated n-grams and lines, and the verdict."""
    grams = [f"chars_in_dup_{n}grams" for n, _ in rules.ngram_limits]
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *grams]
    flags = ["base_failed", "kept"]
    source = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, 1):
                m = _measure(texts, rules)
                columns = [part.column(0), *(pa.array(m[c]) for c in [*longs, *flags])]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *longs, *flags])

    kind = source.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} bigint" for c in longs) + ", " + ", ".join(f"{c} boolean" for c in flags)
    return source.mapInArrow(measure, schema)


def keep_by_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep. The verdict is computed beside the row, without a join."""
    columns, at = docs.columns, docs.columns.index(text_col)
    positional = docs.toDF(*[f"c{i}" for i in range(len(columns))])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, at):
                yield part.filter(pa.array(_measure(texts, rules)["kept"]))

    return positional.mapInArrow(kept, positional.schema).toDF(*columns)
