"""Edits of styled paragraphs: runs with offsets, spans back to runs, and edits that don't overlap.

A paragraph is an array of runs (text, italic); a run without text (null) is a placeholder of one character, a note reference or a thing
that isn't text. Offsets count code points of the paragraph's text with placeholders.

Edits (start, end, replacement, italic) replace text, or set the style where replacement is null. From the right to the left one is taken
if it ends by the start of the last one taken (equal starts: the first given); edits that hold a placeholder, lie outside the text, are
empty, or change no style are passed over. So edits of any order give one text. New text has the style of the first character that
it replaces; offsets of what was taken are given in the new text too, by a prefix sum over the changes of length.

All are column expressions over one paragraph a row; a null paragraph or null edits count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.richtext import RUNS

EDIT = "struct<start:int,end:int,replacement:string,italic:boolean>"
PLACEHOLDER = "￼"
_PLACED = "array<struct<run:int,text:string,italic:boolean,start:int,end:int>>"


def placed(runs: Column) -> Column:
    """Runs with their number and offsets; placeholders stand as one character with a null text."""

    def step(state: Column, r: Column) -> Column:
        end = state["at"] + F.coalesce(F.length(r["text"]), F.lit(1))
        row = F.struct(F.size(state["out"]).alias("run"), r["text"].alias("text"), F.coalesce(r["italic"], F.lit(False)).alias("italic"), state["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(row)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_PLACED).alias("out"))
    return F.aggregate(F.coalesce(runs, F.array().cast(RUNS)), start, step, lambda s: s["out"])


def flattened(paragraphs: DataFrame, keys: list[str], runs: str = "runs") -> DataFrame:
    """A row for each run: the keys, run, text (null: placeholder), italic, start, end. No shuffle."""
    return paragraphs.select(*keys, F.explode(placed(F.col(runs))).alias("_r")).select(*keys, "_r.*")


def paragraph_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], F.lit(PLACEHOLDER))), "")


def runs_of(at: Column, start: Column, end: Column) -> Column:
    """Of placed runs the parts inside a span: run, and where in the run's own text."""
    inside = F.filter(at, lambda r: (r["start"] < end) & (r["end"] > start))
    return F.transform(inside, lambda r: F.struct(r["run"].alias("run"), (F.greatest(r["start"], start) - r["start"]).alias("from"), (F.least(r["end"], end) - r["start"]).alias("to")))


def accepted(at: Column, edits: Column) -> Column:
    """The edits that are made, from left to right."""
    length = F.coalesce(F.try_element_at(at, F.lit(-1))["end"], F.lit(0))

    def makes_sense(e: Column) -> Column:
        touched = lambda r: (r["start"] < e["end"]) & (r["end"] > e["start"])
        whole = (e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= length) & ~F.exists(at, lambda r: touched(r) & r["text"].isNull())
        return whole & (e["replacement"].isNotNull() | F.exists(at, lambda r: touched(r) & (r["italic"] != F.coalesce(e["italic"], F.lit(False)))))

    given = F.coalesce(edits, F.array().cast(f"array<{EDIT}>"))
    numbered = F.transform(given, lambda e, i: F.struct((-e["start"]).alias("key"), i.alias("i"), e.alias("e")))
    ordered = F.transform(F.array_sort(numbered), lambda x: x["e"])

    def step(state: Column, e: Column) -> Column:
        taken = makes_sense(e) & (e["end"] <= state["limit"])
        return F.when(F.coalesce(taken, F.lit(False)), F.struct(e["start"].alias("limit"), F.concat(F.array(e), state["out"]).alias("out"))).otherwise(state)

    start = F.struct(F.lit(2**31 - 1).alias("limit"), F.array().cast(f"array<{EDIT}>").alias("out"))
    return F.aggregate(ordered, start, step, lambda s: s["out"])


def _cut(at: Column, start: Column, end: Column) -> Column:
    """Runs between two offsets, with their styles; placeholders whole."""
    inside = F.filter(at, lambda r: (r["start"] < end) & (r["end"] > start))
    part = lambda r: F.substr(r["text"], F.greatest(start - r["start"], F.lit(0)) + 1, F.least(r["end"], end) - F.greatest(r["start"], start))
    return F.transform(inside, lambda r: F.struct(part(r).alias("text"), r["italic"].alias("italic")))


def edited(at: Column, made: Column) -> Column:
    """The runs after edits that `accepted` gave."""
    length = F.coalesce(F.try_element_at(at, F.lit(-1))["end"], F.lit(0))

    def step(state: Column, e: Column) -> Column:
        old = _cut(at, e["start"], e["end"])
        style = F.coalesce(F.element_at(old, 1)["italic"], F.lit(False))
        fresh = F.array(F.struct(e["replacement"].alias("text"), style.alias("italic")))
        turned = F.transform(old, lambda r: F.struct(r["text"].alias("text"), F.coalesce(e["italic"], F.lit(False)).alias("italic")))
        return F.struct(e["end"].alias("at"), F.concat(state["out"], _cut(at, state["at"], e["start"]), F.when(e["replacement"].isNotNull(), fresh).otherwise(turned)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(RUNS).alias("out"))
    out = F.aggregate(made, start, step, lambda s: F.concat(s["out"], _cut(at, s["at"], length)))
    return F.filter(out, lambda r: r["text"].isNull() | (r["text"] != ""))


def shifted(made: Column) -> Column:
    """Where the edits stand in the new text: start and end behind the changes of length before them."""

    def step(state: Column, e: Column) -> Column:
        size = F.coalesce(F.length(e["replacement"]), e["end"] - e["start"])
        row = F.struct((e["start"] + state["by"]).alias("start"), (e["start"] + state["by"] + size).alias("end"))
        return F.struct((state["by"] + size - (e["end"] - e["start"])).alias("by"), F.concat(state["out"], F.array(row)).alias("out"))

    start = F.struct(F.lit(0).alias("by"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(made, start, step, lambda s: s["out"])


def apply_edits(paragraphs: DataFrame, runs: str = "runs", edits: str = "edits") -> DataFrame:
    """Adds `made` (edits taken, from left to right), `new_runs` and `made_at` (their spans in the new text). No shuffle."""
    with_runs = paragraphs.withColumn("_at", placed(F.col(runs)))
    with_made = with_runs.withColumn("made", accepted(F.col("_at"), F.col(edits)))
    return with_made.withColumns({"new_runs": edited(F.col("_at"), F.col("made")), "made_at": shifted(F.col("made"))}).drop("_at")
