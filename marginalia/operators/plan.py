"""How each mention of a source is written: in full, as a repeat of the mention just before, or as a later mention.

Rows are mentions (doc, note, position, key, pinpoint). The frame of notes must hold the notes without
mentions too: they break a chain of repeats. Everything is window functions over a document and its parts: mentions
are dealt once, by doc.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def citation_plan(notes: DataFrame, mentions: DataFrame, doc: str = "doc", note: str = "note", order: list[str | Column] | None = None) -> DataFrame:
    """Adds `plan` (full, ibid, subsequent), `pos` in the note, `occurrence` of the key in the doc, and `suffix` for a repeat.

    mentions: doc, note, key, pinpoint ('' for none) and the columns of `order`, which must order the mentions of a note fully.
    """
    order = order or ["seg"]
    # Notes stand among the mentions as rows of their own, so that a note's place and what the note before has are windows over the document.
    rows = mentions.withColumn("_said", F.lit(True)).unionByName(notes.select(doc, note, F.lit(False).alias("_said")), allowMissingColumns=True)
    before = W.partitionBy(doc).orderBy("_nth").rangeBetween(-1, -1)
    rows = rows.withColumn("_nth", F.dense_rank().over(W.partitionBy(doc).orderBy(note)))
    rows = rows.withColumns({"prev_n": F.count_if("_said").over(before), "prev_key": F.min("key").over(before), "prev_pin": F.min("pinpoint").over(before)}).where("_said")
    in_note = W.partitionBy(doc, note).orderBy(*order)
    of_key = W.partitionBy(doc, "key").orderBy(note, *order)
    placed = rows.withColumn("pos", F.row_number().over(in_note)).withColumn("occurrence", F.row_number().over(of_key))
    repeat = (
        (F.col("pos") == 1)
        & (F.col("prev_n") == 1)
        & (F.col("prev_key") == F.col("key"))
        & ~((F.col("pinpoint") == "") & (F.col("prev_pin") != ""))
    )
    plan = F.when(F.col("occurrence") == 1, "full").when(repeat, "ibid").otherwise("subsequent")
    planned = placed.withColumn("plan", plan)
    suffix = F.when((F.col("plan") == "ibid") & (F.col("pinpoint") != F.col("prev_pin")), F.col("pinpoint")).otherwise("")
    return planned.withColumn("suffix", suffix).drop("prev_n", "prev_key", "prev_pin", "_said", "_nth")


def first_per_key(mentions: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """The first mention of each key in a document: map-side combined, no sort of the mentions."""
    others = [c for c in mentions.columns if c not in (doc, "key")]
    return mentions.groupBy(doc, "key").agg(F.min_by(F.struct(*others), F.struct(*order)).alias("first")).select(doc, "key", "first.*")


def rendered_notes(planned: DataFrame, sources: DataFrame | None = None, doc: str = "doc", note: str = "note") -> DataFrame:
    """doc, note, text: the notes of documents as they are printed.

    planned: of citation_plan, and `signal` ('' for none). sources: doc, key, cited (in full, without a pinpoint), short; without it, planned has these columns.
    A source that is referred back to defines its short title where it is cited in full; repeats are Ibid at the start of a
    note and after a signal ibid; citations are parted by semicolons, and a note ends with one full stop before its trailing white space."""
    # Of a window and not of a join, so that the plan of all mentions is made once.
    of_key = W.partitionBy(doc, "key")
    first = {"first_note": F.min(F.when(F.col("plan") == "full", F.col(note))).over(of_key), "defines": F.bool_or(F.col("plan") == "subsequent").over(of_key)}
    rows = planned.where(F.col(doc).isNotNull() & F.col("key").isNotNull()).withColumns(first)
    if sources is not None:
        rows = rows.join(sources, [doc, "key"])
    pin = F.when(F.col("pinpoint") == "", "").otherwise(F.concat(F.lit(", "), F.col("pinpoint")))
    spaced = lambda c: F.when(F.col(c) == "", "").otherwise(F.concat(F.lit(" "), F.col(c)))
    lead = F.when(F.col("signal") == "", "").otherwise(F.concat(F.col("signal"), F.lit(" ")))
    full = F.concat("cited", pin, F.when(F.col("defines"), F.concat(F.lit(" (‘"), F.col("short"), F.lit("’)"))).otherwise(""))
    again = F.concat("short", F.lit(" (n "), F.col("first_note").cast("string"), F.lit(")"), spaced("pinpoint"))
    ibid = F.concat(F.when((F.col("pos") == 1) & (F.col("signal") == ""), "Ibid").otherwise("ibid"), spaced("suffix"))
    text = F.concat(lead, F.when(F.col("plan") == "full", full).when(F.col("plan") == "ibid", ibid).otherwise(again))
    parts = rows.groupBy(doc, note).agg(F.array_sort(F.collect_list(F.struct("pos", text.alias("text")))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "; ")
    return parts.select(doc, note, F.regexp_replace(joined, r"[.]?([ \t\n]*)$", ".$1").alias("text"))
