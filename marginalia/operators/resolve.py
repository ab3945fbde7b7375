"""Back references to what they mean, by window functions over a document's mentions; no mention is paired with another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def earliest_named(mentions: DataFrame, doc: str = "doc", note: str = "note") -> DataFrame:
    """mentions: doc, note, name, source. Per doc, note and name: the earliest note before it in which the name stood for exactly one source, and that source."""
    per = mentions.groupBy(doc, note, "name").agg(F.count_distinct("source").alias("sources"), F.min("source").alias("source"))
    before = W.partitionBy(doc, "name").orderBy(note).rowsBetween(W.unboundedPreceding, -1)
    clear = F.when(F.col("sources") == 1, F.struct(F.col(note).alias("note"), "source"))
    found = per.withColumn("target", F.min(clear).over(before))
    return found.select(doc, note, "name", "sources", F.col("target.note").alias("target_note"), F.col("target.source").alias("target_source"))


def resolve_repeats(mentions: DataFrame, doc: str = "doc", note: str = "note", order: list[str] | None = None) -> DataFrame:
    """mentions: doc, note (1, 2, ...), the columns of order, key, is_repeat. Adds `resolved`: a repeat means the mention before it in its note,
    or the only mention of the note numbered one less; chains of repeats pass on what their head means; without such a head it is null."""
    order = order or ["seg"]
    sized = mentions.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(doc, note)))
    w = W.partitionBy(doc).orderBy(note, *order)
    same = F.lag(note).over(w) == F.col(note)
    single = (F.lag(note).over(w) == F.col(note) - 1) & (F.lag("_n").over(w) == 1)
    linked = F.coalesce(F.col("is_repeat") & (same | single), F.lit(False))
    chained = sized.withColumn("_linked", linked)
    numbered = chained.withColumn("_chain", F.sum(F.when(F.col("_linked"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    head = F.first(F.when(~F.col("is_repeat"), F.col("key"))).over(W.partitionBy(doc, "_chain").orderBy(note, *order))
    return numbered.withColumn("resolved", head).drop("_n", "_linked", "_chain")
