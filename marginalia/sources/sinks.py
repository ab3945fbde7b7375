"""What leaves the library: bibliographies as text files, reports as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sections of a bibliography, and the source types of each; all others go into the last.
SECTIONS = {
    "A Articles/Books/Reports": ("journal_article", "book", "book_chapter", "report", "research_paper", "newspaper", "website", "dictionary", "legal_encyclopedia"),
    "B Cases": ("case",),
    "C Legislation": ("legislation", "explanatory_memorandum"),
    "D Treaties": ("treaty",),
}
OTHER = "E Other"


def section(kind: Column) -> Column:
    out = F
    for name, kinds in SECTIONS.items():
        out = out.when(kind.isin(*kinds), name)
    return out.otherwise(OTHER)


def bibliography(entries: DataFrame) -> DataFrame:
    """entries: doc, type, entry. doc, section, ord, entry: each entry once, by section and its text without marks and quotes."""
    key = F.lower(F.regexp_replace("entry", r"^['‘*]+", ""))
    once = entries.where(F.length("entry") > 0).select("doc", section(F.col("type")).alias("section"), key.alias("key"), "entry").distinct()
    listed = once.groupBy("doc", "section").agg(F.array_sort(F.collect_list(F.struct("key", "entry"))).alias("e"))
    return listed.select("doc", "section", F.posexplode("e").alias("ord", "e")).select("doc", "section", "ord", F.col("e.entry").alias("entry"))


def write_bibliography(entries: DataFrame, path: str) -> None:
    """One text a document, its sections under headings, in a folder doc=...; documents go to tasks whole."""
    parts = bibliography(entries).groupBy("doc", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "entry"))), lambda e: e["entry"]), "\n").alias("text"))
    texts = parts.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("section", "text"))).alias("s"))
    whole = F.array_join(F.transform("s", lambda s: F.concat(s["section"], F.lit("\n"), s["text"])), "\n\n")
    texts.select("doc", whole.alias("value")).write.partitionBy("doc").text(path)


def write_report(results: DataFrame, path: str) -> None:
    """Results as JSON lines, nulls left out."""
    results.write.json(path)
