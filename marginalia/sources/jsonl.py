"""Records of JSON lines: only the fields asked for are parsed, lines that are no records are set apart and counted."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BAD = "_unreadable"


def read_records(spark: SparkSession, path: str, fields: Mapping[str, str]) -> DataFrame:
    """fields: name and type of each. One row a line; `_unreadable` holds the text of a line that isn't a JSON object, else null.

    Blank lines are no rows. A value of another type makes its line unreadable. Files may be compressed, a folder is read whole."""
    schema = ", ".join([*(f"`{name}` {kind}" for name, kind in fields.items()), f"{_BAD} string"])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).json(path)


def good_records(records: DataFrame) -> DataFrame:
    return records.where(F.col(_BAD).isNull()).drop(_BAD)


def bad_lines(records: DataFrame) -> DataFrame:
    """The file and number of bad lines in it, with one of them: as many rows as files have bad lines."""
    bad = records.withColumn("file", F.input_file_name()).where(F.col(_BAD).isNotNull())
    return bad.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min(F.substring(_BAD, 1, 200)).alias("example"))


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """A corpus of decisions as records of the index: court, year, number, title; what lacks one of the first three is left out."""
    rows = good_records(read_records(spark, path, {"type": "string", "citation": "string", "jurisdiction": "string"}))
    pattern = r"^(.*?)\s*\[([0-9]{4})\]\s+([A-Za-z]+)\s+([0-9]+)\s*$"
    part = lambda n: F.regexp_extract("citation", pattern, n)
    found = rows.where(F.col("type").isin("decision") & F.col("citation").rlike(pattern))
    return found.select(part(3).alias("court"), part(2).cast("int").alias("year"), part(4).cast("int").alias("number"), F.trim(part(1)).alias("title"))
