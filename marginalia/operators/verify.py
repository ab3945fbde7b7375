"""An index of known records, and claims checked against it.

The index has one row per (court, year, number) with its distinct titles. What is absent is only called missing
where the index covers that court and year well enough, and far enough below its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.dialect import SPARK, Spark
from marginalia.operators import names

MIN_NUMBERS, MIN_SHARE, MIN_RECORDS = 10, 0.85, 50


def build_index(records: DataFrame, min_records: int = MIN_RECORDS) -> DataFrame:
    """records: court, year, number, title. Courts with fewer than min_records distinct (year, number) go. Titles sorted."""
    index = records.groupBy("court", "year", "number").agg(F.array_sort(F.collect_set("title")).alias("titles"))
    large = index.groupBy("court").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_records).select("court")
    return index.join(large, "court", "left_semi")


def coverage(index: DataFrame, last_year: int) -> DataFrame:
    """Per court and year: how many numbers, the last one, and whether the index covers the year."""
    per = index.groupBy("court", "year").agg(F.count(F.lit(1)).alias("n"), F.max("number").alias("last"))
    good = (F.col("n") >= MIN_NUMBERS) & (F.col("year") < last_year) & (F.col("n") >= MIN_SHARE * F.col("last"))
    return per.withColumn("covered", good)


def name_steps(d: Spark) -> list[dict[str, str]]:
    """Of `name` and `titles`: does one of the titles share a telling word with the name, each read once?"""
    one = lambda t: names.shares_word(d, "mine", t)
    return [{"mine": names.telling(d, "name"), "theirs": d.each("titles", lambda t: names.telling(d, t), "t")}, {"named": f"{d.size(d.keep('theirs', one, 't'))} > 0"}]


def check_claims(claims: DataFrame, index: DataFrame, last_year: int) -> DataFrame:
    """claims: court, year, number, name and any others. Adds `outcome`: found, name mismatch, not found or unchecked."""
    known = index.select("court", "year", "number", "titles")
    years = coverage(index, last_year).select("court", "year", "last", "covered")
    joined = claims.join(known, ["court", "year", "number"], "left").join(years, ["court", "year"], "left")
    margin = F.col("last") + F.greatest(F.lit(3), F.floor(F.col("last") / 20))
    for step in name_steps(SPARK):
        joined = joined.withColumns({c: F.expr(x) for c, x in step.items()})
    outcome = F.when(F.col("titles").isNotNull(), F.when(F.col("named"), "found").otherwise("name mismatch"))
    outcome = outcome.when(F.col("covered") & (F.col("number") > margin), "not found").otherwise("unchecked")
    return joined.withColumn("outcome", outcome).drop("titles", "last", "covered", "mine", "theirs", "named")

