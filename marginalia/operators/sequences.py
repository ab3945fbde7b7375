"""Ordered operations in a document or a stream's history: filling, islands, first k, neighbours, quotas, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def share_first(rows: DataFrame, group: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """Null values of a column become the group's first that isn't. The first comes from a map-side combined sum-up, so no group is sorted."""
    known = rows.where(F.col(column).isNotNull()).groupBy(*group).agg(F.min_by(column, F.struct(*order)).alias("_first"))
    joined = rows.join(known, list(group), "left")
    return joined.withColumn(column, F.coalesce(column, "_first")).drop("_first")


def complete_first(rows: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per group: for each column its first value that is neither null nor '', in order. False and 0 are values."""

    def first(name: str) -> Column:
        filled = F.col(name).isNotNull() & (F.col(name).cast("string") != "")
        return F.min_by(F.when(filled, F.col(name)), F.when(filled, F.struct(*order))).alias(name)

    return rows.groupBy(*group).agg(*map(first, columns))


def islands(rows: DataFrame, key: str, order: Sequence[str], condition: Column) -> DataFrame:
    """Runs of rows in a row that meet the condition: key, island (1, 2, ...), n, and the first order value."""
    w = W.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_in", condition).withColumn("_new", F.when(F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.where("_in").groupBy(key, "island").agg(F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("first"))


def first_k_true(rows: DataFrame, key: str, order: Sequence[str], condition: Column, k: Column) -> DataFrame:
    """Adds `shown`: rows that don't meet the condition, and the first k of each key that do."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("shown", ~condition | (F.sum(F.when(condition, 1).otherwise(0)).over(w) <= k))


def recent_and_next(rows: DataFrame, key: str, order: Sequence[str], done: Column, recent: int = 20, ahead: int = 3) -> DataFrame:
    """Of each key the last `recent` rows that are done, and the next `ahead` that aren't."""
    flagged = rows.withColumn("done", done)
    down = W.partitionBy(key, "done").orderBy(*[F.col(c).desc() for c in order])
    up = W.partitionBy(key, "done").orderBy(*order)
    near = F.when(F.col("done"), F.row_number().over(down) <= recent).otherwise(F.row_number().over(up) <= ahead)
    return flagged.withColumn("_near", near).where("_near").drop("_near")


def admitted(rows: DataFrame, key: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """Adds `admitted`: the first `limit` rows of each key. A refused row doesn't count, which for one limit is the same."""
    return rows.withColumn("admitted", F.row_number().over(W.partitionBy(*key).orderBy(*order)) <= limit)


def running_balance(entries: DataFrame, account: str, order: Sequence[str], delta: str) -> DataFrame:
    w = W.partitionBy(account).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return entries.withColumn("balance", F.sum(delta).over(w))


def failed_batches(rows: DataFrame, key: str, number: str, size: int) -> DataFrame:
    """Per key: rows, failed rows, whether a whole batch of `size` failed, and whether the run is payable:
    nothing failed, or at most a fifth and no whole batch. rows: key, number (1, 2, ...), failed."""
    batches = rows.groupBy(key, F.floor((F.col(number) - 1) / size).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("n_failed"))
    per = batches.groupBy(key).agg(F.sum("n").alias("n"), F.sum("n_failed").alias("n_failed"), F.bool_or(F.col("n") == F.col("n_failed")).alias("whole_batch_failed"))
    payable = (F.col("n_failed") == 0) | (~F.col("whole_batch_failed") & (5 * F.col("n_failed") <= F.col("n")))
    return per.withColumn("payable", payable)
