"""Chains of pointers followed by doubling: each round every open row jumps as far as its target has come.

A chain of n steps takes about log2(n) rounds of one equality join each, whose result is written to the shared folder, so that
plans stay short and a lost executor costs one round at most. Rows that point nowhere or at themselves are ends. Cycles have no end: when as many
rounds are done as the number of rows allows, what is still open is reported so. Hot ends (a chain's end that a third of all rows
point at) are joined once: rows that have reached an end are put aside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.workspace import written


def ends(pointers: DataFrame, key: list[str], target: list[str], is_end: str) -> DataFrame:
    """pointers: key columns, target columns (as many, null: none), is_end (boolean: the row itself is an answer).

    For each row: the key, `end_*` (the key of the first end at or behind it; null where the chain breaks off) and `steps` (to the end; null without
    one). A target without a row breaks the chain off, as a cycle does. Keys are distinct.
    """
    mine, theirs = [f"end_{k}" for k in key], [f"_{k}" for k in key]
    ended = F.coalesce(F.col(is_end), F.lit(False))
    rows = pointers.select(*key, *[F.when(ended, F.col(k)).otherwise(F.col(t)).alias(m) for k, t, m in zip(key, target, mine, strict=True)], F.when(ended, F.lit(0)).otherwise(1).cast("long").alias("steps"), ended.alias("_done"))
    broken = " OR ".join(f"{m} IS NULL" for m in mine)
    rows = written(rows, "pointers")
    closed = f"_done OR {broken}"
    ended_rows, open_, rounds = [rows.where(closed)], rows.where(f"NOT ({closed})"), 0
    most = max(1, rows.count()).bit_length() + 1

    def known() -> DataFrame:
        """Every row with its pointer so far."""
        out = open_
        for part in ended_rows:
            out = out.unionByName(part)
        return out

    while rounds < most and not open_.isEmpty():
        rounds += 1
        ahead = known().select(*[F.col(k).alias(t) for k, t in zip(key, theirs, strict=True)], *[F.col(m).alias(f"{m}_next") for m in mine], F.col("steps").alias("_more"), F.col("_done").alias("_done_next"))
        on = [F.col(m) == F.col(t) for m, t in zip(mine, theirs, strict=True)]
        moved = open_.join(ahead, on, "left").select(*key, *[F.col(f"{m}_next").alias(m) for m in mine], (F.col("steps") + F.col("_more")).alias("steps"), F.coalesce("_done_next", F.lit(False)).alias("_done"))
        moved = written(moved, "pointers")
        ended_rows.append(moved.where(closed))
        open_ = moved.where(f"NOT ({closed})")
    out = known()
    reached = F.col("_done")
    return out.select(*key, *[F.when(reached, F.col(m)).alias(m) for m in mine], F.when(reached, F.col("steps")).alias("steps"))
