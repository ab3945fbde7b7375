"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down the tree domain - language - source. At each node it is dealt to the children
by weight; a child whose whole subtree can't use its share (tokens times max_epochs) is filled, and what
is left goes to its siblings by weight, so that a shortage reaches an ancestor's other children only when
the siblings are full. Each leaf then takes whole epochs and, of the next one, a prefix in an order seeded
by (seed, epoch): the rows whose tokens before them are less than what is left of the budget.

The prefix is found without sorting a leaf: sums over hash buckets of the order give the bucket in which
the budget ends, and only that bucket (1/4096 of a leaf) is sorted, for one cut value a leaf. Selecting is
then a map over the rows with a broadcast table of leaves, whose size is checked.

Tokens are words, runs of characters other than 0x20 and 0x09-0x0D. Null domain, language or source count
as ''; a null text has no tokens, a text of any length is counted whole. Rows of one id stand together in the order, and
rows of equal order and id by their tokens; equal needs among siblings are filled by name. Integer division loses less
than one token a child. A node whose children all have weight 0 passes nothing on. An empty table gives an empty
result. Other columns, whatever their names, go along untouched.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.workspace import written

LEVELS = ("domain", "language", "source")
#: Hex digits of the order's hash that number a bucket: 16**3 buckets a leaf.
_BUCKET_DIGITS = 3
#: Largest table of leaves that is broadcast.
MAX_BROADCAST_LEAVES = 200_000


@dataclass(frozen=True)
class Mix:
    """weights: by level and name, default 1. budget_percent: of the corpus's tokens. max_epochs: most copies of a row."""

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    budget_percent: int = 100
    max_epochs: int = 4
    seed: int = 17


def source_domain(source: Column) -> Column:
    """The domain of a source, by its number, however long: src0, src3, ... web; src1, src4, ... books; src2, src5, ... forums."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1)
    # A number and the sum of its digits leave the same when divided by three.
    digits = F.aggregate(F.split(number, ""), F.lit(0), lambda total, digit: (total + F.coalesce(digit.try_cast("int"), F.lit(0))) % 3)
    return F.when(number == "", "other").otherwise(F.element_at(F.array(*map(F.lit, ("web", "books", "forums"))), digits + 1))


def _leaf_columns(domain: Column, lang: str, source: str) -> list[Column]:
    return [F.coalesce(domain, F.lit("")).alias("domain"), F.coalesce(F.col(lang), F.lit("")).alias("language"), F.coalesce(F.col(source), F.lit("")).alias("source_name")]


def _order(id_col: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit(""))))


def _weight(level: str, name: Column, mix: Mix) -> Column:
    known = mix.weights.get(level, {})
    out = F.lit(1)
    for key, w in known.items():
        out = F.when(name == key, w).otherwise(out)
    return out.cast("decimal(18,0)")


def _deal(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes: parent..., name, weight, cap, given (the parent's budget). Adds `budget`: the weighted filling of the children."""
    by_need = W.partitionBy(*parent).orderBy(F.try_divide(F.col("cap").cast("double"), F.col("weight").cast("double")).asc_nulls_last(), name)
    group = W.partitionBy(*parent)
    wide = lambda c: c.cast("decimal(18,0)")
    before = F.coalesce(F.sum("cap").over(by_need.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_need.rowsBetween(W.currentRow, W.unboundedFollowing))
    ranked = nodes.withColumn("_before", wide(before)).withColumn("_rest", wide(rest))
    full = (F.col("weight") > 0) & (F.col("cap") * F.col("_rest") <= F.col("weight") * wide(F.col("given") - F.col("_before")))
    marked = ranked.withColumn("_full", full)
    filled = wide(F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(group), F.lit(0)))
    open_weight = wide(F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group), F.lit(0)))
    shared = marked.withColumn("_filled", filled).withColumn("_open", open_weight)
    part = F.floor(F.try_divide(F.col("weight") * wide(F.col("given") - F.col("_filled")), F.col("_open")))
    budget = F.when(F.col("_full"), F.col("cap")).when(F.col("_open") > 0, part).otherwise(0)
    return shared.withColumn("budget", wide(budget)).drop("_before", "_rest", "_full", "_filled", "_open")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves: domain, language, source_name, tokens. Adds the leaf's budget, its whole epochs and the tokens of the partial one."""
    wide = lambda c: c.cast("decimal(18,0)")
    leaf = leaves.withColumn("cap", wide(F.col("tokens") * mix.max_epochs))
    total = leaves.agg(wide(F.floor(F.sum("tokens") * mix.budget_percent / 100)).alias("given"))
    keys: list[str] = []
    given = total
    for level, name in zip(LEVELS, ("domain", "language", "source_name"), strict=True):
        nodes = leaf.groupBy(*keys, name).agg(wide(F.sum("cap")).alias("cap")).withColumn("weight", _weight(level, F.col(name), mix))
        nodes = nodes.join(given, keys) if keys else nodes.join(F.broadcast(given))
        dealt = _deal(nodes, keys or [F.lit(0)], name)
        keys = [*keys, name]
        given = dealt.select(*keys, F.col("budget").alias("given"))
    out = leaves.join(given.withColumnRenamed("given", "budget"), keys)
    whole = F.when(F.col("tokens") > 0, F.floor(F.try_divide(F.col("budget"), F.col("tokens")))).otherwise(0).cast("long")
    out = out.withColumn("budget", F.col("budget").cast("long")).withColumn("whole", whole)
    return out.withColumn("partial", F.col("budget") - F.col("whole") * F.col("tokens"))


def plan_mix(docs: DataFrame, domain: Column, mix: Mix, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per leaf: budget, whole epochs, partial tokens and `cut`, the last order value taken in the partial epoch (null: none)."""
    n_tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = written(docs.select(F.col(id_col).alias("_id"), *_leaf_columns(domain, lang_col, source_col), n_tokens.alias("n_tokens")), "mix-rows")
    leaf = ["domain", "language", "source_name"]
    leaves = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"))
    budgets = written(leaf_budgets(leaves, mix), "mix-leaves")
    joined = rows.join(_bounded_broadcast(budgets), leaf).where("partial > 0")
    keyed = joined.withColumn("_order", _order(F.col("_id"), F.col("whole"), mix.seed)).withColumn("_bucket", F.substring("_order", 1, _BUCKET_DIGITS))
    sums = keyed.groupBy(*leaf, "_bucket").agg(F.sum("n_tokens").alias("n"), F.first("partial").alias("partial"))
    # At most 4096 rows a leaf.
    before = F.coalesce(F.sum("n").over(W.partitionBy(*leaf).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = sums.withColumn("_before", before).where("_before < partial").groupBy(*leaf).agg(F.max_by(F.struct("_bucket", "_before"), "_bucket").alias("last"))
    last = written(last.select(*leaf, F.col("last._bucket").alias("last_bucket"), F.col("last._before").alias("bucket_before")), "mix-buckets")
    end = keyed.join(_bounded_broadcast(last), leaf).where("_bucket = last_bucket")
    by_order = W.partitionBy(*leaf).orderBy("_order", "_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    taken = end.withColumn("_n", F.col("bucket_before") + F.coalesce(F.sum("n_tokens").over(by_order), F.lit(0))).where("_n < partial")
    cuts = taken.groupBy(*leaf).agg(F.max("_order").alias("cut"))
    return written(budgets.join(cuts, leaf, "left"), "mix-plan")


def _bounded_broadcast(leaves: DataFrame) -> DataFrame:
    return F.broadcast(leaves) if leaves.count() <= MAX_BROADCAST_LEAVES else leaves


def apply_mix(docs: DataFrame, plan: DataFrame, domain: Column, mix: Mix, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs with the columns domain, language, source_name, epoch; a row for each epoch that takes it. A map over docs."""
    marked = docs.select(F.struct("*").alias("row"), *_leaf_columns(domain, lang_col, source_col), F.col(id_col).alias("_id"))
    leaf = ["domain", "language", "source_name"]
    joined = marked.join(_bounded_broadcast(plan.select(*leaf, "whole", "cut")), leaf)
    taken = F.when(F.col("cut").isNotNull() & (_order(F.col("_id"), F.col("whole"), mix.seed) <= F.col("cut")), 1).otherwise(0)
    epochs = joined.withColumn("_epochs", F.col("whole") + taken).where("_epochs > 0")
    return epochs.select("row", *leaf, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_epochs") - 1)).alias("epoch"))


def mix_documents(docs: DataFrame, domain: Column, mix: Mix, **columns: str) -> DataFrame:
    """The mixed corpus: the columns of docs, a row for each epoch that takes it."""
    plan = plan_mix(docs, domain, mix, **columns)
    named = {k: v for k, v in columns.items() if k != "text_col"}
    return apply_mix(docs, plan, domain, mix, **named).select("row.*")


def mix_selection(docs: DataFrame, domain: Column, mix: Mix, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """Which rows the mix takes, by id, leaf and epoch."""
    plan = plan_mix(docs, domain, mix, id_col=id_col, **columns)
    named = {k: v for k, v in columns.items() if k != "text_col"}
    slim = docs.select(id_col, columns.get("lang_col", "lang"), columns.get("source_col", "source"))
    return apply_mix(slim, plan, domain, mix, id_col=id_col, **named).select(F.col(f"row.{id_col}").alias(id_col), "domain", "language", F.col("source_name").alias("source"), "epoch")
