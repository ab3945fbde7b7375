"""Connected components of links between ids, by contraction with random priorities.

Each round a node joins its neighbour of least priority, if that is less than its own, and the links are
drawn again between the joined nodes; what is left shrinks by a constant factor a round on any graph. Each
round is written to the shared folder, so that no lineage grows and lost executors cost one round's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.workspace import written


def components(links: DataFrame) -> DataFrame:
    """links: u, v (long). Returns node, component (the least node of its component), for the nodes with a link to another."""
    edges = written(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(c).alias("r"), F.col(c).alias("id"))
        both = edges.select("u", ranked("v").alias("other")).unionByName(edges.select(F.col("v").alias("u"), ranked("u").alias("other")))
        least = both.groupBy("u").agg(F.min("other").alias("other"))
        step = written(least.select(F.col("u").alias("node"), F.least("other", ranked("u"))["id"].alias("parent")), "parents")
        steps.append(step)
        left, right = (step.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")) for c in "uv")
        moved = edges.join(left, "u").join(right, "v").where("pu <> pv")
        edges = written(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "links")
    if not steps:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component")).where(F.lit(False))
    root = steps[0].withColumnRenamed("parent", "root")
    for step in steps[1:]:
        up = step.select(F.col("node").alias("root"), F.col("parent").alias("_up"))
        root = root.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
    root = written(root, "roots")
    least = root.groupBy("root").agg(F.min("node").alias("component"))
    return root.join(least, "root").select("node", "component")
