"""Fingerprints of documents by their lines, and who contains whom.

A candidate pair is met by prefix filtering: lines are ordered by how many documents have them, and a document
shows only its rarest lines, so many that a pair with enough lines in common must meet. Lines that stand
in very many documents are thus no meeting places unless a document has little else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.text import countable, fingerprint_form
from marginalia.workspace import written

#: Matches needed before two documents are compared at all.
MIN_MATCHES = 5


def line_hashes(docs: DataFrame, id_col: str, text_col: str, hashed: Column | None = None) -> DataFrame:
    """doc, hash: the distinct countable lines of each document. hashed: of the column `form`; SHA-256 unless given."""
    # Inside the lambdas a form is made once, however often it is looked at.
    forms = F.array_distinct(F.filter(F.transform(F.split(text_col, "\n"), fingerprint_form), lambda form: countable(form)))
    lines = docs.select(F.col(id_col).alias("doc"), F.explode(forms).alias("form"))
    hashes = lines.select("doc", (hashed if hashed is not None else F.substring(F.sha2("form", 256), 1, 32)).alias("hash"))
    return hashes.distinct()


def document_fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, doc_hash (of all line forms in order) and the number of distinct countable lines."""
    forms = F.transform(F.split(text_col, "\n"), fingerprint_form)
    counted = F.size(F.array_distinct(F.filter(forms, lambda form: countable(form))))
    return docs.select(F.col(id_col).alias("doc"), F.sha2(F.array_join(forms, "\n"), 256).alias("doc_hash"), counted.alias("n_hashes"))


def ranked_lines(hashes: DataFrame) -> DataFrame:
    """doc, hash, rank (1: the line that the fewest documents have) and total; written, so that all that follows reads it."""
    hashes = written(hashes, "line-hashes")
    frequency = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("df"))
    by_rarity = W.partitionBy("doc").orderBy("df", "hash")
    ranked = hashes.join(frequency, "hash").withColumn("rank", F.row_number().over(by_rarity)).withColumn("total", F.count(F.lit(1)).over(W.partitionBy("doc")))
    return written(ranked.drop("df"), "ranked-lines")


def containment(ranked: DataFrame, share: float, at_least: int = MIN_MATCHES) -> DataFrame:
    """new, earlier, shared, new_total, earlier_total: ordered pairs where the later document has at_least lines, and share of its own, in common."""
    needed = F.greatest(F.lit(at_least), F.ceil(F.col("total") * share))
    as_new = ranked.where(F.col("rank") <= F.col("total") - needed + 1).select(F.col("doc").alias("new"), "hash", needed.alias("needed"))
    # An earlier document of fewer lines than a later one needs can't have enough.
    as_earlier = ranked.where(F.col("rank") <= F.col("total") - at_least + 1).select(F.col("doc").alias("earlier"), "hash", F.col("total").alias("earlier_total"))
    candidates = as_new.join(as_earlier, "hash").where("new > earlier AND earlier_total >= needed").select("new", "earlier").distinct()
    # Only lines of candidates are counted, each document's lines once as an array.
    lines = ranked.groupBy("doc").agg(F.collect_set("hash").alias("lines"))
    both = candidates.join(lines.select(F.col("doc").alias("new"), F.col("lines").alias("a")), "new").join(lines.select(F.col("doc").alias("earlier"), F.col("lines").alias("b")), "earlier")
    counted = both.select("new", "earlier", F.size(F.array_intersect("a", "b")).alias("shared"), F.size("a").alias("new_total"), F.size("b").alias("earlier_total"))
    return counted.where((F.col("shared") >= at_least) & (F.col("shared") >= F.ceil(F.col("new_total") * share)))


def best_earlier(ranked: DataFrame, at_least: int = MIN_MATCHES) -> DataFrame:
    """new, earlier, shared, new_total: per document the earlier one with most of its lines, the latest of several.

    Documents with equal lines form a class. Within one the document before has all lines, so only the first document of
    a class is compared with others, and a class takes part in that once."""
    keyed = ranked.groupBy("doc", "total").agg(F.md5(F.array_join(F.array_sort(F.collect_list("hash")), " ")).alias("class"))
    members = written(keyed.where(F.col("total") >= at_least).withColumn("before", F.lag("doc").over(W.partitionBy("class").orderBy("doc"))), "line-classes")
    firsts = members.where("before IS NULL").select("doc", "class")
    pairs = containment(ranked.join(firsts.select("doc"), "doc", "left_semi"), 0.0, at_least)
    most = pairs.withColumn("most", F.max("shared").over(W.partitionBy("new"))).where("shared = most").drop("most")
    of_class = most.join(firsts.select(F.col("doc").alias("earlier"), "class"), "earlier")
    earlier = of_class.join(members.select(F.col("doc").alias("member"), "class"), "class").where("member < new")
    across = earlier.groupBy("new", "shared", "new_total").agg(F.max("member").alias("earlier"))
    within = members.where("before IS NOT NULL").select(F.col("doc").alias("new"), F.col("total").cast("int").alias("shared"), F.col("total").cast("int").alias("new_total"), F.col("before").alias("earlier"))
    return across.unionByName(within).select("new", "earlier", "shared", "new_total")
