"""Later references to notes ('Smith (n 4)'): to the note that names the source, through references to references.

A reference by number leads to what its note cites, at the end of a chain of such references. Where it gives a name that the source at the end
doesn't have, the number is taken for wrong, and the earliest note before it counts that cites a source of that name, if only one source
has it. A chain that breaks off (no such note, a later note, a cycle) is resolved by name alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.operators.pointers import ends


def resolved(notes: DataFrame) -> DataFrame:
    """notes: doc, note, name (of the source, or given by the reference; null: none), source (null for references), refers_to (null for sources).

    doc, note, outcome ('source', 'by number', 'by name', 'unresolved'), root (the note that cites the source), source, steps by number.
    """
    earlier = F.when(F.col("refers_to") < F.col("note"), F.col("refers_to"))
    chain = notes.withColumns({"target": earlier, "is_source": F.col("source").isNotNull()})
    reached = ends(chain, ["doc", "note"], ["doc", "target"], "is_source").select("doc", "note", F.col("end_note").alias("at"), "steps")
    sources = notes.where("source IS NOT NULL").select(F.col("doc").alias("s_doc"), F.col("note").alias("at_note"), F.col("name").alias("at_name"), F.col("source").alias("at_source"))
    led = notes.join(reached, ["doc", "note"]).join(sources, (F.col("doc") == F.col("s_doc")) & (F.col("at") == F.col("at_note")), "left")
    # The sources of a name up to each note, in one running pass.
    before = W.partitionBy("doc", "name").orderBy("note").rowsBetween(W.unboundedPreceding, -1)
    seen = led.withColumns({"low": F.min("source").over(before), "high": F.max("source").over(before), "first": F.min(F.when(F.col("source").isNotNull(), F.col("note"))).over(before)})
    by_number = F.col("at_source").isNotNull() & (F.col("name").isNull() | (F.col("name") == F.col("at_name")))
    by_name = F.col("name").isNotNull() & (F.col("low") == F.col("high"))
    outcome = F.when(F.col("source").isNotNull(), "source").when(by_number, "by number").when(by_name, "by name").otherwise("unresolved")
    told = seen.withColumn("outcome", outcome)
    pick = lambda own, number, name: F.when(F.col("outcome") == "source", own).when(F.col("outcome") == "by number", number).when(F.col("outcome") == "by name", name)
    return told.select("doc", "note", "outcome", pick(F.col("note"), F.col("at"), F.col("first")).alias("root"), pick(F.col("source"), F.col("at_source"), F.col("low")).alias("source"), F.when(F.col("outcome") == "by number", F.col("steps")).alias("steps"))
