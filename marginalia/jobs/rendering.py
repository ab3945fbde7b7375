"""Rendered citations, word diffs and streams, over the star schema, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.operators import diff, render
from marginalia.sources.tables import table
from marginalia.streaming import progress


def render_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a source: its size chooses the type, its name and brand give the fields."""
    s = lambda c: F.col(c).cast("string")
    k = F.col("p_size") % 5
    kind = F.when(k == 0, "case").when(k == 1, "legislation").when(k == 2, "journal_article").when(k == 3, "book").otherwise("report")
    words = F.split("p_name", " ")
    fields = {
        "type": kind, "name": F.concat_ws(" v ", F.element_at(words, 1), F.element_at(words, -1)), "title": F.initcap("p_name"), "authors": F.slice(words, 1, F.col("p_size") % 3 + 1), "year": F.when(F.col("p_partkey") % 11 != 0, (F.lit(1950) + F.col("p_size")).cast("string")),
        "year_style": F.when(F.col("p_partkey") % 2 == 0, "square"), "volume": F.when(F.col("p_partkey") % 3 != 0, s("p_size")), "issue": F.when(F.col("p_partkey") % 4 == 0, "2"), "report": F.when(F.col("p_partkey") % 5 != 0, F.lit("CLR")), "starting_page": s("p_partkey"),
        "court_id": F.when(F.col("p_partkey") % 10 == 0, "HCA"), "judgment_number": s("p_size"), "jurisdiction": F.when(F.col("p_partkey") % 7 != 0, "Vic"), "kind": F.when(F.col("p_partkey") % 6 == 0, "bill").otherwise("act"), "journal": F.col("p_type"), "publisher": F.col("p_brand"),
        "edition": F.when(F.col("p_partkey") % 2 == 1, s("p_size")), "document_type": F.lit(None).cast("string"), "number": F.concat(F.lit("No "), s("p_size")), "forum": F.lit(None).cast("string"), "date": F.lit("May 2001"), "pinpoint": F.when(F.col("p_partkey") % 3 == 1, "12"),
    }
    rows = table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in fields.items()])
    return rows.select("p_partkey", "type", render.full().alias("cited"), render.full(bibliography=True).alias("entry"))


def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document against the line before: words kept, deleted and inserted."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    paired = lines.withColumn("before", F.lag("line").over(W.partitionBy("doc_id").orderBy("pos"))).where("before IS NOT NULL")
    pieces = paired.select("doc_id", "pos", "line", diff.word_diff(F.col("before"), F.col("line")).alias("pieces"))
    rebuilt = F.array_join(F.transform(F.filter("pieces", lambda p: p["op"] != "del"), lambda p: p["text"]), "")
    return pieces.select("doc_id", "pos", F.size("pieces").alias("pieces"), (rebuilt == F.col("line")).alias("rebuilds"))


QUERIES = {"render_citations": render_citations, "word_diff": word_diff, "progress_fold": progress.fold_progress, "first_deliveries": progress.first_deliveries}

_AUTHORS = "CASE WHEN len(a) = 1 THEN {x} WHEN len(a) <= 3 THEN array_to_string(list_concat([{x}], a[2:len(a) - 1]), ', ') || ' and ' || a[-1] ELSE {x} || ' et al' END"
_YEAR = "coalesce(y, '[MISSING: year]')"
_ORD = "p_size || CASE WHEN p_size % 100 BETWEEN 10 AND 20 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END"


def _render_sql(entry: bool) -> str:
    a = _AUTHORS.format(x="a[1]")  # authors here are single words, which no bibliography inverts
    pin = "''" if entry else "CASE WHEN k % 3 = 1 THEN ', 12' ELSE '' END"
    spaced = "''" if entry else "CASE WHEN k % 3 = 1 THEN ' 12' ELSE '' END"
    return f"""CASE p_size % 5 WHEN 0 THEN '*' || w[1] || ' v ' || w[-1] || '*' || CASE WHEN k % 5 <> 0 THEN ' ' || CASE WHEN k % 2 = 0 THEN '[' || {_YEAR} || ']' ELSE '(' || {_YEAR} || ')' END || CASE WHEN k % 3 <> 0 THEN ' ' || p_size ELSE '' END || ' CLR ' || k
    WHEN k % 10 = 0 THEN ' [' || {_YEAR} || '] HCA ' || p_size ELSE ' [MISSING: case citation (report or court details)]' END || {pin}
  WHEN 1 THEN CASE WHEN k % 6 = 0 THEN t || ' ' || {_YEAR} ELSE '*' || t || ' ' || {_YEAR} || '*' END || CASE WHEN k % 7 <> 0 THEN ' (Vic)' ELSE ' [MISSING: jurisdiction]' END || {spaced}
  WHEN 2 THEN {a} || ', ‘' || t || '’ ' || CASE WHEN k % 3 <> 0 THEN '(' || {_YEAR} || ') ' || p_size ELSE '[' || {_YEAR} || ']' END || CASE WHEN k % 4 = 0 THEN '(2)' ELSE '' END || ' *' || p_type || '* ' || k || {pin}
  WHEN 3 THEN {a} || ', *' || t || '* (' || p_brand || CASE WHEN k % 2 = 1 THEN ', ' || {_ORD} || ' ed' ELSE '' END || ', ' || {_YEAR} || ')' || CASE WHEN k % 3 <> 0 THEN ' vol ' || p_size || {pin} ELSE {spaced} END
  ELSE {a} || ', *' || t || '* (Report No ' || p_size || ', May 2001)' || {spaced} END"""


ORACLE_SQL = {
    "render_citations": f"""WITH p AS (SELECT *, p_partkey AS k, string_split(p_name, ' ') AS w, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS t, CASE WHEN p_partkey % 11 <> 0 THEN (1950 + p_size)::VARCHAR END AS y FROM part),
q AS (SELECT *, w[1:p_size % 3 + 1] AS a FROM p)
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'case' WHEN 1 THEN 'legislation' WHEN 2 THEN 'journal_article' WHEN 3 THEN 'book' ELSE 'report' END AS type, {_render_sql(False)} AS cited, {_render_sql(True)} AS entry FROM q""",
    "progress_fold": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, count(*) AS seen, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (n <= 5) AS notes FROM r GROUP BY user_id",
    "first_deliveries": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS purchases, max(event_id) AS last_event FROM events WHERE event_type = 'purchase' GROUP BY 1",
}
