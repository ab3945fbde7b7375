"""Citation plan queries. A customer is a document, an order a note, a line item a mention of its supplier's group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import richtext as rt
from marginalia.operators import plan, resolve
from marginalia.sources.tables import table

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return orders.select(F.col("o_custkey").alias("doc"), F.row_number().over(w).alias("note"), "o_orderkey")


def _mentions(spark: SparkSession, sf_dir: str, notes: DataFrame) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *_ORDER, "l_returnflag", "l_linestatus")
    joined = lines.join(notes, lines.l_orderkey == notes.o_orderkey)
    pin = F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_returnflag"))
    return joined.select("doc", "note", (F.col("l_suppkey") % 5).alias("key"), pin.alias("pinpoint"), *_ORDER)


def citation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _notes(spark, sf_dir)
    planned = plan.citation_plan(notes, _mentions(spark, sf_dir, notes), order=_ORDER)
    return planned.select("doc", "note", "pos", "key", "pinpoint", "occurrence", "plan", "suffix")


_SQL_MENTIONS = """
notes AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS note, o_orderkey FROM orders),
mentions AS (SELECT doc, note, l_suppkey % 5 AS key, CASE WHEN l_linestatus = 'O' THEN '' ELSE l_returnflag END AS pinpoint,
  l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem JOIN notes ON l_orderkey = o_orderkey),
per AS (SELECT doc, note, count(*) AS n, min(key) AS sole_key, min(pinpoint) AS sole_pin FROM mentions GROUP BY doc, note),
prev AS (SELECT doc, note, lag(coalesce(n, 0)) OVER w AS prev_n, lag(sole_key) OVER w AS prev_key, lag(sole_pin) OVER w AS prev_pin
  FROM notes LEFT JOIN per USING (doc, note) WINDOW w AS (PARTITION BY doc ORDER BY note)),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc, note ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS pos,
  row_number() OVER (PARTITION BY doc, key ORDER BY note, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS occurrence FROM mentions),
planned AS (SELECT p.*, prev_pin, CASE WHEN occurrence = 1 THEN 'full'
  WHEN pos = 1 AND prev_n = 1 AND prev_key = key AND NOT (pinpoint = '' AND prev_pin <> '') THEN 'ibid' ELSE 'subsequent' END AS plan
  FROM placed p LEFT JOIN prev USING (doc, note))
"""


def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first mention of each key of a document."""
    notes = _notes(spark, sf_dir)
    return plan.first_per_key(_mentions(spark, sf_dir, notes), "doc", ["note", *_ORDER]).select("doc", "key", "note", "pinpoint")


def needs_short_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a later mention refers back to, and that so define a short title."""
    return citation_plan(spark, sf_dir).groupBy("doc", "key").agg(F.bool_or(F.col("plan") == "subsequent").alias("defines"), F.count_if(F.col("plan") == "ibid").alias("repeats"))


def reference_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _notes(spark, sf_dir)
    mentions = _mentions(spark, sf_dir, notes).select("doc", "note", F.col("pinpoint").alias("name"), F.col("key").alias("source"))
    return resolve.earliest_named(mentions)


def repeat_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line is a repeat."""
    notes = _notes(spark, sf_dir)
    mentions = _mentions(spark, sf_dir, notes).withColumn("is_repeat", F.col("l_partkey") % 3 == 0)
    found = resolve.resolve_repeats(mentions, order=_ORDER)
    return found.groupBy("doc", "note").agg(F.count_if("is_repeat").alias("repeats"), F.count_if(F.col("is_repeat") & F.col("resolved").isNotNull()).alias("resolved"), F.coalesce(F.sum(F.when(F.col("is_repeat"), F.col("resolved"))), F.lit(0)).alias("key_sum"))


def rendered_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of each document as they are printed."""
    notes = _notes(spark, sf_dir)
    planned = plan.citation_plan(notes, _mentions(spark, sf_dir, notes), order=_ORDER)
    signal = F.when((F.col("note") % 4 == 0) & (F.col("pos") == 1), "See").otherwise("")
    written = {"signal": signal, "cited": F.concat(F.lit("*Source "), F.col("key"), F.lit("*")), "short": F.concat(F.lit("S"), F.col("key"))}
    return plan.rendered_notes(planned.withColumns(written))


def richtext_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each document with capitalised words italic, neighbours of one style joined."""
    words = F.split(F.substring_index("text", "\n", 1), " ")
    runs = F.transform(words, lambda w: rt.run(F.concat(w, F.lit("_")), F.coalesce(w.rlike("^[A-Z]"), F.lit(False))))
    return table(spark, sf_dir, "documents").select("doc_id", rt.markup(rt.merged(runs)).alias("markup"))


QUERIES = {f.__name__: f for f in (citation_plan, first_occurrence, needs_short_title, reference_by_name, repeat_resolution, richtext_markup, rendered_notes)}
_SQL_PLAN = f"WITH {_SQL_MENTIONS}"
_SQL_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
ORACLE_SQL = {
    "citation_plan": f"{_SQL_PLAN} SELECT doc, note, pos, key, pinpoint, occurrence, plan, CASE WHEN plan = 'ibid' AND pinpoint <> prev_pin THEN pinpoint ELSE '' END AS suffix FROM planned",
    "first_occurrence": f"{_SQL_PLAN} SELECT doc, key, note, pinpoint FROM placed WHERE occurrence = 1",
    "needs_short_title": f"{_SQL_PLAN} SELECT doc, key, bool_or(plan = 'subsequent') AS defines, count(*) FILTER (plan = 'ibid') AS repeats FROM planned GROUP BY doc, key",
    "reference_by_name": f"{_SQL_PLAN}, p AS (SELECT doc, note, pinpoint AS name, count(DISTINCT key) AS sources, min(key) AS source FROM mentions GROUP BY ALL), t AS (SELECT *, min(CASE WHEN sources = 1 THEN note END) OVER (PARTITION BY doc, name ORDER BY note ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target_note FROM p) SELECT t.doc, t.note, t.name, t.sources, target_note, p.source AS target_source FROM t LEFT JOIN p ON p.doc = t.doc AND p.name = t.name AND p.note = target_note",
    "repeat_resolution": f"""{_SQL_PLAN}, m AS (SELECT *, l_partkey % 3 = 0 AS rep, count(*) OVER (PARTITION BY doc, note) AS n FROM mentions),
l AS (SELECT *, coalesce(rep AND (lag(note) OVER w = note OR (lag(note) OVER w = note - 1 AND lag(n) OVER w = 1)), false) AS linked FROM m WINDOW w AS (PARTITION BY doc ORDER BY note, {_SQL_ORDER})),
c AS (SELECT *, sum((NOT linked)::INT) OVER (PARTITION BY doc ORDER BY note, {_SQL_ORDER} ROWS UNBOUNDED PRECEDING) AS chain FROM l),
h AS (SELECT *, max(CASE WHEN NOT linked AND NOT rep THEN key END) OVER (PARTITION BY doc, chain) AS resolved FROM c)
SELECT doc, note, count(*) FILTER (rep) AS repeats, count(*) FILTER (rep AND resolved IS NOT NULL) AS resolved, coalesce(sum(resolved) FILTER (rep), 0)::BIGINT AS key_sum FROM h GROUP BY doc, note""",
    "rendered_notes": f"""{_SQL_PLAN}, f AS (SELECT doc, key, min(note) FILTER (plan = 'full') AS first_note, bool_or(plan = 'subsequent') AS defines FROM planned GROUP BY doc, key),
t AS (SELECT doc, note, pos, note % 4 = 0 AND pos = 1 AS see, CASE plan WHEN 'full' THEN '*Source ' || key || '*' || CASE WHEN pinpoint = '' THEN '' ELSE ', ' || pinpoint END || CASE WHEN defines THEN ' (‘S' || key || '’)' ELSE '' END
  WHEN 'ibid' THEN CASE WHEN pos = 1 AND note % 4 <> 0 THEN 'Ibid' ELSE 'ibid' END || CASE WHEN pinpoint <> prev_pin AND pinpoint <> '' THEN ' ' || pinpoint ELSE '' END
  ELSE 'S' || key || ' (n ' || first_note || ')' || CASE WHEN pinpoint = '' THEN '' ELSE ' ' || pinpoint END END AS text FROM planned JOIN f USING (doc, key))
SELECT doc, note, string_agg(CASE WHEN see THEN 'See ' ELSE '' END || text, '; ' ORDER BY pos) || '.' AS text FROM t GROUP BY doc, note""",
    "richtext_markup": """WITH w AS (SELECT doc_id, unnest(string_split(split_part(text, chr(10), 1), ' ')) AS w, generate_subscripts(string_split(split_part(text, chr(10), 1), ' '), 1) AS i FROM documents),
f AS (SELECT *, regexp_matches(w, '^[A-Z]') AS it FROM w), g AS (SELECT *, (it <> coalesce(lag(it) OVER (PARTITION BY doc_id ORDER BY i), NOT it))::INT AS new FROM f),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g),
r AS (SELECT doc_id, island, any_value(it) AS it, string_agg(w || '_', '' ORDER BY i) AS t FROM s GROUP BY doc_id, island)
SELECT doc_id, string_agg(CASE WHEN it THEN '*' || t || '*' ELSE t END, '' ORDER BY island) AS markup FROM r GROUP BY doc_id""",
}
