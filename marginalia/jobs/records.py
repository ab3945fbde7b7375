"""Queries over the star schema and events: resolution, verification, ordered history, quotas, ledgers, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.dialect import DUCK, with_steps
from marginalia.functions.text import norm_key
from marginalia.operators import names, plan, pointers, sequences, unify, verify
from marginalia.sources.tables import table
from marginalia.workspace import by_merge


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def _numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, sf_dir).withColumn("number", F.row_number().over(w))


def citation_plan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a document, an event a note with one mention of its type."""
    e = _numbered_events(spark, sf_dir).select(F.col("user_id").alias("doc"), F.col("number").alias("note"), F.col("event_type").alias("key"), F.lit("").alias("pinpoint"), F.lit(1).alias("seg"))
    return plan.citation_plan(e.select("doc", "note"), e).select("doc", "note", "key", "plan")


def share_first_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("user_id", "event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("title"))
    return sequences.share_first(e, ["user_id", "event_type"], ["event_id"], "title").select("user_id", "event_id", "event_type", "title")


def attribute_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("user_id", "event_type", "event_id", F.when(F.col("event_id") % 2 == 0, F.round("value", 4)).alias("amount"), F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 7 == 0, F.concat(F.lit("e"), F.col("event_id"))).alias("note"))
    return sequences.complete_first(e, ["user_id", "event_type"], ["event_id"], ["amount", "note"])


def bibliography_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by part type; entries by name, ties by key; the place of each entry in its section and how many it has."""
    w = W.partitionBy("p_type").orderBy(F.lower("p_name"), "p_partkey")
    parts = table(spark, sf_dir, "part").select("p_type", "p_name", "p_partkey")
    sizes = parts.groupBy("p_type").agg(F.count(F.lit(1)).alias("entries"))
    return parts.withColumn("place", F.row_number().over(w)).join(sizes, "p_type")


def surname_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short title of each part: its last word; where different names share one, the whole name; where whole names do, with the key."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name").withColumn("surname", F.element_at(F.split("p_name", " "), -1))
    names = parts.groupBy("surname").agg(F.count_distinct("p_name").alias("names"), F.count(F.lit(1)).alias("of_surname"))
    same = parts.groupBy("p_name").agg(F.count(F.lit(1)).alias("of_name"))
    joined = parts.join(names, "surname").join(same, "p_name")
    title = F.when(F.col("of_surname") == 1, F.col("surname")).when(F.col("of_name") == 1, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")))
    return joined.select("p_partkey", title.alias("short_title"))


def wildcard_unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    m = p.select("p_partkey", "p_type", F.col("p_name").alias("base"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("brand"), F.when(F.col("p_partkey") % 4 != 0, (F.col("p_size") % 5).cast("string")).alias("size"))
    return unify.unify(m, ["p_type", "base"], ["p_partkey"], ["brand", "size"])


def style_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest explicit flag up a chain of parents (part key div 7), by doubling."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") >= 7, F.floor(F.col("p_partkey") / 7).cast("long")).alias("parent"), F.when(F.col("p_size") % 5 == 0, F.col("p_size") % 2 == 0).alias("flag"))
    found = pointers.ends(nodes.withColumn("flagged", F.col("flag").isNotNull()), ["id"], ["parent"], "flagged")
    flags = nodes.select(F.col("id").alias("end_id"), "flag")
    return found.join(flags, "end_id", "left").select("id", "flag", F.col("steps").cast("int").alias("depth"))


def canonical_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written variants of nation names to nations, by normalised key; unmatched ones keep what was written."""
    nation = table(spark, sf_dir, "nation")
    k = F.col("c_custkey") % 4
    customers = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    written = F.when(k == 0, F.lower("n_name")).when(k == 1, F.concat(F.lit(" "), F.col("n_name"), F.lit(". "))).when(k == 2, F.regexp_replace("n_name", "(.)", "$1.")).otherwise(F.concat(F.lit("new "), F.col("n_name")))
    rows = customers.select("c_custkey", written.alias("written"))
    known = nation.select(norm_key(F.col("n_name")).alias("key"), F.col("n_name").alias("canonical")).dropDuplicates(["key"])
    # Nations: 25 rows, whatever the scale.
    joined = rows.withColumn("key", norm_key(F.col("written"))).join(F.broadcast(known), "key", "left")
    return joined.select("c_custkey", F.coalesce("canonical", "written").alias("canonical"), F.col("canonical").isNull().alias("unmatched"))


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line item: how many other spans of its order overlap its own, half open: those that start before its end, without those that end by its start.

    One sweep over the sorted ends of an order's spans; no span meets another one."""
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("double").alias("a"), (F.col("l_linenumber") + F.col("l_quantity")).cast("double").alias("b"))
    # Equal spans have equal counts, so they go through the sweep once, with their number.
    once = spans.groupBy("l_orderkey", "a", "b").agg(F.count(F.lit(1)).alias("m"))
    # At one place: what asks for starts before it, ends, what asks for ends up to it, starts.
    points = (("b", 0, "asks_b"), ("b", 1, "end"), ("a", 2, "asks_a"), ("a", 3, "start"))
    marks = F.array(*[F.struct(F.col(at).alias("at"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind")) for at, rank, kind in points])
    swept = W.partitionBy("l_orderkey").orderBy("p.at", "p.rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = lambda kind: F.sum(F.when(F.col("p.kind") == kind, F.col("m")).otherwise(0)).over(swept)
    rows = once.select("*", F.explode(marks).alias("p")).withColumns({"starts": seen("start"), "ends": seen("end")})
    counted = rows.groupBy("l_orderkey", "a", "b", "m").agg((F.max(F.when(F.col("p.kind") == "asks_b", F.col("starts"))) - F.max(F.when(F.col("p.kind") == "asks_a", F.col("ends"))) - 1).cast("int").alias("overlaps"))
    return counted.select("l_orderkey", "a", "b", "overlaps", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("_n")).drop("_n")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_shipdate", "l_linenumber", "l_orderkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    joined = lines.join(by_merge(parts), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("l_suppkey").alias("court"), F.year("l_shipdate").alias("year"), F.col("l_quantity").cast("int").alias("number"), F.col("p_name").alias("title"), "l_linenumber", "l_orderkey")


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = verify.build_index(_records(spark, sf_dir).select("court", "year", "number", "title"))
    return index.select("court", "year", "number", F.array_join("titles", "|").alias("titles"))


def index_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.coverage(verify.build_index(_records(spark, sf_dir)), 1998)


def mnc_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims are the later lines of each order, their number shifted now and then beyond the end."""
    records = _records(spark, sf_dir)
    index = verify.build_index(records.where("l_linenumber <= 3"))
    shift = (F.col("l_orderkey") % 7) * 3
    claims = records.where("l_linenumber > 3").select("court", "year", (F.col("number") + shift).cast("int").alias("number"), F.col("title").alias("name"))
    return verify.check_claims(claims, index, 1998).groupBy("court", "year", "outcome").agg(F.count(F.lit(1)).alias("n"))


_PARTIES = "CASE p_partkey % 5 WHEN 0 THEN p_name || ' v ' || p_type WHEN 1 THEN 'Australian Competition & Consumer Commission v ' || p_name || ' Pty Ltd [No 3]' WHEN 2 THEN 'Re ' || p_name || '; Ex parte ' || p_brand WHEN 3 THEN 'AGS v ' || p_name ELSE p_name END"
_CITED = "CASE p_partkey % 6 WHEN 0 THEN p_name || ' v The Queen' WHEN 1 THEN 'ACCC v ' || p_name WHEN 2 THEN p_name || ' v ' || p_type WHEN 3 THEN 'R v R' WHEN 4 THEN 'Alpine Glacier Society v ' || p_name ELSE 'Ex parte ' || p_brand || ' (No 2)' END"
_DECIDED = {"court": "l_suppkey", "year": "CASE WHEN l_quantity <> 7 THEN CAST(year(l_shipdate) AS INT) END", "number": "CASE WHEN l_linenumber <> 5 THEN CAST(l_quantity AS INT) END", "title": _PARTIES}
_ASKED = {"claim": "p_partkey", "court": "p_partkey % 100 + 1", "year": "CASE WHEN p_partkey % 50 <> 0 THEN CAST(1992 + p_size % 7 AS INT) END", "name": _CITED}


def reported_band_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases known by report only, found by their parties; some decisions have no year or number."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    records = lines.join(by_merge(parts), F.col("l_partkey") == F.col("p_partkey")).selectExpr(*[f"{x} AS {c}" for c, x in _DECIDED.items()])
    return names.party_match(parts.selectExpr(*[f"{x} AS {c}" for c, x in _ASKED.items()]), records, "claim")


def year_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts cited with a size that their name and type never has."""
    p = table(spark, sf_dir, "part")
    known = p.where("p_partkey % 2 = 0").groupBy("p_name", "p_type").agg(F.array_sort(F.collect_set("p_size")).alias("sizes"))
    claims = p.where("p_partkey % 2 = 1").select("p_partkey", "p_name", "p_type", "p_size")
    return claims.join(known, ["p_name", "p_type"]).where(~F.array_contains("sizes", F.col("p_size"))).select("p_partkey", "p_size", F.array_join(F.col("sizes").cast("array<string>"), ",").alias("sizes"))


def batch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _numbered_events(spark, sf_dir).withColumn("failed", F.col("event_type").isin("error", "view"))
    return sequences.failed_batches(e, "user_id", "number", 3)


def preview_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed rows (errors) past the first k of a user are locked; k is a tenth of the rows, one to three."""
    e = _numbered_events(spark, sf_dir)
    sizes = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    k = F.least(F.lit(3), F.greatest(F.lit(1), F.ceil(F.round(F.col("n") * 0.1, 9))))
    shown = sequences.first_k_true(e.join(sizes, "user_id"), "user_id", ["number"], F.col("event_type") == "error", k)
    return shown.select("user_id", "number", "shown", F.when(F.col("shown"), F.col("event_type")).alias("event_type"))


def free_use_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return e.groupBy("day").agg(F.count(F.lit(1)).alias("all_uses"), F.count_if(F.col("event_type") != "error").alias("not_failed"), F.count_if(F.col("event_type") == "purchase").alias("unlocked"), F.count_distinct("user_id").alias("browsers"))


def quota_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three uses of a user and day are admitted."""
    e = _events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return sequences.admitted(e, ["user_id", "day"], ["ts", "event_id"], 3).select("event_id", "user_id", "day", "admitted")


def ledger_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type IN ('purchase', 'error')")
    entries = e.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", 3).otherwise(-1).alias("delta"))
    return sequences.running_balance(entries, "user_id", ["ts", "event_id"], "delta").select("event_id", "user_id", "delta", "balance")


def idempotent_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases applied once each, however often they are told: replays of every third event change nothing."""
    e = _events(spark, sf_dir)
    told = e.unionByName(e.where("event_id % 3 = 0")).unionByName(e.where("event_id % 6 = 0"))
    once = told.where("event_type IN ('purchase', 'error')").dropDuplicates(["event_id"])
    return once.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("settled"), F.count_if(F.col("event_type") == "error").alias("refunded"), F.max("event_id").alias("last_event"))


def retention_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders before a cutoff without a line shipped after it."""
    cutoff = F.lit("1996-01-01").cast("timestamp")
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < cutoff).select("o_orderkey", "o_custkey")
    recent = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= cutoff).select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(recent, "o_orderkey", "left_anti")


def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: filled orders first, then the latest, ties to the greatest key. One map-side combined sum, no sort of orders."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    rank = F.struct((F.col("o_orderstatus") == "F").cast("int"), "o_orderdate", "o_orderkey")
    best = o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), rank).alias("b"))
    return best.select("o_custkey", "b.o_orderkey", "b.o_orderstatus")


def recent_and_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _numbered_events(spark, sf_dir)
    done = (F.col("event_id") % 4) != 0
    return sequences.recent_and_next(e, "user_id", ["number"], done).select("user_id", "number", "done")


def heading_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.islands(_numbered_events(spark, sf_dir), "user_id", ["number"], F.col("event_type") == "error")


QUERIES = {f.__name__: f for f in (
    citation_plan_events, share_first_nonnull, attribute_completion, bibliography_sections, surname_collisions, wildcard_unify, style_chain,
    canonical_lookup, interval_overlap, index_build, index_coverage, mnc_check, reported_band_match, year_mismatch, batch_failures, preview_redaction,
    free_use_counts, quota_admission, ledger_balance, idempotent_settle, retention_expired, latest_order, recent_and_next, heading_islands,
)}

_NUM = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS number FROM events"
_REC = "SELECT l_suppkey AS court, year(l_shipdate)::INT AS year, l_quantity::INT AS number, p_name AS title, l_linenumber, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey"


def _index(source: str) -> str:
    return f"i0 AS (SELECT court, year, number, list_sort(list_distinct(list(title))) AS titles FROM ({source}) GROUP BY court, year, number), ix AS (SELECT * FROM i0 WHERE court IN (SELECT court FROM i0 GROUP BY court HAVING count(*) >= 50))"


_COVER = "cv AS (SELECT court, year, count(*) AS n, max(number) AS last, count(*) >= 10 AND year < 1998 AND count(*) >= 0.85::DOUBLE * max(number) AS covered FROM ix GROUP BY court, year)"


def _columns(of: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {c}" for c, x in of.items())


ORACLE_SQL = {
    "citation_plan_events": f"WITH e AS ({_NUM}) SELECT user_id AS doc, number AS note, event_type AS key, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY number) = 1 THEN 'full' WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY number) = event_type THEN 'ibid' ELSE 'subsequent' END AS plan FROM e",
    "share_first_nonnull": "WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 3 = 0 THEN event_id END AS title FROM events) SELECT user_id, event_id, event_type, coalesce(title, min(title) OVER (PARTITION BY user_id, event_type)) AS title FROM e",
    "attribute_completion": "WITH e AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 2 = 0 THEN round(value, 4) END AS amount, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'e' || event_id END AS note FROM events) SELECT user_id, event_type, arg_min(amount, event_id) FILTER (amount IS NOT NULL) AS amount, arg_min(note, event_id) FILTER (note <> '') AS note FROM e GROUP BY ALL",
    "bibliography_sections": "SELECT p_type, p_name, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY lower(p_name), p_partkey)::INT AS place, count(*) OVER (PARTITION BY p_type) AS entries FROM part",
    "surname_collisions": "WITH p AS (SELECT p_partkey, p_name, split_part(p_name, ' ', -1) AS surname FROM part) SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY surname) = 1 THEN surname WHEN count(*) OVER (PARTITION BY p_name) = 1 THEN p_name ELSE p_name || ' ' || p_partkey END AS short_title FROM p",
    "style_chain": "WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 7 THEN p_partkey // 7 END AS parent, CASE WHEN p_size % 5 = 0 THEN p_size % 2 = 0 END AS flag FROM part), w AS (SELECT id, parent AS up, flag, 0 AS depth FROM n UNION ALL SELECT w.id, n.parent, n.flag, depth + 1 FROM w JOIN n ON n.id = w.up WHERE w.flag IS NULL) SELECT n.id, any_value(w.flag) FILTER (w.flag IS NOT NULL) AS flag, min(depth) FILTER (w.flag IS NOT NULL) AS depth FROM n JOIN w USING (id) GROUP BY n.id",
    "canonical_lookup": "WITH r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN ' ' || n_name || '. ' WHEN 2 THEN regexp_replace(n_name, '(.)', '\\1.', 'g') ELSE 'new ' || n_name END AS written FROM customer JOIN nation ON c_nationkey = n_nationkey), k AS (SELECT *, regexp_replace(lower(written), '[., ]', '', 'g') AS key FROM r) SELECT c_custkey, coalesce(n_name, written) AS canonical, n_name IS NULL AS unmatched FROM k LEFT JOIN nation ON regexp_replace(lower(n_name), '[., ]', '', 'g') = key",
    "interval_overlap": "WITH s AS (SELECT l_orderkey, l_linenumber::DOUBLE AS a, l_linenumber + l_quantity AS b, row_number() OVER () AS id FROM lineitem) SELECT x.l_orderkey, x.a, x.b, (count(*) - 1)::INT AS overlaps FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND y.a < x.b AND x.a < y.b GROUP BY x.id, x.l_orderkey, x.a, x.b",
    "index_build": f"WITH {_index(_REC)} SELECT court, year, number, array_to_string(titles, '|') AS titles FROM ix",
    "index_coverage": f"WITH {_index(_REC)}, {_COVER} SELECT court, year, n, last, covered FROM cv",
    "mnc_check": f"""WITH r AS ({_REC}), {_index("SELECT * FROM r WHERE l_linenumber <= 3")}, {_COVER},
c AS (SELECT court, year, (number + (l_orderkey % 7) * 3)::INT AS number, title AS name FROM r WHERE l_linenumber > 3),
{with_steps("j", "SELECT * FROM c LEFT JOIN ix USING (court, year, number) LEFT JOIN cv USING (court, year)", verify.name_steps(DUCK))},
o AS (SELECT court, year, CASE WHEN titles IS NOT NULL THEN CASE WHEN named THEN 'found' ELSE 'name mismatch' END
  WHEN covered AND number > last + greatest(3, last // 20) THEN 'not found' ELSE 'unchecked' END AS outcome FROM j)
SELECT court, year, outcome, count(*) AS n FROM o GROUP BY ALL""",
    "reported_band_match": f"""WITH {with_steps("r", f"SELECT DISTINCT {_columns(_DECIDED)} FROM lineitem JOIN part ON l_partkey = p_partkey", names.reading(DUCK, "title", "t"))},
{with_steps("c", f"SELECT {_columns(_ASKED)} FROM part", names.reading(DUCK, "name", "c"))}
SELECT claim, r.year AS match_year, number AS match_number, title AS match_title FROM c JOIN r ON c.court = r.court AND coalesce(r.year BETWEEN c.year - 1 AND c.year, c.year IS NOT NULL) AND {DUCK.size("c_sides")} > 0 AND {names.names_each_side(DUCK, "c", "t")}
QUALIFY row_number() OVER (PARTITION BY claim ORDER BY r.year NULLS LAST, number NULLS LAST, title) = 1""",
    "year_mismatch": "WITH k AS (SELECT p_name, p_type, list_sort(list_distinct(list(p_size))) AS sizes FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL) SELECT p_partkey, p_size, array_to_string(sizes, ',') AS sizes FROM part JOIN k USING (p_name, p_type) WHERE p_partkey % 2 = 1 AND NOT list_contains(sizes, p_size)",
    "batch_failures": f"WITH e AS ({_NUM}), b AS (SELECT user_id, (number - 1) // 3 AS batch, count(*) AS n, count(*) FILTER (event_type IN ('error', 'view')) AS f FROM e GROUP BY ALL), p AS (SELECT user_id, sum(n)::BIGINT AS n, sum(f)::BIGINT AS n_failed, bool_or(n = f) AS whole_batch_failed FROM b GROUP BY user_id) SELECT *, n_failed = 0 OR (NOT whole_batch_failed AND 5 * n_failed <= n) AS payable FROM p",
    "preview_redaction": f"WITH e AS ({_NUM}), s AS (SELECT *, least(3, greatest(1, ceil(round(count(*) OVER (PARTITION BY user_id) * 0.1, 9)))) AS k, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY number) AS c FROM e), t AS (SELECT *, event_type <> 'error' OR c <= k AS shown FROM s) SELECT user_id, number, shown, CASE WHEN shown THEN event_type END AS event_type FROM t",
    "free_use_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS all_uses, count(*) FILTER (event_type <> 'error') AS not_failed, count(*) FILTER (event_type = 'purchase') AS unlocked, count(DISTINCT user_id) AS browsers FROM events GROUP BY 1",
    "quota_admission": "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) <= 3 AS admitted FROM events",
    "ledger_balance": "WITH e AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 3 ELSE -1 END AS delta FROM events WHERE event_type IN ('purchase', 'error')) SELECT event_id, user_id, delta, sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS balance FROM e",
    "idempotent_settle": "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS settled, count(*) FILTER (event_type = 'error') AS refunded, max(event_id) AS last_event FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id",
    "retention_expired": "SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderdate < TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= TIMESTAMP '1996-01-01')",
    "latest_order": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderdate DESC, o_orderkey DESC) = 1",
    "recent_and_next": f"WITH e AS (SELECT user_id, number, event_id % 4 <> 0 AS done FROM ({_NUM})) SELECT * FROM e QUALIFY CASE WHEN done THEN row_number() OVER (PARTITION BY user_id, done ORDER BY number DESC) <= 20 ELSE row_number() OVER (PARTITION BY user_id, done ORDER BY number) <= 3 END",
    "heading_islands": f"WITH e AS ({_NUM}), f AS (SELECT user_id, number, event_type = 'error' AS x, coalesce(lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY number), false) AS y FROM e), g AS (SELECT *, sum((x AND NOT y)::INT) OVER (PARTITION BY user_id ORDER BY number)::BIGINT AS island FROM f) SELECT user_id, island, count(*) AS n, min(number) AS first FROM g WHERE x GROUP BY user_id, island",
}
