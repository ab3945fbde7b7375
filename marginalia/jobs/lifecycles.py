"""Queries over streams of the events table: limits, orders, expiry, compensation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.streaming import lifecycle

#: What an event asks of its user's order: status expected and status after.
_MOVES = {"signup": ("pending", "paid"), "purchase": ("paid", "delivered"), "error": ("paid", "refunding"), "view": ("refunding", "refunded"), "click": ("refunded", "pending")}
_TTL_MS = 12 * 3600 * 1000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.stream_of(spark, sf_dir, "events", lambda e: e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type"))


def limited_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's uses: two for each address (user) and three for each visitor (groups of 17 users), 200 in all; users of group 0 have no visitor."""
    group = F.when(F.col("user_id") % 17 != 0, (F.col("user_id") % 17).cast("string"))
    uses = _events(spark, sf_dir).select(F.col("event_id").alias("id"), "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").cast("string").alias("address"), group.alias("visitor"))
    return lifecycle.within_limits(uses, 2, 3, 200)


def order_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's order moved by their events; every third event is told twice."""
    e = _events(spark, sf_dir)
    told = e.unionByName(_events(spark, sf_dir).where("event_id % 3 = 0"))
    pick = lambda k: F.create_map(*[F.lit(x) for name, move in _MOVES.items() for x in (name, move[k])])[F.col("event_type")]
    return lifecycle.order_states(told.select(F.col("user_id").alias("order_key"), F.col("event_id").alias("id"), "ts", pick(0).alias("expected"), pick(1).alias("following")))


def expired_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a user's events that ended twelve hours before the last event of all (less a minute) or before their next one."""
    return lifecycle.expired(_events(spark, sf_dir).select(F.col("user_id").alias("who"), "ts"), _TTL_MS, "1 minute")


def compensated_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and the first signup or error of the same user within six hours; those without one are given back."""
    charges = _events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("charge"), F.col("user_id").alias("run"), "ts")
    ends = _events(spark, sf_dir).where("event_type IN ('signup', 'error')").select(F.col("user_id").alias("run"), "ts", F.col("event_type").alias("ended"))
    return lifecycle.compensated(charges, ends, "6 HOURS", "1 minute")


QUERIES = {f.__name__: f for f in (limited_uses, order_lifecycle, expired_sessions, compensated_charges)}



def _case(k: int) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{name}' THEN '{move[k]}'" for name, move in _MOVES.items()) + " END"


ORACLE_SQL = {
    "order_lifecycle": f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {_case(0)} AS expected, {_case(1)} AS following, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE ts IS NOT NULL),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 'pending' AS status, 0::BIGINT AS applied, 0::BIGINT AS conflicts, NULL::BIGINT AS last_event FROM e
  UNION ALL SELECT e.user_id, e.k, CASE WHEN status = expected THEN following ELSE status END, applied + (status = expected)::BIGINT, conflicts + (status <> expected)::BIGINT, CASE WHEN status = expected THEN event_id ELSE last_event END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id AS order_key, status, applied, conflicts, last_event FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""",
    "expired_sessions": f"""WITH e AS (SELECT user_id AS who, epoch_us(ts) // 1000 AS ms FROM events), g AS (SELECT *, coalesce(ms - lag(ms) OVER (PARTITION BY who ORDER BY ms) > {_TTL_MS}, true) AS fresh FROM e),
n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY who ORDER BY ms ROWS UNBOUNDED PRECEDING) AS span FROM g), s AS (SELECT who, span, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n FROM n GROUP BY who, span)
SELECT who, first_ms, last_ms, n FROM s WHERE last_ms + {_TTL_MS} + 1 <= (SELECT max(ms) - 60000 FROM e) OR span < (SELECT max(z.span) FROM s z WHERE z.who = s.who)""",
    "compensated_charges": """WITH c AS (SELECT event_id AS charge, user_id AS run, ts FROM events WHERE event_type = 'purchase'), d AS (SELECT user_id AS run, ts, event_type AS ended FROM events WHERE event_type IN ('signup', 'error')),
w AS (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM d)) - INTERVAL 1 MINUTE AS mark),
j AS (SELECT charge, c.run, c.ts, arg_min(ended, (d.ts, ended)) AS ended FROM c LEFT JOIN d ON c.run = d.run AND d.ts >= c.ts AND d.ts <= c.ts + INTERVAL 6 HOURS GROUP BY ALL)
SELECT charge, run, coalesce(ended, 'given back') AS outcome FROM j WHERE ended IS NOT NULL OR date_trunc('millisecond', ts + INTERVAL 6 HOURS) < (SELECT date_trunc('millisecond', mark) FROM w)""",
}
