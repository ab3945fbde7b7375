"""Streams of progress and payment events.

`fold_progress` keeps, per job, how many events of each kind came and the newest notes, in user-defined state; each
update replaces the job's row. `first_deliveries` lets each event through once, however often it is delivered within the
watermark. Both run to the end of what is there (availableNow) and leave a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.workspace import new_folder

NOTES = 5
_OUT = "user_id bigint, seen bigint, done bigint, failed bigint, notes string"
_STATE = "seen bigint, done bigint, failed bigint, notes array<string>"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, done, failed, notes = state.get if state.exists else (0, 0, 0, [])
    notes = list(notes)
    for rows in batches:
        seen += len(rows)
        done += int((rows["event_type"] == "purchase").sum())
        failed += int((rows["event_type"] == "error").sum())
        notes = sorted([*notes, *(f"{i:020d}" for i in rows["event_id"])])[-NOTES:]
    state.update((seen, done, failed, notes))
    yield pd.DataFrame([{"user_id": key[0], "seen": seen, "done": done, "failed": failed, "notes": ",".join(str(int(n)) for n in notes)}])


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events*.parquet")


def _finish(stream: DataFrame, folder: str, write, mode: str) -> None:
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    query = (query.foreachBatch(write) if write else query.format("parquet").option("path", f"{folder}/out")).start()
    query.awaitTermination()


def fold_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: events seen, done and failed, and the ids of the five newest."""
    folder = new_folder(spark, "progress")
    events = _stream(spark, sf_dir).select("user_id", "event_id", "event_type")
    updates = events.groupBy("user_id").applyInPandasWithState(_fold, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
    # A batch that is run again after a failure replaces its own folder.
    _finish(updates, folder, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}"), "update")
    rows = spark.read.schema(f"{_OUT}, batch bigint").parquet(f"{folder}/out")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("seen", "done", "failed", "notes"), "batch").alias("r")).select("user_id", "r.*")


def first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases per day from a stream that delivers every event twice.

    State is kept for 60 days of event time; an event that comes more than that after a later one counts as too late and is left out."""
    folder = new_folder(spark, "deliveries")
    columns = ["event_id", "ts", "event_type"]
    twice = _stream(spark, sf_dir).select(*columns).unionByName(_stream(spark, sf_dir).select(*columns)).where("event_type = 'purchase'")
    once = twice.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id"])
    _finish(once, folder, None, "append")
    rows = spark.read.schema("event_id bigint, ts timestamp, event_type string").parquet(f"{folder}/out")
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("purchases"), F.max("event_id").alias("last_event"))
