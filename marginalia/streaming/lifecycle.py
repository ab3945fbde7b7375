"""Streams with state and time: several limits at once, orders by compare-and-set, state that expires, charges without an end.

`within_limits` lets a use through while its address, its visitor and the day are all below their limits; a use that one of them
refuses counts for none. The state of a day holds what was let through, so it is no larger than the day's limit.

`order_states` moves an order from status to status by events that say which status they expect. Events may come repeatedly and in
any order: an order keeps its different events, a late one is put in its place, and the result is that of all of them by time (equal
times: by id). What found another status than it expected is a conflict and changes nothing.

`expired` closes what has seen nothing for `ttl`: by an event-time timer when the watermark passes, or by the next event after a longer
pause. Each closing gives one row; state without a row yet is younger than the watermark less ttl.

`compensated` pairs a charge with the first end of its run within `within`, by a stream-stream outer join; a charge without one is given
back once the watermark is past the time in which it could still come.

All keep their state in RocksDB and run to the end of what is there (availableNow). A batch that is run again after a failure replaces its own
output. Rows with a null key form a group of their own; rows with a null time are left out, for they have no place in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marginalia.workspace import new_folder

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocks_state(spark: SparkSession) -> Iterator[None]:
    """User-defined state needs this store; the session's own choice comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_to_end(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All rows that the stream gives, with the number of the batch that gave them."""
    spark, folder = stream.sparkSession, new_folder(stream.sparkSession, name)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    with _rocks_state(spark):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{folder}/out")


def _rows(chunks: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """The rows of one key in this batch, in order."""
    return pd.concat(list(chunks)).sort_values(by, kind="stable")


class _Limits(StatefulProcessor):
    def __init__(self, per_address: int, per_visitor: int, per_day: int) -> None:
        self.limits = per_address, per_visitor, per_day

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n bigint")
        self.seen = handle.getMapState("seen", "kind string, who string", "n bigint")

    def _count(self, kind: str, who: str | None) -> int:
        return self.seen.getValue((kind, who))[0] if who is not None and self.seen.containsKey((kind, who)) else 0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        per_address, per_visitor, per_day = self.limits
        total = self.total.get()[0] if self.total.exists() else 0
        table = _rows(rows, ["ts", "id"])
        verdicts = []
        for address, visitor in zip(table["address"], table["visitor"], strict=True):
            verdict = "global" if total >= per_day else None
            if verdict is None:
                by_address, by_visitor = self._count("address", address), self._count("visitor", visitor)
                if by_address >= per_address or by_visitor >= per_visitor:
                    verdict = "visitor"
                else:
                    total += 1
                    for kind, who, n in (("address", address, by_address), ("visitor", visitor, by_visitor)):
                        if who is not None:
                            self.seen.updateValue((kind, who), (n + 1,))
            verdicts.append(verdict)
        self.total.update((total,))
        yield pd.DataFrame({"id": table["id"], "day": key[0], "refused_by": pd.Series(verdicts, index=table.index, dtype="object")})

    def close(self) -> None:
        pass


def within_limits(uses: DataFrame, per_address: int, per_visitor: int, per_day: int) -> DataFrame:
    """uses: a stream of id (long), ts, day, address, visitor (strings; null: not known, not limited). id, day and refused_by: null, 'visitor' or 'global'.

    Uses of one batch are taken by time and id, batches as they come. Of one address and visitor together only the first few of a day can
    get through, so what the day's one sequence has to look at is kept short by the caller where a batch is large (see `contenders`)."""
    known = uses.where("ts IS NOT NULL").select(F.col("id").cast("long"), "ts", "day", "address", "visitor")
    admitted = known.groupBy("day").transformWithStateInPandas(_Limits(per_address, per_visitor, per_day), "id bigint, day string, refused_by string", "append", "None")
    return run_to_end(admitted, "limits", "append").drop("batch")


_MOVES = "order_key bigint, status string, applied bigint, conflicts bigint, last_event bigint"


def replay(events: list[tuple[pd.Timestamp | int, int, str, str]], first: str) -> tuple[str, int, int, int | None]:
    """Status, moves, conflicts and last applied event of (time, id, expected, next) in any order."""
    status, applied, conflicts, last = first, 0, 0, None
    for _, event, expected, following in sorted(events):
        if status == expected:
            status, applied, last = following, applied + 1, event
        else:
            conflicts += 1
    return status, applied, conflicts, last


class _Orders(StatefulProcessor):
    """Each call of the state is a message to the JVM, so a batch reads an order's events once and adds its new ones together."""

    def __init__(self, first: str) -> None:
        self.first = first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", "id bigint, us bigint, expected string, following string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = {int(e[0]): (int(e[1]), int(e[0]), e[2], e[3]) for e in self.events.get()} if self.events.exists() else {}
        new = []
        for table in rows:
            for us, event, expected, following in zip(table["us"].tolist(), table["id"].tolist(), table["expected"].tolist(), table["following"].tolist(), strict=True):
                if int(event) not in known:
                    known[int(event)] = (us, int(event), expected, following)
                    new.append((int(event), us, expected, following))
        if new:
            self.events.appendList(new)
            status, applied, conflicts, last = replay(list(known.values()), self.first)
            yield pd.DataFrame({"order_key": pd.array([key[0]], "Int64"), "status": [status], "applied": [applied], "conflicts": [conflicts], "last_event": pd.array([last], "Int64")})

    def close(self) -> None:
        pass


def order_states(moves: DataFrame, first: str = "pending") -> DataFrame:
    """moves: a stream of order_key, id, ts, expected, following. Per order: status, moves applied, conflicts, last event applied.

    An order's state grows with its different events, which its life bounds; repeated ones add nothing."""
    known = moves.where("ts IS NOT NULL").select(F.col("order_key").cast("long"), F.col("id").cast("long"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "expected", "following")
    updates = known.groupBy("order_key").transformWithStateInPandas(_Orders(first), _MOVES, "update", "None")
    rows = run_to_end(updates, "orders", "update")
    return rows.groupBy("order_key").agg(F.max_by(F.struct("status", "applied", "conflicts", "last_event"), "batch").alias("r")).select("order_key", "r.*")


_CLOSED = "who bigint, first_ms bigint, last_ms bigint, n bigint"


class _Expiry(StatefulProcessor):
    def __init__(self, ttl_ms: int) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first_ms bigint, last_ms bigint, n bigint")

    def _closed(self, key, spans: list[tuple[int, int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"who": pd.array([key[0]] * len(spans), "Int64"), "first_ms": [s[0] for s in spans], "last_ms": [s[1] for s in spans], "n": [s[2] for s in spans]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        span, closed = (tuple(self.open.get()) if self.open.exists() else None), []
        for at in sorted(int(ms) for table in rows for ms in table["ms"]):
            if span is not None and at - span[1] > self.ttl:
                closed.append(span)
                span = None
            # An event from before the open span (late, but within the watermark) widens it.
            span = (at, at, 1) if span is None else (min(span[0], at), max(span[1], at), span[2] + 1)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        assert span is not None  # a call has at least one row
        self.open.update(span)
        self.handle.registerTimer(span[1] + self.ttl + 1)
        yield self._closed(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        span = tuple(self.open.get())
        self.open.clear()
        yield self._closed(key, [span])

    def close(self) -> None:
        pass


def expired(events: DataFrame, ttl_ms: int, delay: str) -> DataFrame:
    """events: a stream of who (long) and ts. Per closed span of activity: who, its first and last time (milliseconds) and number of events."""
    timed = events.where("ts IS NOT NULL").withWatermark("ts", delay).select(F.col("who").cast("long"), "ts", F.unix_millis("ts").alias("ms"))
    return run_to_end(timed.groupBy("who").transformWithStateInPandas(_Expiry(ttl_ms), _CLOSED, "append", "EventTime"), "expiry", "append").drop("batch")


def compensated(charges: DataFrame, ends: DataFrame, within: str, delay: str) -> DataFrame:
    """charges: a stream of charge (long), run, ts; ends: a stream of run, ts, ended (string). charge, run, outcome: the first end's, or 'given back'."""
    left = charges.where("ts IS NOT NULL").select("charge", F.col("run").alias("run"), F.col("ts").alias("charged_at")).withWatermark("charged_at", delay)
    right = ends.where("ts IS NOT NULL").select(F.col("run").alias("ended_run"), F.col("ts").alias("ended_at"), "ended").withWatermark("ended_at", delay)
    in_time = F.expr(f"run = ended_run AND ended_at >= charged_at AND ended_at <= charged_at + INTERVAL {within}")
    pairs = run_to_end(left.join(right, in_time, "leftOuter").select("charge", "run", "ended_at", "ended"), "charges", "append")
    first = pairs.groupBy("charge", "run").agg(F.min_by("ended", F.struct("ended_at", "ended")).alias("ended"))
    return first.select("charge", "run", F.coalesce("ended", F.lit("given back")).alias("outcome"))


def contenders(uses: DataFrame, per_address: int, per_visitor: int) -> DataFrame:
    """Of a table of uses those that `within_limits` can let through: of a day, address and visitor together the first ones.

    Counts only grow, so what is refused for an address and visitor once is refused for them all day."""
    from pyspark.sql import Window as W

    w = W.partitionBy("day", "address", "visitor").orderBy("ts", "id")
    return uses.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= min(per_address, per_visitor)).drop("_nth")


def stream_of(spark: SparkSession, sf_dir: str, name: str, select: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return select(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}*.parquet"))
