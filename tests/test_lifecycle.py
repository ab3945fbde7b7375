"""Streams with state against sequential replays, over several batches."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pandas as pd
import pytest

from marginalia.streaming import lifecycle

START = datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """A stream that gives each list of rows as a batch of its own."""

    def make(name, schema, *batches):
        import os
        import time

        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/{k:03d}")
            for folder, _, files in os.walk(f"{tmp_path}/{name}/{k:03d}"):
                for file in files:  # files are taken by age
                    os.utime(os.path.join(folder, file), (time.time() - 1000 + 10 * k,) * 2)
        return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")

    return make


def replayed(batches, per_address, per_visitor, per_day):
    seen, total, out = Counter(), Counter(), {}
    for rows in batches:
        for use, _, day, address, visitor in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0])):
            if total[day] >= per_day:
                out[use] = "global"
            elif seen[day, "a", address] >= per_address or seen[day, "v", visitor] >= per_visitor:
                out[use] = "visitor"
            else:
                out[use] = None
                total[day] += 1
                seen[day, "a", address] += address is not None
                seen[day, "v", visitor] += visitor is not None
    return out


USE = "id long, ts timestamp, day string, address string, visitor string"


def test_limits_equal_a_sequential_replay(stream, spark):
    draw = random.Random(3)
    batches = [[(100 * b + k, START + timedelta(minutes=draw.randrange(50)) if draw.random() > 0.05 else None, draw.choice(["d1", "d2", None]), draw.choice(["a", "b", "c", None]), draw.choice(["x", "y", "z", "w", None])) for k in range(25)] for b in range(4)]
    got = {r.id: r.refused_by for r in lifecycle.within_limits(stream("uses", USE, *batches), 3, 2, 9).collect()}
    assert got == replayed(batches, 3, 2, 9) and {None, "visitor", "global"} == set(got.values())
    one = [r for rows in batches for r in rows]
    kept = [tuple(r) for r in lifecycle.contenders(spark.createDataFrame(one, USE).where("ts is not null"), 3, 2).collect()]
    admitted = lambda rows: {use for use, verdict in replayed([rows], 3, 2, 9).items() if verdict is None}
    assert admitted(kept) == admitted(one) and len(kept) < len(one)


def test_what_one_limit_refuses_counts_for_no_other(stream):
    at = lambda k: START + timedelta(minutes=k)
    rows = [(1, at(1), "d", "a", "x"), (2, at(2), "d", "a", "y"), (3, at(3), "d", "b", "y")]
    got = {r.id: r.refused_by for r in lifecycle.within_limits(stream("one", USE, rows), 1, 1, 2).collect()}
    assert got == {1: None, 2: "visitor", 3: None}


MOVE = "order_key long, id long, ts timestamp, expected string, following string"


def test_orders_do_not_depend_on_the_order_of_events(stream):
    draw = random.Random(5)
    states = ["pending", "paid", "delivered", "refunding"]
    events = [(draw.choice([1, 2, 3, None]), k, START + timedelta(minutes=draw.randrange(20)), draw.choice(states), draw.choice(states)) for k in range(60)]
    want = {}
    for key in (1, 2, 3, None):
        status, applied, conflicts, last = "pending", 0, 0, None
        for _, k, _, expected, following in sorted((e for e in events if e[0] == key), key=lambda e: (e[2], e[1])):
            if status == expected:
                status, applied, last = following, applied + 1, k
            else:
                conflicts += 1
        want[key] = (status, applied, conflicts, last)
    for turn in range(2):
        told = events + draw.sample(events, 30) + [(1, 999, None, "pending", "lost")]
        draw.shuffle(told)
        rows = lifecycle.order_states(stream(f"moves{turn}", MOVE, told[:20], told[20:50], told[50:])).collect()
        assert {r.order_key: tuple(r)[1:] for r in rows} == want


def test_replay_of_nothing():
    assert lifecycle.replay([], "pending") == ("pending", 0, 0, None)
    t = pd.Timestamp(START)
    assert lifecycle.replay([(t, 2, "paid", "done"), (t, 1, "pending", "paid")], "pending") == ("done", 2, 0, 2)


def test_expiry_by_timer_and_by_the_next_event(stream):
    minute = lambda k: START + timedelta(minutes=k)
    batches = [[(1, minute(0)), (1, minute(2)), (2, minute(1)), (None, minute(1)), (5, None)], [(1, minute(30)), (3, minute(31))], [(2, minute(60)), (3, minute(33))], [(9, minute(100))]]
    rows = lifecycle.expired(stream("events", "who long, ts timestamp", *batches), 10 * 60_000, "1 minute").collect()
    base = int(pd.Timestamp(START).tz_localize("UTC").timestamp() * 1000)
    got = sorted((r.who or 0, (r.first_ms - base) // 60_000, (r.last_ms - base) // 60_000, r.n) for r in rows)
    assert got == [(0, 1, 1, 1), (1, 0, 2, 2), (1, 30, 30, 1), (2, 1, 1, 1), (2, 60, 60, 1), (3, 31, 33, 2)]


def test_charges_without_an_end_are_given_back(stream):
    minute = lambda k: START + timedelta(minutes=k)
    charges = stream("charges", "charge long, run string, ts timestamp", [(1, "a", minute(0)), (2, "b", minute(1)), (3, None, minute(1)), (4, "c", None)], [(5, "d", minute(200)), (6, "e", minute(300))])
    ends = stream("ends", "run string, ts timestamp, ended string", [("a", minute(9), "late"), ("a", minute(5), "done"), ("b", minute(40), "done")], [("d", minute(201), "failed"), ("x", minute(300), "done")])
    got = {r.charge: r.outcome for r in lifecycle.compensated(charges, ends, "10 MINUTES", "1 minute").collect()}
    assert got == {1: "done", 2: "given back", 3: "given back", 5: "failed"}
