"""Streams in event time: late rows, ordered folds and expiry, against the batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import usage as U
from corvane.streaming import logs as S
from corvane.streaming import ordered as O
from tests.test_logs import START, attempts, budget_loop


def shuffled(rows, at, late, seed=9):
    """Rows in an order of arrival in which none is more than `late` seconds behind the newest one before it."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: at(r) + dt.timedelta(seconds=rng.uniform(0, late * 0.9)))


def arrive(spark, rows, schema, folder, parts):
    """One file per trigger, in order of arrival, then a row that lets the watermark pass all others."""
    step = -(-len(rows) // parts)
    for p in range(parts):
        spark.createDataFrame(rows[p * step : (p + 1) * step], schema).coalesce(1).write.parquet(f"{folder}/{p}")
    return spark.createDataFrame([], schema).schema


def start(spark, folder, schema, late):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def drain(df, name):
    """Rows of the stream and the rows of state that are left."""
    q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return df.sparkSession.table(name).collect(), q.lastProgress["stateOperators"][0]["numRowsTotal"]


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "in")


SENTINEL = START + dt.timedelta(days=400)


def test_late_attempts_give_the_batch_outcomes(spark, folder):
    rows, df = attempts(spark, 400)
    late = shuffled(rows, lambda r: r[2], 600)
    assert late != rows
    schema = arrive(spark, [*late, (99, 10**6, SENTINEL, True)], df.schema, folder, 4)
    got, _ = drain(O.lockout_in_order(start(spark, folder, schema, "10 minutes")), "ordered_lockouts")
    want = {r.event_id: r.outcome for r in U.attempt_lockout(df).collect()}
    assert {r.event_id: r.outcome for r in got} == want


def test_lockout_state_is_empty_when_nothing_counts(spark, folder):
    rows = [(u, u * 10 + i, START + dt.timedelta(seconds=i), i == 3) for u in range(20) for i in range(4)]
    rows += [(u, 1000 + u * 10 + i, START + dt.timedelta(seconds=50 + i), False) for u in range(5) for i in range(5)]
    schema = "user_id long, event_id long, ts timestamp_ntz, ok boolean"
    kinds = arrive(spark, [*rows, (99, 10**6, SENTINEL, True)], schema, folder, 1)
    got, left = drain(O.lockout_in_order(start(spark, folder, kinds, "10 minutes")), "closed_lockouts")
    assert len(got) == len(rows) and sum(r.outcome == "locking" for r in got) == 5
    _, control = drain(O.lockout_in_order(start(spark, one_row(spark, schema, folder), kinds, "10 minutes")), "one_lockout")
    assert left == control


def one_row(spark, schema, folder):
    """A folder with the last row alone: what its own key keeps is all that may be left of the others."""
    alone = f"{folder}-alone"
    row = {"user_id": (99, 10**6, SENTINEL, True), "key": ("z", 10**6, SENTINEL), "conv_id": (99, 10**6, SENTINEL, "user", "x")}
    spark.createDataFrame([row[schema.split()[0]]], schema).coalesce(1).write.parquet(alone)
    return alone


def test_failures_of_a_user_who_stays_away_are_forgotten(spark, folder):
    rows = [(1, i, START + dt.timedelta(seconds=i), False) for i in range(4)]
    rows += [(1, 10, START + dt.timedelta(hours=2), False), (99, 10**6, SENTINEL, True)]
    kinds = arrive(spark, rows, "user_id long, event_id long, ts timestamp_ntz, ok boolean", folder, 1)
    for idle, outcome in ((3600, "failed"), (None, "locking")):
        got, _ = drain(O.lockout_in_order(start(spark, folder, kinds, "10 minutes"), idle), f"away_{idle}")
        assert {r.event_id: r.outcome for r in got}[10] == outcome


def test_late_reads_give_the_batch_fetches_and_state_expires(spark, folder):
    rows, df = attempts(spark, 400)
    keyed = [(str(u), i, ts) for u, i, ts, _ in rows]
    schema = "key string, event_id long, ts timestamp_ntz"
    kinds = arrive(spark, [*shuffled(keyed, lambda r: r[2], 600), ("z", 10**6, SENTINEL)], schema, folder, 4)
    got, left = drain(O.ttl_cache_in_order(start(spark, folder, kinds, "10 minutes"), 600), "ordered_ttls")
    want = U.ttl_fetches(spark.createDataFrame(keyed, schema), ttl=600)
    assert {r.event_id: r.state for r in got} == {r.event_id: r.state for r in want.collect()}
    _, control = drain(O.ttl_cache_in_order(start(spark, one_row(spark, schema, folder), kinds, "10 minutes"), 600), "one_ttl")
    assert left == control


def test_sessions_remember_the_newest_messages_and_end(spark, folder):
    rows = [(c, t, START + dt.timedelta(seconds=60 * t + c), "reset" if (c, t) == (1, 9) else "user", f"m{t}") for t in range(15) for c in range(3)]
    rows.append((0, 15, START + dt.timedelta(hours=9), "user", "back"))
    schema = "conv_id long, turn long, ts timestamp_ntz, role string, text string"
    kinds = arrive(spark, [*shuffled(rows, lambda r: r[2], 600), (99, 10**6, SENTINEL, "user", "x")], schema, folder, 3)
    got, left = drain(O.session_memory_in_order(start(spark, folder, kinds, "10 minutes"), idle=3600), "ordered_memories")
    seen = {(r.conv_id, r.turn): (r.messages, r.oldest) for r in got}
    assert seen[2, 14] == (8, 7) and seen[1, 9] == (0, None) and seen[1, 14] == (5, 10) and seen[0, 14] == (8, 7) and seen[0, 15] == (1, 15)
    _, control = drain(O.session_memory_in_order(start(spark, one_row(spark, schema, folder), kinds, "10 minutes"), idle=3600), "one_memory")
    assert left == control


def test_late_calls_are_spent_in_event_time(spark, folder, tmp_path):
    rng = random.Random(3)
    rows = [(i, START + dt.timedelta(minutes=7 * i), rng.choice([1, 3, 50])) for i in range(400)]
    late = shuffled(rows, lambda r: r[1], 3600)
    schema = "event_id long, ts timestamp_ntz, units int"
    kinds = arrive(spark, [*late, (10**6, SENTINEL, 1)], schema, folder, 4)
    day = F.to_date("ts").cast("string")
    calls = O.released(start(spark, folder, kinds, "1 hour"), spread=4)
    out = str(tmp_path / "out")
    S.daily_budget_stream(calls, day, out, str(tmp_path / "cp"), order=["event_id"], units="units", budget=600).awaitTermination(240)
    got = {r.event_id: r.accepted for r in spark.read.option("basePath", out).parquet(out).where(F.col("event_id") < 10**6).collect()}
    assert got == budget_loop([(str(ts.date()), i, u) for i, ts, u in rows], 600) and not all(got.values())
