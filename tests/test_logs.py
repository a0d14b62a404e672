"""Usage logs, budgets, lockouts and caches: batch against loops, streams against batch; upkeep; evaluation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import jumps as J
from corvane.operators import maintain as M
from corvane.operators import usage as U
from corvane.plans import evaluate as E
from corvane.streaming import logs as S

START = dt.datetime(2024, 1, 1)


def attempts(spark, n=1500, users=4, seed=1):
    rng = random.Random(seed)
    rows, at = [], 0.0
    for i in range(n):
        at += rng.choice([0.5, 3, 20, 120, 500])
        rows.append((rng.randrange(users), i, START + dt.timedelta(seconds=at), rng.random() < 0.25))
    return rows, spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, ok boolean")


def lockout_loop(rows):
    state, out = {}, {}
    for user, i, ts, ok in rows:
        fails, until = state.get(user, (0, None))
        if until is not None and int((until - ts).total_seconds()) > 0:
            out[i] = "locked"
            continue
        if ok:
            state[user], out[i] = (0, None), "accepted"
        elif fails + 1 >= 5:
            state[user], out[i] = (0, ts + dt.timedelta(seconds=300)), "locking"
        else:
            state[user], out[i] = (fails + 1, None), "failed"
    return out


def test_lockout_equals_the_loop(spark):
    for seed in (1, 2):
        rows, df = attempts(spark, seed=seed)
        want = lockout_loop(rows)
        assert {"locked", "locking", "failed", "accepted"} <= set(want.values())
        assert {r.event_id: r.outcome for r in U.attempt_lockout(df).collect()} == want


def test_segments_split_a_hot_key(spark):
    _, df = attempts(spark, users=1)
    pieces = U.quiet_segments(df, "user_id", "ts", 60)
    assert pieces.select("segment").distinct().count() > 5


def test_lockout_splits_a_busy_key_where_nothing_older_matters(spark):
    rows, df = attempts(spark, users=1)
    pieces = U.lock_segments(df, "user_id", "ts", "ok", "event_id").groupBy("segment").count().collect()
    assert len(pieces) > 20 and sum(r["count"] for r in pieces) == len(rows)


def test_arguments_are_compared_at_every_level(spark):
    texts = ['{"a":{"x":1,"y":[{"p":1,"q":2}]},"b":2}', '{"b":2,"a":{"y":[{"q":2,"p":1}],"x":1}}', "{broken", "broken}", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(U.canonical_args(F.col("t"))).collect()]
    assert got[0] == got[1] and got[2:] == texts[2:]


def test_ttl_equals_the_loop(spark):
    rows, df = attempts(spark)
    fetched, want = {}, {}
    for key, i, ts, _ in rows:
        fresh = key in fetched and (ts - fetched[key]).total_seconds() < 600
        want[i] = "cached" if fresh else "live"
        fetched[key] = fetched[key] if fresh else ts
    got = U.ttl_fetches(df.withColumn("key", F.col("user_id").cast("string")), ttl=600)
    assert {r.event_id: r.state for r in got.collect()} == want


def test_a_key_that_never_pauses_is_one_chain(spark):
    """Thousands of fetches in a row, a null key, and reads at the same time."""
    rows = [("busy", i, START + dt.timedelta(seconds=7 * i + i % 3)) for i in range(6000)]
    rows += [(None, 10_000 + i, START + dt.timedelta(seconds=13 * (i // 2))) for i in range(50)]
    fetched, want = {}, {}
    for key, i, ts in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        fresh = key in fetched and (ts - fetched[key]).total_seconds() < 20
        want[i] = "cached" if fresh else "live"
        fetched[key] = fetched[key] if fresh else ts
    got = U.ttl_fetches(spark.createDataFrame(rows, "key string, event_id long, ts timestamp_ntz"), ttl=20)
    assert {r.event_id: r.state for r in got.collect()} == want and sum(v == "live" for v in want.values()) > 1500


def test_reached_follows_jumps_of_every_length(spark):
    rng = random.Random(6)
    rows, want = [], set()
    for k in range(6):
        n = rng.choice([1, 2, 5, 40, 300])
        to = {i: i + rng.randrange(1, 4) for i in range(n)}
        rows += [(k, i, t if t < n else None, i == 0) for i, t in to.items()]
        at = 0
        while at is not None and at < n:
            want.add((k, at))
            at = to[at]
    nodes = spark.createDataFrame(rows, "k int, at int, to int, first boolean")
    assert {(r.k, r.at) for r in J.reached(nodes, ["k"], "at", "to", "first").collect()} == want
    assert J.reached(nodes.limit(0), ["k"], "at", "to", "first").collect() == []


def budget_loop(rows, budget):
    used, out = {}, {}
    for day, i, units in rows:
        ok = used.get(day, 0) + units <= budget
        used[day] = used.get(day, 0) + (units if ok else 0)
        out[i] = ok
    return out


def test_budget_with_costs_equals_the_loop(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "b"]), i, rng.choice([1, 2, 5, 40, 300, 2000])) for i in range(3000)]
    df = spark.createDataFrame(rows, "d string, event_id long, units int")
    got = U.daily_budget(df, F.col("d"), order=["event_id"], units="units", budget=1000)
    want = budget_loop(rows, 1000)
    assert {r.event_id: r.accepted for r in got.collect()} == want and 0 < sum(want.values()) < 3000


def log_dir(df, path, parts=4):
    """The rows in time order, one file per trigger."""
    rows = df.orderBy("event_id").collect()
    step = -(-len(rows) // parts)
    for p in range(parts):
        df.sparkSession.createDataFrame(rows[p * step : (p + 1) * step], df.schema).coalesce(1).write.parquet(f"{path}/{p}")
    return df.schema


def run(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return stream.sparkSession.table(name)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "in")


def test_lockout_stream_equals_batch(spark, folder):
    _, df = attempts(spark, 400)
    schema = log_dir(df, folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    got = run(S.lockout_stream(stream.withColumn("ts", F.col("ts").cast("timestamp"))), "lockouts", "append")
    want = {r.event_id: r.outcome for r in U.attempt_lockout(df).collect()}
    assert {r.event_id: r.outcome for r in got.collect()} == want


def test_ttl_stream_equals_batch(spark, folder):
    _, df = attempts(spark, 400)
    keyed = df.select(F.col("user_id").cast("string").alias("key"), "event_id", "ts")
    schema = log_dir(keyed, folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    got = run(S.ttl_cache_stream(stream.withColumn("ts", F.col("ts").cast("timestamp")), 600), "ttls", "append")
    assert {r.event_id: r.state for r in got.collect()} == {r.event_id: r.state for r in U.ttl_fetches(keyed, ttl=600).collect()}


def test_session_memory_stream(spark, folder):
    rows = [(c, t, "reset" if (c, t) == (1, 9) else "user", f"m{t}", t * 10 + c) for t in range(15) for c in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, event_id long")
    schema = log_dir(df, folder, 3)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    got = run(S.session_memory_stream(stream), "memories", "update")
    last = {}
    for r in got.collect():
        last.setdefault(r.conv_id, []).append(r.turn)
    assert last[0][-8:] == list(range(7, 15)) and last[1][-5:] == list(range(10, 15)) and 9 not in last[1][-5:]
    tail = U.session_tail(df.where("conv_id = 0")).collect()
    assert sorted(r.turn for r in tail) == list(range(7, 15))


def test_budget_stream_equals_batch(spark, folder, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b"]), rng.choice([1, 3, 50])) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, d string, units int")
    schema = log_dir(df, folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    out = str(tmp_path / "out")
    S.daily_budget_stream(stream, F.col("d"), out, str(tmp_path / "cp"), order=["event_id"], units="units", budget=600).awaitTermination(240)
    got = {r.event_id: r.accepted for r in spark.read.option("basePath", out).parquet(out).collect()}
    assert got == budget_loop([(d, i, u) for i, d, u in rows], 600)


def test_read_log_has_a_watermark(spark, tmp_path):
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    stream = S.read_log(spark, str(tmp_path), schema)
    assert stream.isStreaming and stream.schema["ts"].dataType.simpleString() == "timestamp"


def test_turn_cost_sums_rounds_and_falls_back(spark):
    rows = [(1, "gpt-4o-mini", 1_000_000, 0, 400_000), (1, "gpt-4o-mini", 0, 1_000_000, 0), (2, "other", 10, 0, 30), (3, "gpt-5.6-luna", 1_000_000, 0, 0)]
    df = spark.createDataFrame(rows, "turn int, model string, input_tokens long, output_tokens long, cache_read long")
    got = {r.turn: r.cost_usd for r in U.turn_cost(df, ["turn"]).collect()}
    assert got == {1: round(0.6 * 0.15 + 0.4 * 0.075 + 0.6, 6), 2: round(30 / 1e6 * 0.075, 6), 3: 0.2}


def test_repeats_ignore_key_order(spark):
    rows = [(1, 0, "s", '{"a": 1, "b": 2}'), (1, 1, "s", '{"b": 2, "a": 1}'), (1, 2, "s", '{"a": 2}'), (2, 3, "s", '{"a": 1, "b": 2}'), (1, 4, "t", None), (1, 5, "t", None)]
    df = spark.createDataFrame(rows, "turn int, pos int, name string, args string")
    got = U.repeat_calls(df, ["turn"], name="name", args=U.canonical_args(F.col("args")), order=["pos"])
    assert {r.pos for r in got.where("repeated").collect()} == {1, 5} and got.count() == 6


def test_upkeep(spark):
    docs = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "id string, active boolean")
    active = M.activate(docs, "b")
    assert [r.id for r in M.active_documents(active).collect()] == ["b"] and M.one_active(active).first().ok
    chunks = spark.createDataFrame([("b", 1), ("c", 2)], "document_id string, n int")
    kept, rows = M.prune_inactive(active, chunks)
    assert kept.count() == 1 and [r.n for r in rows.collect()] == [1]
    old = spark.createDataFrame([(1, "x", 0), (2, "y", 0)], "id int, v string, ver int")
    new = spark.createDataFrame([(2, "n", 1), (2, "m", 2), (3, "z", 1)], "id int, v string, ver int")
    assert sorted((r.id, r.v) for r in M.upsert(old, new, ["id"], version=F.col("ver")).collect()) == [(1, "x"), (2, "m"), (3, "z")]


def test_cache_age_is_strict(spark):
    now = F.lit("2024-01-01 00:10:00").cast("timestamp_ntz")
    cache = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 600, "[]"), ("b", dt.datetime(2024, 1, 1), 599, "x")], "key string, fetched_at timestamp_ntz, ttl_seconds int, payload string")
    asks = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert {r.key: r.freshness for r in M.cache_freshness(asks, cache, now).collect()} == {"a": "cached", "b": "stale", "c": "unavailable"}


def summary(spark, **change):
    row = {
        "cases": 19, "route_match": 19, "recall_at_6": 0.9, "top1_ok": True, "status_match": 17, "status_total": 19, "must_contain_match": 5, "must_contain_total": 5, "refusal_exact": 2,
        "refusal_exact_total": 2, "sources_nonempty_ratio": 1.0, "answer_kind_match": 18, "answer_kind_total": 19, "schema_fallback": 0, "blocking_lint": 0,
        "judge_grounded_avg": 4.2, "judge_schema_format_avg": 4.0, "judge_grounded_min": 3,
    }
    return E.check_gates(spark.createDataFrame([{**row, **change}])).first()


def test_gates(spark):
    assert summary(spark).passed
    for change, name in (
        ({"recall_at_6": 0.79}, "recall_at_6"), ({"route_match": 18}, "route"), ({"top1_ok": False}, "top1"), ({"status_match": 16}, "status"), ({"refusal_exact": 1}, "refusal_exact"),
        ({"sources_nonempty_ratio": 0.99}, "sources_nonempty"), ({"must_contain_match": 4}, "must_contain"), ({"schema_fallback": 1}, "schema_fallback"), ({"blocking_lint": 1}, "lint_blocking"),
        ({"answer_kind_match": 17}, "answer_kind"), ({"judge_grounded_avg": 3.9}, "judge_grounded_avg"), ({"judge_grounded_min": 2}, "judge_grounded_min"),
    ):
        assert summary(spark, **change).failures == [name]


def test_recall_counts_prefixes_and_skips_empty(spark):
    cases = spark.createDataFrame([(1, ["5.09", "6.01"]), (2, []), (3, ["DEF-3"])], "qid int, expected array<string>")
    got = spark.createDataFrame([(1, ["5.09(a)(5)", "7.01"])], "qid int, retrieved array<string>")
    assert {r.qid: (r.scored, r.recall) for r in E.recall_at_k(cases, got).collect()} == {1: (True, 0.5), 2: (False, 1.0), 3: (True, 0.0)}
