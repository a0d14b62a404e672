"""Log streams: daily budget, lockout, expiring cache and session memory.

Each has a batch twin in `corvane.operators.usage` that gives the same rows for a finished log.
Keyed state is folded one key at a time, so a trigger should be limited (maxFilesPerTrigger or
maxOffsetsPerTrigger): that bounds what one key can bring at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corvane.operators.usage import DAILY_BUDGET, SESSION_MESSAGES, daily_budget, lock_step

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


def read_log(spark: SparkSession, path: str, schema: T.StructType, *, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A folder of parquet files as a stream; wall-clock times become instants, as watermarks need."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def _sorted(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(order, kind="stable")


class Lockout(StatefulProcessor):
    """(fails, locked until) per user."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lock", "fails int, until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fails, until = self.state.get() if self.state.exists() else (0, 0)
        batch = _sorted(rows, ["at", "event_id"])
        outcomes = []
        for at, ok in zip(batch["at"], batch["ok"]):
            outcome, fails, until = lock_step(fails, until, int(at), bool(ok))
            outcomes.append(outcome)
        self.state.update((fails, until))
        yield pd.DataFrame({"user_id": key[0], "event_id": batch["event_id"], "outcome": outcomes})

    def close(self) -> None:
        pass


def lockout_stream(attempts: DataFrame) -> DataFrame:
    """attempts: user_id, event_id, ts, ok → user_id, event_id, outcome."""
    rows = attempts.select("user_id", "event_id", F.unix_micros("ts").alias("at"), "ok")
    return rows.groupBy("user_id").transformWithStateInPandas(
        Lockout(), "user_id bigint, event_id bigint, outcome string", "Append", "None"
    )


class ExpiringCache(StatefulProcessor):
    """Time of the last fetch per key."""

    def __init__(self, ttl: int) -> None:
        self.span = ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fetched", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fetched = self.state.get()[0] if self.state.exists() else None
        batch = _sorted(rows, ["at", "event_id"])
        states = []
        for at in batch["at"]:
            fresh = fetched is not None and int(at) - fetched < self.span
            states.append("cached" if fresh else "live")
            fetched = fetched if fresh else int(at)
        self.state.update((fetched,))
        yield pd.DataFrame({"key": key[0], "event_id": batch["event_id"], "state": states})

    def close(self) -> None:
        pass


def ttl_cache_stream(reads: DataFrame, ttl: int) -> DataFrame:
    """reads: key, event_id, ts → key, event_id, state (`live` for a fetch, `cached` otherwise)."""
    rows = reads.select("key", "event_id", F.unix_micros("ts").alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(
        ExpiringCache(ttl), "key string, event_id bigint, state string", "Append", "None"
    )


class SessionMemory(StatefulProcessor):
    """The newest messages per session; a reset empties it."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("messages", "turn bigint, role string, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.state.get()) if self.state.exists() else []
        for row in _sorted(rows, ["turn"]).itertuples():
            held = [] if row.role == "reset" else [*held, (int(row.turn), row.role, row.text)][-self.keep :]
        if held:
            self.state.put(held)
        else:
            self.state.clear()
        if not held:
            return
        yield pd.DataFrame(
            {"conv_id": key[0], "turn": [h[0] for h in held], "role": [h[1] for h in held], "text": [h[2] for h in held]}
        )

    def close(self) -> None:
        pass


def session_memory_stream(messages: DataFrame, keep: int = SESSION_MESSAGES) -> DataFrame:
    """messages: conv_id, turn, role, text → the memory of every session touched by the trigger."""
    rows = messages.select("conv_id", "turn", "role", "text")
    return rows.groupBy("conv_id").transformWithStateInPandas(
        SessionMemory(keep), "conv_id bigint, turn bigint, role string, text string", "Update", "None"
    )


def daily_budget_stream(
    calls: DataFrame, day: Column, path: str, checkpoint: str, *, order: list[str], units: str | None = None,
    budget: int = DAILY_BUDGET,
) -> StreamingQuery:
    """Writes every call with its decision under `path`, one folder per trigger.

    Beside it, `path`_totals holds what every day has spent up to each trigger, one row per day; a trigger reads
    only the totals of the one before, never the calls. A replayed trigger overwrites its folders, so a failed one
    neither loses nor doubles units. A day holding most calls is cut like any batch (see `daily_budget`) instead of
    passing through one keyed task.
    """

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        used = spark.read.parquet(f"{path}_totals/trigger={batch_id - 1}") if batch_id else None
        decided = daily_budget(batch, day, order=order, units=units, budget=budget, used=used)
        decided.write.mode("overwrite").parquet(f"{path}/trigger={batch_id}")
        spent = F.lit(1) if units is None else F.col(units)
        own = spark.read.schema(decided.schema).parquet(f"{path}/trigger={batch_id}").where("accepted")
        rows = own.select("day", spent.cast("bigint").alias("used"))
        totals = (rows if used is None else rows.unionByName(used)).groupBy("day").agg(F.sum("used").alias("used"))
        totals.write.mode("overwrite").parquet(f"{path}_totals/trigger={batch_id}")

    return calls.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
