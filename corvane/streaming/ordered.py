"""Log streams in event time: rows wait for the watermark, are folded in order, and their state is forgotten in time.

Rows that arrive out of order, but not later than the watermark allows, are held per key. A timer at the earliest of
them wakes the key when the watermark has passed it; what is due is then folded by (time, id), so the outcome is that of
the batch twin in `corvane.operators.usage`, whatever the order of arrival. Each key has one timer at a time. When
nothing is held, the timer stands at the moment from which the state cannot matter any more, and then deletes it.

Input columns `ts` must carry a watermark (`read_log`). The state needs the RocksDB store (`logs.STATE_STORE`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvane.operators.usage import SESSION_MESSAGES, lock_step

SECOND = 1_000_000


class InOrder(StatefulProcessor):
    """Holds rows (at, id, ...) until the watermark has passed `at`, in microseconds, and folds them in order.

    Subclasses name the columns besides at and id, and give `open`, `fold` and `forget`.
    """

    columns = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"at bigint, id bigint{self.columns}")
        self.timer = handle.getValueState("timer", "at bigint")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        pass

    def fold(self, key, rows: list[tuple]) -> pd.DataFrame:
        """The output for rows that are due, in order."""
        raise NotImplementedError

    def forget(self, passed: int) -> int | None:
        """When the state can be deleted, in microseconds; deletes it if that is not after `passed`. None: there is
        no state, or it is kept for ever."""
        return None

    def _wake(self, at: int) -> None:
        """Moves the timer to `at` if it stands later or nowhere."""
        moment = -(-at // 1000)
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is None or moment < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(moment)
            self.timer.update((moment,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["at", "id", *[c.split()[0] for c in self.columns.split(",") if c.strip()]]
        fresh = [tuple(r) for batch in rows for r in batch[names].astype(object).itertuples(index=False, name=None)]
        if fresh:
            self.held.appendList([(int(r[0]), int(r[1]), *r[2:]) for r in fresh])
            self._wake(min(int(r[0]) for r in fresh))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        rows = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        due = sorted((r for r in rows if r[0] <= passed), key=lambda r: r[:2])
        later = [r for r in rows if r[0] > passed]
        if due:
            if later:
                self.held.put(later)
            else:
                self.held.clear()
            out = self.fold(key, due)
            if len(out):
                yield out
        ends = [r[0] for r in later]
        end = self.forget(passed)
        if end is not None and end > passed:
            ends.append(end)
        if ends:
            self._wake(min(ends))

    def close(self) -> None:
        pass


class Lockout(InOrder):
    """(fails, locked until) per user. Nothing is kept once no failure counts and no lock holds; failures of a user who
    stays away for `idle` seconds are forgotten, if that is given."""

    columns = ", ok boolean"

    def __init__(self, idle: int | None = None) -> None:
        self.idle = idle

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lock", "fails int, until bigint, last bigint")

    def fold(self, key, rows: list[tuple]) -> pd.DataFrame:
        fails, until, last = self.state.get() if self.state.exists() else (0, 0, None)
        outcomes = []
        for at, _, ok in rows:
            if self.idle is not None and last is not None and at - last >= self.idle * SECOND:
                fails = 0
            outcome, fails, until = lock_step(fails, until, at, bool(ok))
            outcomes.append(outcome)
            last = at
        self.state.update((fails, until, last))
        return pd.DataFrame({"user_id": key[0], "event_id": [r[1] for r in rows], "outcome": outcomes})

    def forget(self, passed: int) -> int | None:
        if not self.state.exists():
            return None
        fails, until, last = self.state.get()
        if fails and self.idle is None:
            return None
        end = max(until, last + self.idle * SECOND if fails else last)
        if end <= passed:
            self.state.clear()
        return end


def lockout_in_order(attempts: DataFrame, idle: int | None = None) -> DataFrame:
    """attempts: user_id, event_id, ts (with a watermark), ok -> user_id, event_id, outcome, as `attempt_lockout`."""
    rows = attempts.select("user_id", F.col("event_id").alias("id"), "ts", F.unix_micros("ts").alias("at"), "ok")
    return rows.groupBy("user_id").transformWithStateInPandas(
        Lockout(idle), "user_id bigint, event_id bigint, outcome string", "Append", "EventTime"
    )


class ExpiringCache(InOrder):
    """Time of the last fetch per key, for as long as it is fresh."""

    def __init__(self, ttl: int) -> None:
        self.span = ttl * SECOND

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fetched", "at bigint")

    def fold(self, key, rows: list[tuple]) -> pd.DataFrame:
        fetched = self.state.get()[0] if self.state.exists() else None
        states = []
        for at, *_ in rows:
            fresh = fetched is not None and at - fetched < self.span
            states.append("cached" if fresh else "live")
            fetched = fetched if fresh else at
        self.state.update((fetched,))
        return pd.DataFrame({"key": key[0], "event_id": [r[1] for r in rows], "state": states})

    def forget(self, passed: int) -> int | None:
        if not self.state.exists():
            return None
        end = self.state.get()[0] + self.span
        if end <= passed:
            self.state.clear()
        return end


def ttl_cache_in_order(reads: DataFrame, ttl: int) -> DataFrame:
    """reads: key, event_id, ts (with a watermark) -> key, event_id, state, as `ttl_fetches`."""
    rows = reads.select("key", F.col("event_id").alias("id"), "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(
        ExpiringCache(ttl), "key string, event_id bigint, state string", "Append", "EventTime"
    )


class SessionMemory(InOrder):
    """The newest messages per session; a reset or `idle` seconds without a message empty it."""

    columns = ", role string, text string"

    def __init__(self, keep: int, idle: int) -> None:
        self.keep, self.idle = keep, idle

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("messages", "at bigint, id bigint, role string, text string")

    def fold(self, key, rows: list[tuple]) -> pd.DataFrame:
        memory = [tuple(r) for r in self.state.get()] if self.state.exists() else []
        out: list[tuple] = []
        for row in rows:
            if memory and row[0] - memory[-1][0] >= self.idle * SECOND:
                memory = []
            memory = [] if row[2] == "reset" else [*memory, row][-self.keep :]
            out.append((row[1], len(memory), memory[0][1] if memory else None))
        if memory:
            self.state.put(memory)
        else:
            self.state.clear()
        return pd.DataFrame({
            "conv_id": key[0], "turn": [o[0] for o in out], "messages": [o[1] for o in out],
            "oldest": pd.array([o[2] for o in out], dtype="Int64"),
        })

    def forget(self, passed: int) -> int | None:
        if not self.state.exists():
            return None
        end = list(self.state.get())[-1][0] + self.idle * SECOND
        if end <= passed:
            self.state.clear()
        return end


def session_memory_in_order(messages: DataFrame, keep: int = SESSION_MESSAGES, idle: int = 86_400) -> DataFrame:
    """messages: conv_id, turn, ts (with a watermark), role, text -> for every message how many the session remembers
    after it, and the turn of the oldest one; turns rise with time."""
    rows = messages.select("conv_id", F.col("turn").alias("id"), "ts", F.unix_micros("ts").alias("at"), "role", "text")
    return rows.groupBy("conv_id").transformWithStateInPandas(
        SessionMemory(keep, idle), "conv_id bigint, turn bigint, messages int, oldest bigint", "Append", "EventTime"
    )


class Release(InOrder):
    """Rows as JSON, handed on once the watermark has passed them."""

    columns = ", payload string"

    def fold(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"payload": [r[2] for r in rows]})


def released(rows: DataFrame, *, time: str = "ts", id: str = "event_id", spread: int = 64) -> DataFrame:
    """The same rows, each in the first trigger whose watermark has passed it: triggers then follow one another in
    event time, as `daily_budget_stream` needs. Rows are dealt to `spread` keys, so no key of theirs is held by one task."""
    out = rows.schema
    keyed = rows.select(
        F.pmod(F.xxhash64(id), F.lit(spread)).alias("piece"), F.col(time), F.unix_micros(time).alias("at"), F.col(id).alias("id"),
        F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}).alias("payload"),
    )
    held = keyed.groupBy("piece").transformWithStateInPandas(Release(), "payload string", "Append", "EventTime")
    read = F.from_json("payload", out, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return held.select(read.alias("row")).select("row.*")
