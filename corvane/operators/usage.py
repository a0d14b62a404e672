"""Turn logs: token cost, repeated tool calls, session tails, daily budgets and lockouts in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.jumps import reached
from corvane.operators.ranking import first_per_key, top_n_per_group
from corvane.session import stored_table

# Prices per million tokens (input, output, cached), limits and periods.
PRICES = {"gpt-4o-mini": (0.15, 0.60, 0.075), "gpt-5.6-luna": (0.20, 1.20, 0.02)}
FALLBACK_MODEL = "gpt-4o-mini"
SESSION_MESSAGES = 8
DAILY_BUDGET = 8000
MAX_FAILURES = 5
LOCK_SECONDS = 300
# The remaining wait is shown in whole seconds, so less than one second is no lock. Microseconds.
LOCK_GRAIN = 1_000_000


def price_rows(prices: dict[str, tuple[float, float, float]] | None = None) -> Column:
    table = PRICES if prices is None else prices
    return F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(i).alias("p_in"), F.lit(o).alias("p_out"), F.lit(c).alias("p_cached"))
            for m, (i, o, c) in table.items()
        ]
    )


def turn_cost(usage: DataFrame, keys: list[str], *, prices: dict | None = None, fallback: str = FALLBACK_MODEL) -> DataFrame:
    """Cost per turn over all its rounds; an unknown model is charged as the fallback one.

    usage: keys, model, input_tokens, output_tokens, cache_read. Tokens are summed before pricing.
    """
    summed = usage.groupBy(*keys, "model").agg(
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "cache_read")]
    )
    rows = price_rows(prices)
    own = F.filter(rows, lambda r: r["model"] == F.col("model"))
    price = F.coalesce(F.get(own, F.lit(0)), F.get(F.filter(rows, lambda r: r["model"] == fallback), F.lit(0)))
    fresh = F.greatest(F.col("input_tokens") - F.col("cache_read"), F.lit(0))
    cost = (
        fresh / 1e6 * F.col("_p.p_in") + F.col("cache_read") / 1e6 * F.col("_p.p_cached")
        + F.col("output_tokens") / 1e6 * F.col("_p.p_out")
    )
    return summed.withColumn("_p", price).withColumn("cost_usd", F.round(cost, 6)).drop("_p")


def canonical_args(args: Column) -> Column:
    """JSON text with the keys of every level sorted; what is not JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(args)), args)


def repeat_calls(calls: DataFrame, keys: list[str], *, name: str, args: Column, order: list[str]) -> DataFrame:
    """Adds `repeated`: the same call with the same arguments came earlier in the turn.

    The first place per call is cut to one row in every map task; calls then look it up by key, and a call repeated
    very often is split by the skew-join rule instead of being sorted in one task.
    """
    keyed = calls.withColumn("call_args", args)
    group = [*keys, name, "call_args"]
    first = first_per_key(keyed.select(*group, *order), group, F.struct(*order)).select(*group, F.struct(*order).alias("_first"))
    same = [F.col(f"c.{g}").eqNullSafe(F.col(f"f.{g}")) for g in group]
    joined = keyed.alias("c").join(first.alias("f"), same)
    return joined.select("c.*", (F.struct(*[F.col(f"c.{o}") for o in order]) != F.col("f._first")).alias("repeated"))


def session_tail(messages: DataFrame, *, session: str = "conv_id", order: str = "turn", keep: int = SESSION_MESSAGES) -> DataFrame:
    """Last messages per session, `position` counted from the newest."""
    return top_n_per_group(messages, [session], [F.desc(order)], keep, rank="position")


def daily_budget(
    calls: DataFrame,
    day: Column,
    *,
    order: list[str],
    units: str | None = None,
    budget: int = DAILY_BUDGET,
    used: DataFrame | None = None,
) -> DataFrame:
    """Adds day and accepted. A call that would pass the day's budget is rejected and not counted.

    The remaining budget only falls, so within a day the accepted calls of one cost are the first ones
    of that cost, at most budget // cost of them. Only those candidates are walked, and every other
    call is decided by comparing its place with the last accepted one of its cost. `used` (day, used)
    carries what earlier batches spent.
    """
    cost = (F.lit(1) if units is None else F.col(units)).cast("int")
    dated = calls.withColumn("day", day).withColumn("_cost", cost)
    fits = dated.where((F.col("_cost") > 0) & (F.col("_cost") <= budget)).select("day", "_cost", *order)
    first = top_n_per_group(fits, ["day", "_cost"], [F.col(o) for o in order], budget, rank="_rn").where(
        F.col("_rn") * F.col("_cost") <= budget
    )
    spent = F.lit(0)
    if used is not None:
        first = first.join(used.select("day", F.col("used").cast("int").alias("_used")), "day", "left")
        spent = F.coalesce("_used", F.lit(0))
    first = first.withColumn("_spent", spent)
    if units is None:
        taken = first.where(F.col("_rn") <= budget - F.col("_spent")).select("day", "_cost", *order)
    else:
        taken = first.groupBy("day").applyInPandas(_greedy(order, budget), first.select("day", "_cost", *order).schema)
    last = first_per_key(taken, ["day", "_cost"], F.struct(*order), last=True).select("day", "_cost", F.struct(*order).alias("_last"))
    joined = dated.join(last, ["day", "_cost"], "left")
    ok = (F.col("_cost") <= 0) | F.coalesce(F.struct(*order) <= F.col("_last"), F.lit(False))
    return joined.withColumn("accepted", ok).drop("_cost", "_last")


def _greedy(order: list[str], budget: int):
    """Accepted candidates of one day; a day has at most budget * (1 + 1/2 + 1/3 + …) candidates."""

    def take(day: pd.DataFrame) -> pd.DataFrame:
        rows = day.sort_values(order, kind="stable")
        spent, keep = int(rows["_spent"].iloc[0]), []
        for cost in rows["_cost"]:
            fits = spent + cost <= budget
            spent += cost if fits else 0
            keep.append(fits)
        return rows.loc[keep, ["day", "_cost", *order]]

    return take


def quiet_segments(events: DataFrame, key: str, at: str, period: int) -> DataFrame:
    """Adds `segment`: pieces of a key's timeline that a fold over one period can handle on their own.

    Time is cut into buckets of one period. A bucket with nothing in the bucket before it starts a piece: nothing
    older can still matter then. The decision needs only one small row per (key, bucket), not the events.
    """
    bucket = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (period * 1_000_000)).cast("bigint")
    cut = events.withColumn("_bucket", bucket)
    w = Window.partitionBy(key).orderBy("_bucket")
    starts = (F.lag("_bucket").over(w) == F.col("_bucket") - 1).cast("int")
    small = cut.select(key, "_bucket").distinct().withColumn("_s", 1 - F.coalesce(starts, F.lit(0)))
    numbered = small.withColumn("segment", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.join(numbered.select(key, "_bucket", "segment"), [key, "_bucket"]).drop("_bucket")


def lock_segments(attempts: DataFrame, key: str, at: str, ok: str, tie: str) -> DataFrame:
    """Adds `segment`: pieces of a key's timeline that the lockout fold can handle on their own.

    A lock needs five failures in a row, whether evaluated or not, as the last of them is evaluated. So a success
    without such a run ending in the 300 s before it starts anew, whatever came earlier. Runs are counted within
    buckets of 300 s and carried over buckets by one small row each, so that no task sorts a whole key.
    """
    bucket = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (LOCK_SECONDS * 1_000_000)).cast("bigint")
    rows = attempts.withColumn("_b", bucket).withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    inside = Window.partitionBy(key, "_b").orderBy(at, tie)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_pos", F.row_number().over(inside)).withColumn("_last_ok", F.max(F.when(F.col(ok), F.col("_pos"))).over(upto))
    # Failures at the end of each bucket, added up over the buckets since the last success.
    small = placed.groupBy(key, "_b").agg((F.max("_pos") - F.coalesce(F.max("_last_ok"), F.lit(0))).alias("_tail"), F.max("_last_ok").isNotNull().cast("int").alias("_any"))
    by_bucket = Window.partitionBy(key).orderBy("_b")
    small = small.withColumn("_since", F.sum("_any").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)))
    running = F.sum("_tail").over(Window.partitionBy(key, "_since").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    carried = small.withColumn("_run", running).select(key, "_b", F.coalesce(F.lag("_run").over(by_bucket), F.lit(0)).alias("_carry"))
    length = F.when(F.col(ok), 0).when(F.col("_last_ok").isNull(), F.col("_pos") + F.col("_carry")).otherwise(F.col("_pos") - F.col("_last_ok"))
    marked = placed.join(carried, [key, "_b"]).withColumn("_five", F.when(length >= MAX_FAILURES, F.col("_us")))
    ends = marked.groupBy(key, (F.col("_b") + 1).alias("_b")).agg(F.max("_five").alias("_five_before"))
    joined = marked.join(ends, [key, "_b"], "left")
    latest = F.greatest(F.max("_five").over(before), F.col("_five_before"))
    start = F.col(ok) & F.coalesce(F.col("_us") - latest >= LOCK_SECONDS * 1_000_000, F.lit(True))
    cut = joined.withColumn("_starts", F.sum(start.cast("int")).over(upto))
    counts = cut.groupBy(key, "_b").agg(F.max("_starts").alias("_n"))
    earlier = F.sum("_n").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(key, "_b", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    numbered = cut.join(counts, [key, "_b"]).withColumn("segment", F.col("_earlier") + F.col("_starts"))
    return numbered.select(*attempts.columns, "segment")


def lock_step(fails: int, until: int, at: int, ok: bool) -> tuple[str, int, int]:
    """One attempt: its outcome and the state after it. Times are microseconds."""
    if until - at >= LOCK_GRAIN:
        return "locked", fails, until
    if ok:
        return "accepted", 0, 0
    if fails + 1 >= MAX_FAILURES:
        return "locking", 0, at + LOCK_SECONDS * 1_000_000
    return "failed", fails + 1, 0


def attempt_lockout(attempts: DataFrame, *, key: str = "user_id", at: str = "ts", ok: str = "ok", tie: str = "event_id") -> DataFrame:
    """Adds outcome: accepted, failed, locking (the fifth failure in a row) or locked (not evaluated).

    The fold runs over sorted rows of independent timeline pieces, one batch at a time.
    """
    pieces = lock_segments(attempts, key, at, ok, tie)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = pieces.select(F.col(key).alias("_k"), "segment", micros.alias("_at"), F.col(tie).alias("_tie"), F.col(ok).alias("_ok"))
    ordered = rows.repartition("_k", "segment").sortWithinPartitions("_k", "segment", "_at", "_tie")
    schema = T.StructType([ordered.schema["_k"], ordered.schema["_tie"], T.StructField("outcome", T.StringType())])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, fails, until = None, 0, 0
        for batch in batches:
            out = []
            for k, segment, moment, good in zip(batch["_k"], batch["segment"], batch["_at"], batch["_ok"]):
                if (k, segment) != seen:
                    seen, fails, until = (k, segment), 0, 0
                outcome, fails, until = lock_step(fails, until, moment, good)
                out.append(outcome)
            yield batch[["_k", "_tie"]].assign(outcome=out)

    return ordered.mapInPandas(walk, schema).toDF(key, tie, "outcome")


def next_after(times: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """Adds `to`: the first time of the same key that lies `gap` or more after `at`; times(key, at) are all different.

    Time is cut into buckets of one gap, so what a time looks for lies in the next bucket or, if nothing there is late
    enough, is the first time of a later one. A task sorts one bucket; only one small row per bucket is sorted by key.
    """
    spot = lambda c: F.floor(c / gap).cast("bigint")
    own = times.select(key, F.col(at).alias("_t"), spot(F.col(at)).alias("_b"), F.lit(0).alias("_asks"), F.col(at).alias("_own"))
    ask = times.select(key, (F.col(at) + gap).alias("_t"), (spot(F.col(at)) + 1).alias("_b"), F.lit(1).alias("_asks"), F.col(at).alias("_own"))
    # Backwards in time, a question sees the times at or after it; of equal ones the time itself comes first.
    back = Window.partitionBy(key, "_b").orderBy(F.desc("_t"), F.asc("_asks")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.min(F.when(F.col("_asks") == 0, F.col("_own"))).over(back)
    asked = own.unionByName(ask).withColumn("_seen", seen).where(F.col("_asks") == 1)
    firsts = times.groupBy(key, spot(F.col(at)).alias("_b")).agg(F.min(at).alias("_first"))
    # The first time of the next bucket that holds any, for every bucket that is asked.
    every = firsts.unionByName(asked.where(F.col("_seen").isNull()).select(key, "_b", F.lit(None).cast("bigint").alias("_first")).distinct())
    small = every.groupBy(key, "_b").agg(F.min("_first").alias("_first"))
    later = Window.partitionBy(key).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = small.select(key, "_b", F.min("_first").over(later).alias("_later"))
    joined = asked.join(ahead, [key, "_b"], "left")
    return joined.select(key, F.col("_own").alias(at), F.coalesce("_seen", "_later").alias("to"))


def ttl_fetches(reads: DataFrame, *, key: str = "key", at: str = "ts", tie: str = "event_id", ttl: int) -> DataFrame:
    """Adds state: `live` when a read finds nothing fresh and fetches, else `cached`.

    The clock restarts only at a fetch, so fetches are a chain: from one to the first read that lies a ttl or more after
    it. Every read's jump is found at once, timelines are split where a bucket of one ttl is empty (the next read always
    fetches), and the chain is followed by doubling its jumps; a key that never pauses spreads over all tasks.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    # A struct can be joined on also where the key in it is null.
    named = reads.select(F.struct(F.col(key).alias("k")).alias("_k"), micros.alias("_at"), F.col(tie).alias("_tie"))
    times = stored_table(named.select("_k", "_at").distinct(), "times")
    span = ttl * 1_000_000
    # A time with nothing in the ttl before it fetches, whatever came earlier.
    bucket = F.floor(F.col("_at") / span).cast("bigint").alias("_b")
    small = times.groupBy("_k", bucket).agg(F.min("_at").alias("_at"))
    quiet = F.lag("_b").over(Window.partitionBy("_k").orderBy("_b"))
    heads = small.withColumn("_p", quiet).where(F.col("_p").isNull() | (F.col("_p") < F.col("_b") - 1)).select("_k", "_at", F.lit(True).alias("_first"))
    nodes = next_after(times, "_k", "_at", span).join(heads, ["_k", "_at"], "left").withColumn("_first", F.coalesce("_first", F.lit(False)))
    heads_to = heads.select("_k", F.col("_at").alias("to"), F.lit(True).alias("_ends"))
    # A jump to the head of another piece is dropped: the piece walks on its own.
    nodes = nodes.join(heads_to, ["_k", "to"], "left").withColumn("to", F.when(F.col("_ends").isNull(), F.col("to")))
    nodes = stored_table(nodes.select("_k", "_at", "to", "_first"), "nodes")
    fetched = reached(nodes, ["_k"], "_at", "to", "_first")
    first = first_per_key(named, ["_k", "_at"], F.col("_tie")).join(fetched, ["_k", "_at"], "left_semi").withColumn("_live", F.lit(True))
    same = ["_k", "_at", "_tie"]
    state = F.when(F.col("_live"), F.lit("live")).otherwise(F.lit("cached"))
    return named.join(first, same, "left").select("_k.k", "_tie", state.alias("state")).toDF(key, tie, "state")
