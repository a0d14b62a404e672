"""Top-n, first-choice and ordered picks that survive one key holding much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import stored_table

# Above this n a map task can ship many rows of one hot key, so a salted round comes first.
DIRECT_N = 64
SALTS = 64


def _plain_columns(df: DataFrame) -> list[str]:
    """Columns that hash cheaply; the salt only spreads rows, it never changes the result."""
    kinds = (T.StringType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def top_n_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, *, rank: str | None = "rank", salt: Column | None = None
) -> DataFrame:
    """First n rows per key, ranked from 1.

    `row_number() <= n` lets Spark cut each key to n rows per map task before the shuffle. For a
    large n the cut runs once per (key, salt) and then once per key, so no task sees a whole hot key.
    """
    if n > DIRECT_N:
        spread = [salt] if salt is not None else [F.col(c) for c in _plain_columns(df)]
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n).drop("_rn", "_salt")
        )
    final = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank or "_rn", F.row_number().over(final)).where(F.col(rank or "_rn") <= n)
    return ranked if rank else ranked.drop("_rn")


def first_per_key(df: DataFrame, keys: list[str | Column], order: Column, *, last: bool = False) -> DataFrame:
    """The first (or last) row of each key. Every map task sends one row per key, so a hot key costs no more."""
    by = order.desc_nulls_last() if last else order.asc_nulls_last()
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(by)))
    return ranked.where(F.col("_rn") == 1).drop("_rn")


def first_nonempty(candidates: DataFrame, keys: list[str], priority: str, passing: Column) -> DataFrame:
    """All passing rows of the first priority that has any, per key."""
    passed = candidates.where(passing)
    best = passed.groupBy(*keys).agg(F.min(priority).alias(priority))
    return passed.join(best, [*keys, priority], "left_semi")


def counted_rank(
    df: DataFrame, keys: list[str], value: str, *, count: str = "n"
) -> DataFrame:
    """Rows per value with the number of rows before it, per key.

    Counts are combined per value first, so the running sum walks distinct values, not rows.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum(count).over(before), F.lit(0)))


def index_percentiles(df: DataFrame, keys: list[str], value: str, at: dict[str, Column]) -> DataFrame:
    """`sorted(values)[index]` per key for named 0-based index columns over `total`; no interpolation."""
    ranked = counted_rank(df, keys, value)
    totals = ranked.groupBy(*keys).agg(F.sum("n").alias("total"))
    placed = ranked.join(totals, keys) if keys else ranked.withColumn("total", totals.scalar())
    picks = [
        F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col(value))).alias(name)
        for name, i in at.items()
    ]
    return placed.groupBy(*keys).agg(F.max("total").alias("total"), *picks)


def best_k(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits (qid, id, score) of each query, `rank` 0-based."""
    ranked = top_n_per_group(hits, ["qid"], [F.desc("score"), F.asc("id")], k)
    return ranked.withColumn("rank", F.col("rank") - 1)


def in_order(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds each row's 0-based place in a sort of the whole table.

    The sort is by ranges and stays distributed; only one count per range is summed in one task.
    """
    at = stored_table(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33).alias("_part")
    counts = at.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return at.select("*", part).join(starts, "_part").select(*df.columns, place.alias(name))
