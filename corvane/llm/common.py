"""Helpers shared by the operators: stored tables, split ranks, and words of text as NumPy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.session import shared_dir

#: Words are what lies between these: space and the ASCII controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
#: The same words as a pattern for Spark's functions.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one step of a kernel works on; bounds its work arrays, not the texts.
STEP_BYTES = 2 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: it is computed once, and a lost executor
    rereads it. The files stay until the folder's owner clears it, as those of checkpoint() do."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row by its content: rows of one key are the same document, so joins on it never mix two texts."""
    return F.xxhash64(doc_id, text)


def sum_before(df: DataFrame, keys: list[str], order: list[Column], spread: Column, value: Column, name: str) -> DataFrame:
    """Adds `name`, the sum of `value` over the rows of the same `keys` that come before a row.

    No task sorts a whole key: rows of a key are split by `spread`, summed per piece, and only these sums are added
    up in order. Rows go by `spread`, then by `order`.
    """
    split = df.withColumn("_piece", spread).withColumn("_value", value)
    sums = split.groupBy(*keys, "_piece").agg(F.sum("_value").alias("_sum"))
    upto = [Window.unboundedPreceding, -1]
    earlier = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_piece").rowsBetween(*upto))
    starts = sums.select(*keys, "_piece", F.coalesce(earlier, F.lit(0)).alias("_before"))
    own = F.sum("_value").over(Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(*upto))
    left, right = split.withColumn("_own", F.coalesce(own, F.lit(0))).alias("l"), starts.alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "_piece")]
    return (
        left.join(right, on)
        .select(*[F.col(f"l.{c}") for c in df.columns], (F.col("_before") + F.col("_own")).cast("long").alias(name))
    )


def rank_within(df: DataFrame, keys: list[str], order: list[Column], spread: Column, name: str) -> DataFrame:
    """Adds `name`, a gapless number from 0 within `keys`, in the order of sum_before."""
    return sum_before(df, keys, order, spread, F.lit(1).cast("long"), name)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds `name`, the row's place from 0 in a sort of the whole table, without gathering it in one task."""
    ranged = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33).alias("_part")
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    # One row for each partition of the sort.
    earlier = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(earlier, F.lit(0)).alias("_before"))
    at = (F.col("_before") + F.col("_at") - F.shiftleft(F.col("_part"), 33)).alias(name)
    return ranged.select("*", part).join(starts, "_part").select(*df.columns, at)


def pieces_for(rows: int, size: int = 200, most: int = 1 << 16) -> int:
    """How many pieces a hot key is split into, from the number of all rows."""
    return max(1, min(most, rows // size))


# ---- words of Arrow text columns --------------------------------------------------------------------------------


def text_slices(batch: pa.RecordBatch, column: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of whole rows of about `step` text bytes (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        base = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, base + step, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in BLANKS]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each row the index of its first word (one more at the end)."""
    solid = ~_BLANK[raw]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[cuts] = solid[cuts]
    stops[cuts - 1] = solid[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_LOWER = _BYTE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, STEP_BYTES // 2)
        inverse = pow(_ODD, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, p, np.uint64)])) for p in (_ODD, inverse)]
    return _POWERS[0], _POWERS[1]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word; with `lower`, A-Z count as a-z."""
    out = np.empty(len(starts), np.uint64)
    table_ = _LOWER if lower else _BYTE
    at, step = 0, STEP_BYTES // 2
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + step, "right")))
        hi = ends[to - 1]
        power, inverse = _powers(int(hi - lo) + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table_[raw[lo:hi]] * power[: hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows of each row and the index of each row's first; a row of 1 to k-1 words has
    one window, all of its words."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(int(begin[-1]), np.uint64)
    if not len(out):
        return out, begin
    factor = [np.uint64(pow(_ODD, 2 * j + 3, 1 << 64)) for j in range(k)]
    full = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
    for j in range(k):
        full += hashes[j : j + len(full)] * factor[j]
    long = n >= k
    place = np.repeat(first[:-1][long] - begin[:-1][long], count[long]) + _ranges(begin[:-1][long], count[long])
    out[_ranges(begin[:-1][long], count[long])] = mix(full[place])
    for d in np.flatnonzero((n > 0) & (n < k)):
        own = hashes[first[d] : first[d + 1]]
        out[begin[d]] = mix(np.array([sum(int(h) * int(f) for h, f in zip(own, factor)) + len(own) & (1 << 64) - 1], np.uint64))[0]
    return out, begin


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of [start, start + count), range after range."""
    if not len(counts):
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1])) + np.repeat(starts - (ends - counts), counts)
