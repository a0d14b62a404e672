"""Importance resampling of documents towards a target collection, drawn by a distributed quickselect.

Features are hashed into buckets. A bucket's gain is the log ratio of its smoothed shares in the target and in the
documents; all gains are one array, and a document's weight is the mean of the entries at its features. A Gumbel term
that depends on the document's id alone is added, so the highest scores are a draw without replacement.

The draw never sorts the table. The k-th of the composite keys is narrowed down by rounds: random keys still in
question are pivots, all keys are counted exactly as below, at or above each pivot, and the stretch that holds the
k-th one goes on. Keys are unique, as a stored row number ends them. Only the winners are sorted and ranked.

A null text has no words; a null id counts as an empty one in the hash and comes last among ties. Repeated rows are
rows of their own and may all be drawn; it does not matter which of several equal rows is. No documents give no rows,
an empty target gives gains all the same (all target counts are zero). Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import numbered, stored

#: Words are runs of digits, a-z (after lower-casing) and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Pivots of a round; what the driver sees of a round are so many keys and twice as many counts.
PIVOTS = 32


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def features(found: Column, longest: int) -> Column:
    """All runs of 1 to `longest` words of an array, joined by one space."""
    if longest == 1:
        return found

    def runs(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(found) - (n - 1)), lambda i: F.array_join(F.slice(found, i, F.lit(n)), " "))
        return F.when(F.size(found) >= n, made).otherwise(F.array().cast("array<string>"))

    return F.concat(*[runs(n) for n in range(1, longest + 1)])


def bucketed(rows: DataFrame, buckets: int, longest: int) -> DataFrame:
    """`rows` with `n_words` and `at`, the bucket of each feature; `text` is gone."""
    found = rows.withColumn("_words", words(F.col("text"))).drop("text")
    return found.select(
        *[c for c in found.columns if c != "_words"], F.size("_words").cast("long").alias("n_words"),
        F.transform(features(F.col("_words"), longest), lambda f: F.pmod(F.crc32(f), F.lit(buckets)).cast("int")).alias("at"),
    )


def _counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("at").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of every bucket, from the buckets of all features of both; the driver gets `buckets` numbers."""
    spark = source.sparkSession
    s, t = _counts(source).withColumnRenamed("n", "s"), _counts(target).withColumnRenamed("n", "t")
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left")
    counts = [(r.bucket, r.s, r.t) for r in both.fillna(0).collect()]
    all_s, all_t = sum(c[1] for c in counts), sum(c[2] for c in counts)
    share = ((F.col("t") + 1).cast("double") * float(all_s + buckets)) / ((F.col("s") + 1).cast("double") * float(all_t + buckets))
    small = spark.createDataFrame(counts, "bucket int, s long, t long")
    rated = small.select("bucket", F.floor(F.lit(1000.0) * F.log(share)).alias("gain")).collect()
    return [g for _, g in sorted((r.bucket, r.gain) for r in rated)]


def weight(at: Column, table: list[int]) -> Column:
    """The mean gain of the buckets `at`, rounded down; 0 without any."""
    # One literal array: the string is split when the plan is made, not for each row.
    array = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    total = F.aggregate(at, F.lit(0).cast("long"), lambda acc, b: acc + F.get(array, b))
    n = F.size(at).cast("long")
    # What is divided is a multiple of n below 2**53, so the quotient is exact.
    return F.when(n > 0, ((total - F.pmod(total, n)) / n).cast("long")).otherwise(F.lit(0).cast("long"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) of an id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def kth_key(keys: DataFrame, columns: list[str], k: int) -> tuple:
    """The k-th smallest (from 1) of the keys made of `columns`, which hold no nulls and are unique together.

    Each round reads the table twice: for the pivots, and for the counts between them. A round leaves about one
    PIVOTS-th of the keys in question, whatever their distribution, as the pivots are drawn from the keys.
    """
    key = F.struct(*columns)
    types = {c: keys.schema[c].dataType for c in columns}

    def constant(row: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(columns, row)])

    low = high = None
    for turn in range(10_000):
        active = keys
        if low is not None:
            active = active.filter(key > constant(low))
        if high is not None:
            active = active.filter(key < constant(high))
        drawn = active.select(*columns).orderBy(F.xxhash64(*columns, F.lit(turn))).limit(PIVOTS).collect()
        pivots = sorted(tuple(r) for r in drawn)
        if not pivots:
            break
        # Twice the number of pivots below a key, and one more at a pivot.
        place = sum(((key > constant(p)).cast("int") + (key >= constant(p)).cast("int") for p in pivots), F.lit(0))
        counted = {r.place: r.n for r in active.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for at in range(2 * len(pivots) + 1):
            if k <= counted.get(at, 0):
                break
            k -= counted.get(at, 0)
        else:
            break
        if at % 2:
            return pivots[at // 2]
        low = pivots[at // 2 - 1] if at else low
        high = pivots[at // 2] if at // 2 < len(pivots) else high
    raise ValueError("there are fewer keys than k")


def resample(
    docs: DataFrame, target: DataFrame, *, buckets: int = 10_000, longest: int = 1, seed: int = 2024, least_words: int = 20,
    percent: int = 10,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document: the `percent` of those with `least_words` words
    that score highest are drawn and ranked from 1, ties by the smaller id; the others' rank is null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = stored(bucketed(rows, buckets, longest), "buckets")
    table = gains(source, bucketed(target.select(F.col("text").cast("string").alias("text")), buckets, longest), buckets)
    w = weight(F.col("at"), table)
    scored = source.select("doc_id", "n_words", F.size("at").cast("long").alias("n_features"), w.alias("weight"))
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    key = {
        "_down": -F.col("score"), "_last": F.col("doc_id").isNull().cast("int"), "_id": F.coalesce("doc_id", F.lit(0)),
        "_n": F.col("n_features"), "_row": F.monotonically_increasing_id(),
    }
    scored = stored(scored.withColumns(key), "scored")
    out = ["doc_id", "n_features", "weight", "score"]
    eligible = scored.filter(F.col("n_words") >= least_words)
    k = eligible.count() * percent // 100
    nobody = F.lit(None).cast("long").alias("rank")
    if k == 0:
        return scored.select(*out, nobody)
    last = kth_key(eligible.select(*key), list(key), k)
    wins = F.struct(*key) <= F.struct(*[F.lit(v).cast(scored.schema[c].dataType).alias(c) for c, v in zip(key, last)])
    wins = wins & (F.col("n_words") >= least_words)
    ranked = numbered(scored.filter(wins).select(*out, *key), [F.col(c) for c in key], "rank")
    return ranked.select(*out, (F.col("rank") + 1).alias("rank")).unionByName(scored.filter(~wins).select(*out, nobody))
