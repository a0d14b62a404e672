"""Table upkeep as Spark jobs: upserts, activation, pruning, snapshots, caches, content addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.ranking import first_per_key, top_n_per_group

# Key shape, kept snapshots, purge age.
CONTENT_KEY_PREFIX = "rules/"
CONTENT_KEY_SUFFIX = ".pdf"
SNAPSHOT_KEEP = 3
PURGE_PREFIX = "yt:"
PURGE_DAYS = 30


def content_key(content: Column) -> Column:
    return F.concat(F.lit(CONTENT_KEY_PREFIX), F.sha2(content, 256), F.lit(CONTENT_KEY_SUFFIX))


def append_if_unseen(incoming: DataFrame, stored: DataFrame, *, content: str, order: str) -> DataFrame:
    """One row per incoming content with its key and `status`.

    Copies meet after a combinable minimum, so a content copied very often stays one row per task.
    """
    keyed = incoming.groupBy(content_key(F.col(content)).alias("key")).agg(
        F.min(order).alias(order), F.count(F.lit(1)).alias("copies")
    )
    known = stored.select("key", F.lit(True).alias("_known")).distinct()
    status = F.when(F.col("_known"), F.lit("unchanged")).otherwise(F.lit("uploaded"))
    return keyed.join(known, "key", "left").select("key", order, "copies", status.alias("status"))


def orphan_keys(stored: DataFrame, keep: DataFrame) -> DataFrame:
    return stored.join(keep.select("key").distinct(), "key", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *, version: Column | None = None) -> DataFrame:
    """New rows replace old ones with the same key; among new rows the highest version wins."""
    latest = new if version is None else first_per_key(new, list(keys), version, last=True)
    return old.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def activate(documents: DataFrame, document_id: str, *, id: str = "id") -> DataFrame:
    """Exactly the named document becomes active; rows that neither were nor become active stay as they are."""
    named = F.col(id) == F.lit(document_id)
    return documents.withColumn("active", F.when(F.col("active") | named, named).otherwise(F.col("active")))


def active_documents(documents: DataFrame, *, index_version: str | None = None) -> DataFrame:
    out = documents.where("active")
    return out if index_version is None else out.where(F.col("index_version") == index_version)


def one_active(documents: DataFrame) -> DataFrame:
    n = F.count_if("active")
    return documents.agg(n.alias("active"), (n == 1).alias("ok"))


def prune_inactive(documents: DataFrame, chunks: DataFrame, *, id: str = "id", parent: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """Active documents and the chunks that belong to them."""
    kept = documents.where("active")
    return kept, chunks.join(kept.select(F.col(id).alias(parent)), parent, "left_semi")


def stale_rows(stored: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(current.select(*keys).distinct(), keys, "left_anti")


def delete_stale(stored: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(current.select(*keys).distinct(), keys, "left_semi")


def orphan_rows(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, active: Column) -> DataFrame:
    """Children whose parent is missing or inactive."""
    alive = parents.where(active).select(F.col(parent_key).alias(child_key))
    return children.join(alive, child_key, "left_anti")


def registry_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, side): `missing` from the actual table or `unknown` to the expected one."""
    want, have = expected.select(key).distinct(), actual.select(key).distinct()
    missing = want.join(have, key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(have.join(want, key, "left_anti").withColumn("side", F.lit("unknown")))


def latest_snapshot(snapshots: DataFrame, *, kind: str = "kind", at: str = "fetched_at", tie: str = "id") -> DataFrame:
    return first_per_key(snapshots, [kind], F.struct(at, tie), last=True)


def retain_latest(snapshots: DataFrame, *, kind: str = "kind", at: str = "fetched_at", tie: str = "id", keep: int = SNAPSHOT_KEEP) -> DataFrame:
    return top_n_per_group(snapshots, [kind], [F.desc(at), F.desc(tie)], keep)


def cache_freshness(requests: DataFrame, cache: DataFrame, now: Column, *, key: str = "key") -> DataFrame:
    """Adds `freshness` per request: cached, stale, or unavailable when nothing is stored.

    A row is stale only when older than its ttl, and a stored empty list is a hit.
    """
    entries = first_per_key(cache, [key], F.col("fetched_at"), last=True)
    aged = requests.join(entries, key, "left")
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))
    label = (
        F.when(F.col("fetched_at").isNull(), F.lit("unavailable"))
        .when(age > F.col("ttl_seconds").cast("bigint") * 1_000_000, F.lit("stale"))
        .otherwise(F.lit("cached"))
    )
    return aged.withColumn("freshness", label)


def purge(cache: DataFrame, now: Column, *, key: str = "key", at: str = "fetched_at", prefix: str = PURGE_PREFIX, days: int = PURGE_DAYS) -> DataFrame:
    """Rows that stay after removing old rows of one key prefix."""
    old = F.col(key).startswith(prefix) & (F.col(at) < now - F.expr(f"interval {days} days"))
    return cache.where(~F.coalesce(old, F.lit(False)))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def index_report(documents: DataFrame, chunks: DataFrame, teams: DataFrame, channels: DataFrame, league: str) -> DataFrame:
    """One row: active version, its chunks, and how complete the channel registry is."""
    alive = documents.where("active").select(F.col("id").alias("document_id"), "index_version")
    n = chunks.join(alive, "document_id", "left_semi").agg(F.count(F.lit(1)).alias("chunks"))
    docs = documents.agg(
        F.count(F.lit(1)).alias("documents"), F.max(F.when(F.col("active"), F.col("index_version"))).alias("active_version")
    )
    want = teams.select("code").unionByName(teams.sparkSession.createDataFrame([(league,)], "code string"))
    diff = registry_diff(want, channels, "code").agg(
        F.count_if(F.col("side") == "missing").alias("channels_missing"), F.count_if(F.col("side") == "unknown").alias("channels_unknown")
    )
    return docs.select(
        "*", n.scalar().alias("chunks"), *[diff.select(c).scalar().alias(c) for c in ("channels_missing", "channels_unknown")]
    )
