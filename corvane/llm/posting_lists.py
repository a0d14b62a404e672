"""Approximate nearest neighbours over balanced posting lists.

The index is fitted on a bounded sample of vectors: balanced k-means gives the lists' centroids, and the centroids
are linked into a graph that is small enough for every task. All vectors are indexed: each goes to its nearest
centroid and, near a boundary, to others that are hardly farther. A query walks the graph to the centroids near it
and reads the lists whose distance is within a ratio of the nearest one's; the ratio is fitted for a wanted recall on
queries of the table, whose true neighbours among all vectors are found by comparing. If these lists may hold too few candidates, the ratio counts from the list that makes them
enough. How many centroids a walk opens at least is fitted in the same way. Lists are cut into parts of bounded size, and queries go to all parts of a list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import stored

#: Vectors that the centroids and the ratio are fitted on, at most.
SAMPLE = 20_000
#: Vectors of a list aimed at, and lists at most (the centroids are sent to every task).
LIST_SIZE, MOST_LISTS = 256, 2048
#: Lists one vector may go to, and how much farther than the nearest centroid they may be (in squared distance).
COPIES, CLOSURE = 4, 1.15
#: Neighbours of a centroid in the graph.
DEGREE = 24
#: Vectors compared with all centroids at a time.
STEP = 2048
#: Vectors of a list that one task holds.
PART = 4096
#: Queries compared with all vectors to fit the ratio and the walk, at most, the recall that the lists within the ratio
#: must reach, and how much of it the walk may lose.
TRIALS, RECALL, LOST = 400, 0.97, 0.01
#: Centroids a walk starts from, and opens at least, before it is fitted.
ENTRIES, WIDTH = 64, 32


@dataclass
class Index:
    """Centroids, the graph between them and the fitted pruning ratio; the ids in each list, and how many ids the lists
    read must have in sum; how many centroids a walk opens at least, the least distance that the ratio is taken of, and
    where walks start."""

    centroids: np.ndarray
    graph: np.ndarray
    ratio: float
    sizes: np.ndarray | None = None
    least: int = 0
    width: int = WIDTH
    floor: float = 0.0
    entries: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.entries is None:
            self.entries = _apart(self.centroids, ENTRIES)

    def near(self, query: np.ndarray) -> np.ndarray:
        """Lists within the ratio of the nearest centroid, or of the one with which the least of ids is reached (all
        lists if it never is), by a walk over the graph.

        The walk starts from centroids that lie apart, opens the nearest centroids not yet opened and ends when those
        are beyond the ratio and `width` nearer ones were opened, so every list reached over these is found.
        """
        seen = np.zeros(len(self.centroids), bool)
        opened = seen.copy()
        dist = np.full(len(self.centroids), np.inf)
        front = self.entries
        while True:
            front = front[~seen[front]]
            seen[front] = True
            dist[front] = np.sqrt(((self.centroids[front] - query) ** 2).sum(axis=1))
            limit = self.ratio * max(dist.min(), self.floor)
            if self.sizes is not None and self.sizes[dist <= limit].sum() < self.least:
                order = np.argsort(dist, kind="stable")[: int(seen.sum())]
                enough = np.flatnonzero(np.cumsum(self.sizes[order]) >= self.least)
                # Beyond all seen so far: the walk opens whatever it has reached.
                limit = self.ratio * dist[order[enough[0]]] if len(enough) else np.finfo(float).max
            # Lists lie in clusters: beyond the ratio, too, the nearest seen lead on to nearer ones.
            reach = limit if len(dist) <= self.width else max(limit, np.partition(dist, self.width - 1)[self.width - 1])
            ready = np.flatnonzero(~opened & (dist <= reach) & seen)
            if not len(ready):
                return np.flatnonzero(dist <= limit)
            opened[ready] = True
            front = np.unique(self.graph[ready])


def _apart(c: np.ndarray, n: int) -> np.ndarray:
    """n rows, each the one farthest from those before it."""
    picked, away = [0], np.full(len(c), np.inf)
    while len(picked) < min(n, len(c)):
        away = np.minimum(away, ((c - c[picked[-1]]) ** 2).sum(axis=1))
        picked.append(int(away.argmax()))
    return np.unique(picked)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # Around the mean, so that a common offset takes no digits.
    mean = b.mean(axis=0)
    a, b = a - mean, b - mean
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means whose crowded clusters repel: a cluster's distance grows with the share of vectors it holds."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    c = distinct[np.random.default_rng(11).permutation(len(distinct))[:k]].copy()
    size, scale = np.zeros(k), 0.0
    for _ in range(rounds):
        to, least = np.empty(len(x), np.int64), np.empty(len(x))
        load = scale * np.minimum(size * k / len(x), 4) * 0.1
        for at in range(0, len(x), STEP):
            d = _square(x[at : at + STEP], c)
            to[at : at + STEP], least[at : at + STEP] = (d + load).argmin(axis=1), d.min(axis=1)
        scale = np.median(least)
        size = np.bincount(to, minlength=k).astype(float)
        sums = np.zeros_like(c)
        np.add.at(sums, to, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c


def _closure(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every list each vector goes to."""
    d = _square(x, c)
    n = min(COPIES, len(c))
    near = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
    own = np.take_along_axis(d, near, 1)
    return (pair := np.nonzero(own <= CLOSURE * own.min(axis=1, keepdims=True)))[0], near[pair]


def _truth(vectors: DataFrame, asked: np.ndarray, keys: np.ndarray, k: int) -> list:
    """(trial, v) for the k vectors nearest to each of the asked ones, but the one with its own key, of all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, own = np.full((len(asked), k), np.inf), np.zeros((len(asked), k, asked.shape[1]))
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                x = _matrix(part.column("v"))
                d = _square(asked, x)
                d[part.column("vkey").to_numpy()[None, :] == keys[:, None]] = np.inf
                # Few rows change once k near ones are known.
                for t in np.flatnonzero(d.min(axis=1) < best[:, -1]):
                    some = np.argsort(d[t], kind="stable")[:k]
                    both = np.concatenate([best[t], d[t, some]])
                    keep = np.argsort(both, kind="stable")[:k]
                    own[t], best[t] = np.concatenate([own[t], x[some]])[keep], both[keep]
        t, place = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(best[t, place]), pa.array(list(own[t, place]), pa.list_(pa.float64()))], ["trial", "d", "v"])

    found = vectors.select("vkey", "v").mapInArrow(run, "trial long, d double, v array<double>")
    place = F.row_number().over(Window.partitionBy("trial").orderBy("d"))
    return found.withColumn("place", place).filter(F.col("place") <= k).select("trial", "v").collect()


def fit(vectors: DataFrame, asked: DataFrame, rows: int, k: int) -> Index | None:
    """The index with centroids from at most SAMPLE vectors and a ratio and walk from at most TRIALS queries asked
    (both vkey, v), those of the smallest hash; None without any vector."""
    picked = vectors.orderBy(F.xxhash64("vkey"), "vkey").limit(SAMPLE).select("v").collect()
    if not picked:
        return None
    x = np.array([r["v"] for r in picked], np.float64)
    c = balanced_centroids(x, max(1, min(MOST_LISTS, rows // LIST_SIZE, len(x) // 8)))
    order = np.argsort(_square(c, c), axis=1, kind="stable")
    # Nearest centroids, and a ring, so that the graph hangs together.
    ring = (np.arange(len(c))[:, None] + [1]) % len(c)
    index = Index(c, np.concatenate([order[:, 1 : DEGREE + 1], ring], axis=1), 1.0)
    trials = asked.orderBy(F.xxhash64("vkey"), "vkey").limit(TRIALS).select("vkey", "v").collect()
    if not trials:
        return index
    q = np.array([r["v"] for r in trials], np.float64)
    truth = _truth(vectors, q, np.array([r["vkey"] for r in trials]), k)
    return tuned(index, q, np.array([r["trial"] for r in truth], np.int64), np.array([r["v"] for r in truth]).reshape(-1, q.shape[1]))


def tuned(index: Index, q: np.ndarray, trial: np.ndarray, near: np.ndarray) -> Index:
    """The index with a ratio within which lists hold RECALL of the true neighbours `near` of the queries q[trial], and
    a walk that finds all but LOST of them."""
    if not len(near):
        return index
    to = np.sqrt(_square(q, index.centroids))
    first = to.min(axis=1)
    floor = max(0.1 * float(np.median(first)), 1e-9 * float(to.max()), np.finfo(float).tiny)
    row, own = _closure(near, index.centroids)
    # The ratio at which each true neighbour is reached, through the nearest of its lists.
    need = np.full(len(near), np.inf)
    np.minimum.at(need, row, to[trial[row], own] / np.maximum(first, floor)[trial[row]])
    index = replace(index, ratio=max(1.0, float(np.quantile(need, RECALL))) * (1 + 1e-6), floor=floor)
    while index.width < len(index.centroids):
        seen = np.zeros(to.shape, bool)
        for i, vector in enumerate(q):
            seen[i, index.near(vector)] = True
        reached = np.zeros(len(near), bool)
        np.logical_or.at(reached, row, seen[trial[row], own])
        if reached.mean() >= RECALL - LOST:
            break
        index = replace(index, width=2 * index.width)
    return index


def usable(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): rows with an id whose vector is not null, not zero, all finite, and of the usual length."""
    v = F.col(vector)
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).filter("vec_id is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (usual["n"] if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _in_lists(rows: DataFrame, lists_of, columns: list[str]) -> DataFrame:
    """Each row once for every list it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                row, own = lists_of(_matrix(part.column("v")))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(own.astype(np.int32))], [*columns, "list"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.select(*columns).mapInArrow(run, f"{kinds}, list int")


def _parts(rows: DataFrame, name: str) -> DataFrame:
    """(list, name): into how many parts of at most about PART rows each list goes; at most MOST_LISTS rows."""
    return rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).alias(name))


def nearest(table: DataFrame, queries: DataFrame, *, k: int = 10, index: Index | None = None) -> DataFrame:
    """The k nearest found of each query, by Euclidean distance in double precision.

    table(vec_id, embedding) is searched; queries(vec_id) are ids of its rows, and a query's own id is no candidate.
    Returns query_id, rank from 1, vec_id, score, ties by the smaller vec_id. Equal vectors are searched once and
    stand for their k + 1 smallest ids: no further one can be among k nearest. Defined results: rows without an id,
    and vectors that are null, zero, of an unusual length or not finite, take no part; rows that repeat an id count
    by their nearest vector as candidates and once for each different vector as queries; fewer candidates give fewer
    rows; an empty table gives none; other columns are ignored.
    """
    named = usable(table).withColumn("vkey", F.xxhash64("v"))
    rows = stored(named.dropDuplicates(["vec_id", "vkey"]), "vectors")
    firsts = Window.partitionBy("vkey").orderBy("vec_id")
    unique = stored(rows.withColumn("copy", F.row_number().over(firsts)).filter(F.col("copy") <= k + 1), "unique")
    ones = unique.filter("copy = 1")
    asked = rows.join(queries.select(F.col("vec_id").cast("long")).distinct(), "vec_id", "left_semi").select("vkey", F.col("vec_id").alias("query_id"))
    wanted = ones.join(asked, "vkey", "left_semi")
    index = index or fit(ones, wanted, ones.count(), k)
    if index is None:
        # No row has a usable vector, so there is no query either.
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score"))
    posted = stored(_in_lists(ones, lambda x: _closure(x, index.centroids), ["vkey", "v"]), "lists")
    # Each id counts in the lists of one of its vectors. These are at most COPIES, so lists with COPIES * (k + 1) in sum
    # hold k + 1 different ids.
    homes = unique.groupBy("vec_id").agg(F.min("vkey").alias("vkey")).groupBy("vkey").agg(F.count(F.lit(1)).alias("ids"))
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in posted.select("list", "vkey").join(homes, "vkey").groupBy("list").agg(F.sum("ids").alias("ids")).collect():
        sizes[r["list"]] = r["ids"]
    index = replace(index, sizes=sizes, least=COPIES * (k + 1))

    def near(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [index.near(q) for q in x]
        return np.repeat(np.arange(len(x)), [len(f) for f in found]), np.concatenate(found)

    visits = stored(_in_lists(wanted.select(F.col("vkey").alias("qkey"), "v"), near, ["qkey", "v"]), "visits")
    # One row for each list: the lists are bounded.
    size, load = F.broadcast(_parts(posted, "parts")), F.broadcast(_parts(visits, "loads"))
    left = posted.join(size, "list").join(load, "list").withColumn("part", F.pmod(F.xxhash64("vkey"), "parts"))
    left = left.withColumn("load", F.explode(F.sequence(F.lit(0).cast("long"), F.col("loads") - 1))).select("list", "part", "load", "vkey", "v")
    right = visits.join(size, "list").join(load, "list").withColumn("load", F.pmod(F.xxhash64("qkey"), "loads"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("list", "part", "load", "qkey", "v")

    def compare(vectors: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if vectors.empty or asks.empty:
            return pd.DataFrame({"qkey": [], "vkey": [], "score": []})
        x, keys = np.stack(vectors["v"].to_numpy()), vectors["vkey"].to_numpy()
        out = []
        for key, q in zip(asks["qkey"].to_numpy(), asks["v"]):
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
            # Every class that ties with the last one stays: which ids it has is not known here.
            best = np.flatnonzero(d <= np.partition(d, k)[k]) if len(d) > k + 1 else np.arange(len(d))
            out.append(pd.DataFrame({"qkey": key, "vkey": keys[best], "score": d[best]}))
        return pd.concat(out)

    keys = ["list", "part", "load"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "qkey long, vkey long, score double")
    # A class in several lists has the same score in each.
    pairs = pairs.groupBy("qkey", "vkey").agg(F.min("score").alias("score"))
    best = Window.partitionBy("qkey").orderBy("score")
    pairs = pairs.withColumn("place", F.rank().over(best)).filter(F.col("place") <= k + 1)
    ids = pairs.join(unique.select("vkey", "vec_id"), "vkey").groupBy("qkey", "vec_id").agg(F.min("score").alias("score"))
    first = Window.partitionBy("qkey").orderBy("score", "vec_id")
    ids = ids.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1).withColumnRenamed("qkey", "vkey")
    hits = asked.join(ids, "vkey").filter("vec_id <> query_id")
    last = Window.partitionBy("query_id", "vkey").orderBy("place")
    hits = hits.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    return hits.select("query_id", "rank", "vec_id", "score")
