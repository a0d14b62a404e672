"""Near-duplicate vectors by an exact metric range join.

On unit vectors a cosine of at least c is a distance of at most eps = sqrt(2 - 2c). Vectors go to the cell of their
nearest pivot. Let v lie in the cell of p, u in that of q, and |u - v| <= eps. By the triangle inequality v is no more
than 2 eps farther from q than from p; v is at most eps from the plane halfway between p and q as well, which is the
sharper form of the same bound: v.(p - q) <= eps |p - q|. Only vectors within that bound are copied to the cell of q,
and only from the later cell of two to the earlier one, so each pair meets in exactly one cell. Cells are joined
independently, in tiles of bounded size: a cell of any size is spread over tasks.

The inequality also links without comparing: two vectors of a cell within eps / 2 of its pivot are within eps of each
other. They are its core, so a large tight group that holds a pivot costs no pairs. Equal vectors are one node.

How many pivots there are is chosen on a bounded sample: the number with the least estimated work, pairs and copies
together. Vectors that fill a high-dimensional sphere evenly cannot be parted by any pivot (every vector is near every
boundary); then one cell is left and the join compares all tiles.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of different
length do not link. Every row counts as a vector, also repeated rows and rows of one id; a null id is no component's
smallest (a component of null ids only has a null id, and its rows are not kept). Ties at the threshold count as
links. An empty table gives no rows. Only the id and the vector column are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import stored
from corvane.llm.components import connected

#: Vectors that the pivots and their number are taken from, and components (dimensions times pivots) at most.
SAMPLE, MOST = 4096, 1 << 21
#: Components of a tile; rows that a task compares at once.
TILE, STRIP = 1 << 20, 256
#: Tasks that pairs of tiles are dealt to at most; each takes its pairs one after the other.
MOST_TASKS = 100_000
#: Sending one row costs about as much as comparing so many pairs.
ROW_COST = 2000
#: Within this of the threshold, a cosine is computed anew.
CLOSE = 1e-9


def usable(v: Column) -> Column:
    size = F.aggregate(v, F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x.cast("double"))))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & (size > 0), F.lit(False))


def unit(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length one, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    # Scaled first, so that no square overflows or vanishes.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Pivots:
    """Pivots of one length of vectors."""

    def __init__(self, rows: np.ndarray, eps: float) -> None:
        self.rows, self.eps = rows, eps
        gram = rows @ rows.T
        self.apart = np.sqrt(np.maximum(2 - 2 * gram, 0)) * eps + 1e-9

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cells, whether a row is in the core of its cell, and which earlier cells need a copy of it."""
        near = x @ self.rows.T
        home = near.argmax(axis=1)
        best = near[np.arange(len(x)), home]
        core = np.sqrt(np.maximum(2 - 2 * best, 0)) <= self.eps / 2 - 1e-7
        copies = best[:, None] - near <= self.apart[home]
        copies &= np.arange(len(self.rows)) < home[:, None]
        return home, core, copies


def choose(sample: np.ndarray, total: int, eps: float) -> Pivots:
    """As many of the sample's rows as pivots as make the least work for `total` rows like the rest of them."""
    best, k = (np.inf, Pivots(sample[:1], eps)), 1
    # A pivot is nearer to itself than any other row, so the work is estimated on the rows that are none.
    while k <= min(len(sample) // 2, max(1, MOST // sample.shape[1])):
        pivots, rest = Pivots(sample[:k], eps), sample[k:]
        home, core, copies = pivots.place(rest)
        scale = total / len(rest)
        own, cores = np.bincount(home, minlength=k) * scale, np.bincount(home[core], minlength=k) * scale
        extra = copies.sum(axis=0) * scale
        tile = max(1, TILE // sample.shape[1])
        sent = (own + extra) * np.maximum(1, (own + extra) / tile)
        work = (own**2 - cores**2) / 2 + own * extra + ROW_COST * sent
        cost = work.sum() + total * k
        if cost < best[0]:
            best = cost, pivots
        k *= 2
    return best[1]


def _placing(pivots: dict[int, Pivots]) -> Callable:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == d)
                for at in range(0, len(mine), 2048):
                    rows = mine[at : at + 2048]
                    part = batch.take(pa.array(rows))
                    if d in pivots:
                        home, core, copies = pivots[d].place(unit(part.column("v")))
                        row, cell = np.nonzero(copies)
                    else:
                        home, core = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
                        row = cell = np.empty(0, np.int64)
                    pick = np.concatenate([np.arange(len(rows)), row])
                    kind = np.concatenate([np.where(core, 0, 1), np.full(len(row), 2)])
                    out = part.take(pa.array(pick))
                    yield pa.RecordBatch.from_arrays(
                        [*out.columns, pa.array(np.concatenate([home, cell]).astype(np.int32)), pa.array(kind.astype(np.int32))],
                        [*out.schema.names, "cell", "kind"],
                    )

    return place


def tasks(placed: DataFrame) -> DataFrame:
    """`placed` with `a`, `b` and `side`: each row once for every pair of tiles it is compared in.

    The tiles of a cell are numbered: its core first, then the other vectors at home, then copies. Two tiles of the
    core need no comparing, and two of copies meet in another cell.
    """
    size = F.greatest(F.lit(1), F.floor(F.lit(TILE) / F.col("dims")))
    n = [F.count(F.when(F.col("kind") == k, 1)) for k in range(3)]
    tiles = placed.groupBy("dims", "cell").agg(*[F.ceil(x / F.first(size)).cast("int").alias(f"t{k}") for k, x in enumerate(n)])
    rows = placed.join(tiles, ["dims", "cell"])
    own = F.element_at(F.array("t0", "t1", "t2"), F.col("kind") + 1)
    before = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 1, F.col("t0")).otherwise(F.col("t0") + F.col("t1"))
    rows = rows.withColumn("t", (before + F.pmod(F.xxhash64("node"), own)).cast("int"))
    last, home = F.col("t0") + F.col("t1") + F.col("t2") - 1, F.col("t0") + F.col("t1")
    first = F.greatest("t", "t0")
    none = F.array().cast("array<struct<a:int,b:int,side:int>>")
    as_a = F.when(
        (F.col("t") < home) & (first <= last),
        F.transform(F.sequence(first, last), lambda b: F.struct(F.col("t").alias("a"), b.alias("b"), F.lit(0).alias("side"))),
    ).otherwise(none)
    upto = F.least(F.col("t"), home) - 1
    as_b = F.when(
        (F.col("kind") > 0) & (upto >= 0),
        F.transform(F.sequence(F.lit(0), upto), lambda a: F.struct(a.alias("a"), F.col("t").alias("b"), F.lit(1).alias("side"))),
    ).otherwise(none)
    met = rows.withColumn("_met", F.explode(F.concat(as_a, as_b)))
    return met.select("dims", "cell", "_met.a", "_met.b", "_met.side", "node", "w", "v")


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes 0..n-1 as the links a-b do, at most one for each node."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            some = np.flatnonzero(label != np.arange(n))
            return some, label[some]


def _comparing(least: float) -> Callable:
    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        one = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        order = np.argsort(side, kind="stable")
        table = table.take(pa.array(order))
        node, w = table.column("node").to_numpy(), table.column("w").to_numpy()
        x = unit(table.column("v").combine_chunks())
        cut = int((side == 0).sum())
        left = np.arange(len(x)) if one else np.arange(cut)
        base = 0 if one else cut
        right = x[base:]
        links, a_out, b_out = np.zeros(len(x), np.int64), [], []
        for at in range(0, len(left), STRIP):
            rows = left[at : at + STRIP]
            cosine = x[rows] @ right.T
            r, c = np.nonzero(cosine >= least - CLOSE)
            a, b, value = rows[r], base + c, cosine[r, c]
            if one:
                a, b, value = a[a < b], b[a < b], value[a < b]
            doubt = np.flatnonzero(value < least + CLOSE)
            sure = np.ones(len(a), bool)
            sure[doubt] = np.einsum("ij,ij->i", x[a[doubt]], x[b[doubt]]) >= least
            a, b = a[sure], b[sure]
            if not len(a):
                continue
            np.add.at(links, a, w[b])
            np.add.at(links, b, w[a])
            if len(a) > len(right):
                a, b = _spanning(a, b, len(x))
            a_out.append(a)
            b_out.append(b)
        some = np.flatnonzero(links)
        a, b = (np.concatenate(y) if y else np.empty(0, np.int64) for y in (a_out, b_out))
        return pa.table({
            "node": pa.array(np.concatenate([node[some], node[a]])),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)])),
            "peer": pa.array(np.concatenate([np.full(len(some), -1), node[b]])),
        })

    return compare


def sampled(nodes: DataFrame, total: int, eps: float) -> dict[int, Pivots]:
    """Pivots for each length of vectors that the sample holds; the others have one cell."""
    size = nodes.agg(F.max("dims")).first()[0] or 1
    rows = nodes.orderBy(F.xxhash64("node")).limit(max(1, min(SAMPLE, (MOST * 8) // size))).select("dims", "v").toArrow()
    dims = rows.column("dims").to_numpy()
    out = {}
    for d in np.unique(dims).tolist():
        mine = np.flatnonzero(dims == d)
        out[d] = choose(unit(rows.column("v").take(pa.array(mine)).combine_chunks()), max(1, total * len(mine) // len(dims)), eps)
    return out


def linked(nodes: DataFrame, least: float = 0.9, pivots: dict[int, Pivots] | None = None) -> tuple[DataFrame, DataFrame]:
    """Links between different vectors of stored nodes(node, dims, w, v), which stand for `w` equal ones each:
    (node, links), a share of the linked weight in each row, and (a, b), links that join what all links join."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    if pivots is None:
        pivots = sampled(nodes, nodes.count(), eps)
    kinds = nodes.schema["v"].dataType.simpleString()
    placed = nodes.mapInArrow(_placing(pivots), f"node long, dims int, w long, v {kinds}, cell int, kind int")
    placed = stored(placed, "cells")
    met, pair = tasks(placed), ["dims", "cell", "a", "b"]
    # Few bytes are much work here, so pairs of tiles are dealt by their number, not by their size.
    met = met.repartition(max(1, min(MOST_TASKS, met.select(*pair).distinct().count())), *pair)
    found = met.groupBy(*pair).applyInArrow(_comparing(least), "node long, links long, peer long")
    found = stored(found, "links")
    cores = placed.filter("kind = 0").select("dims", "cell", "node", "w")
    core = cores.groupBy("dims", "cell").agg(F.min("node").alias("peer"), F.sum("w").alias("all"))
    inside = cores.join(core, ["dims", "cell"]).select("node", (F.col("all") - F.col("w")).alias("links"), "peer")
    both = found.unionByName(inside)
    return both.select("node", "links"), both.filter("peer >= 0 and peer <> node").select(F.col("node").alias("a"), F.col("peer").alias("b"))


def near_duplicates(rows: DataFrame, *, least: float = 0.9, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    v = F.col(vector)
    # Two hashes name a vector; equal names are taken for equal vectors.
    named = rows.select(
        F.col(id_column).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dims"), usable(v).alias("ok"),
        F.xxhash64(v).alias("k1"), F.xxhash64(F.reverse(v), F.lit(7)).alias("k2"),
    )
    good = named.filter("ok")
    merged = good.groupBy("k1", "k2").agg(
        F.first("dims").alias("dims"), F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("low"), F.first("v").alias("v")
    )
    nodes = stored(merged.withColumn("node", F.monotonically_increasing_id()), "nodes")
    links, edges = linked(nodes.select("node", "dims", "w", "v"), least)
    n = links.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected(edges).select(F.col("cid").alias("node"), "label")
    known = nodes.select("k1", "k2", "node", "w", "low").join(n, "node", "left").join(labels, "node", "left")
    known = known.withColumn("label", F.coalesce("label", "node"))
    lowest = known.groupBy("label").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "label").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    found = good.select("vec_id", "k1", "k2").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = named.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    all_rows = found.unionByName(alone)
    return all_rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
