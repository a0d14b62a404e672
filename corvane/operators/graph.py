"""Approximate vector search over navigable small-world graphs.

Vectors are dealt to parts of bounded size, and each part gets a graph of its own, stored as a table: one row for each
vector with its neighbours in every layer it lies in. Rows of a part are numbered in a random but fixed order, and
layer l holds the first n / STEP**l of them, so the upper layers are samples whose links are long. A row is linked
with up to m of its nearest rows that are not nearer to one another than to it, and with rows that chose it.

A search starts in the top layer, which is compared whole, and goes down: in every layer the best rows found lead to
their neighbours, and a beam of the best is kept until none of them leads to a better one. All queries of a block walk
together, so a step is a few array operations. Equal vectors are one node of the graph. In each part, a few of the
queries are compared with all its nodes first, and the beam is doubled until the walk finds enough of their neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.dense import DIGITS, TOP_K
from corvane.operators.ranking import best_k

# Links of a row, candidates for them, and rows that a search keeps at least.
LINKS, BUILD_WIDTH, BEAM = 16, 64, 80
#: Queries of a part that the beam is fitted on, at most, and the share of their nearest nodes it has to find.
TRIALS, RECALL = 64, 0.98
#: Rows of a part, and how many times fewer rows the next layer holds.
PART_ROWS, STEP = 16_384, 16
#: Rows compared at once when links are chosen, queries that walk together, beam of the upper layers, rows that lead
#: on in one step.
STRIP, TOGETHER, NARROW, ABREAST = 128, 256, 8, 4


def layer_sizes(n: int) -> list[int]:
    """Rows in each layer, the lowest first; the top one has at most 4 * STEP."""
    sizes = [n]
    while sizes[-1] > 4 * STEP:
        sizes.append(-(-sizes[-1] // STEP))
    return sizes


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _nodes(x: np.ndarray) -> np.ndarray:
    """For each row the first row that holds the same vector."""
    whole = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    _, first, back = np.unique(whole, return_index=True, return_inverse=True)
    return first[back]


def _chosen(x: np.ndarray, rows: np.ndarray, near: np.ndarray, score: np.ndarray, m: int) -> np.ndarray:
    """Which of the candidates `near` (best first, -1 for none) each row links with: those nearer to it than to any
    candidate linked before, then the best of the rest, m in all."""
    own = x[near]
    among = np.einsum("rjd,rid->rji", own, own)
    kept = np.zeros(near.shape, bool)
    for j in range(near.shape[1]):
        blocked = (kept[:, :j] & (among[:, j, :j] >= score[:, j, None])).any(axis=1)
        kept[:, j] = ~blocked & (near[:, j] >= 0) & (kept.sum(axis=1) < m)
    # Places by preference: linked ones first, the rest by their rank.
    order = np.argsort(np.where(near < 0, 3 * near.shape[1], np.where(kept, 0, near.shape[1])) + np.arange(near.shape[1]), axis=1)[:, :m]
    return np.take_along_axis(near, order, axis=1)


def links_of(x: np.ndarray, m: int = LINKS, width: int = BUILD_WIDTH) -> np.ndarray:
    """Neighbours of every row of one layer, -1 where there are fewer than 2 m."""
    n = len(x)
    width = min(width, n - 1)
    if width < 1:
        return np.full((n, 2 * m), -1, np.int32)
    out = np.full((n, m), -1, np.int64)
    best = np.full((n, m), -np.inf)
    for at in range(0, n, STRIP):
        rows = np.arange(at, min(n, at + STRIP))
        score = x[rows] @ x.T
        score[rows - at, rows] = -np.inf
        near = np.argpartition(-score, width - 1, axis=1)[:, :width]
        value = np.take_along_axis(score, near, axis=1)
        order = np.lexsort((near, -value), axis=1)
        near, value = np.take_along_axis(near, order, axis=1), np.take_along_axis(value, order, axis=1)
        picked = _chosen(x, rows, near, value, m)
        out[rows, : picked.shape[1]] = picked
        best[rows, : picked.shape[1]] = np.where(picked >= 0, np.take_along_axis(score, np.maximum(picked, 0), axis=1), -np.inf)
    # Rows that chose a row are linked from it, too, the nearest first, as far as there is room.
    source, place = np.nonzero(out >= 0)
    target, value = out[source, place], best[source, place]
    order = np.lexsort((source, -value, target))
    source, target = source[order], target[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    room = rank < m
    both = np.concatenate([out, np.full((n, m), -1, np.int64)], axis=1)
    both[target[room], m + rank[room]] = source[room]
    # A link that is there both ways is kept once.
    both.sort(axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    return both.astype(np.int32)


def _building(m: int, width: int) -> Callable:
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("id", "ascending")])
        x = _unit(table.column("embedding"))
        node = _nodes(x)
        rows = np.flatnonzero(node == np.arange(len(x)))
        own = x[rows]
        layers = [links_of(own[:size], m, width) for size in layer_sizes(len(rows))]
        links: list[list[list[int]] | None] = [None] * len(x)
        for i, row in enumerate(rows.tolist()):
            links[row] = [layer[i][layer[i] >= 0].tolist() for layer in layers if i < len(layer)]
        number = np.searchsorted(rows, node)
        return pa.table({
            "part": table.column("part"), "node": pa.array(number.astype(np.int32)), "id": table.column("id"),
            "embedding": table.column("embedding"), "links": pa.array(links, pa.list_(pa.list_(pa.int32()))),
        })

    return build


def build_graph(vectors: DataFrame, *, m: int = LINKS, width: int = BUILD_WIDTH, part_rows: int = PART_ROWS) -> DataFrame:
    """vectors(id, embedding) -> (part, node, id, embedding, links); store it to build it once.

    `links` holds a list of neighbours for each layer, null on rows that repeat the vector of another. Rows without a
    vector are left out. A part is built by one task from at most about `part_rows` rows.
    """
    rows = vectors.where(F.col("embedding").isNotNull()).select("id", "embedding", F.xxhash64("id").alias("order"))
    parts = -(-rows.count() // part_rows) or 1
    rows = rows.withColumn("part", F.pmod("order", F.lit(parts)).cast("int"))
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("node", T.IntegerType()), rows.schema["id"], rows.schema["embedding"],
        T.StructField("links", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ])
    return rows.groupBy("part").applyInArrow(_building(m, width), schema)


class Graph:
    """One part's graph in a task."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by([("node", "ascending"), ("id", "ascending")])
        node = table.column("node").to_numpy()
        self.first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.empty(0, np.int64)
        self.upto = np.append(self.first[1:], len(node))
        self.ids = table.column("id").combine_chunks()
        self.x = _unit(table.column("embedding"))[self.first]
        lists = [next(x for x in table.column("links").slice(a, b - a).to_pylist() if x is not None) for a, b in zip(self.first, self.upto)]
        self.layers = []
        for level, size in enumerate(layer_sizes(len(lists))):
            own = [x[level] for x in lists[:size]]
            padded = np.full((size, max(map(len, own), default=0) or 1), -1, np.int32)
            for i, links in enumerate(own):
                padded[i, : len(links)] = links
            self.layers.append(padded)

    def walk(self, asked: np.ndarray, start: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best `width` nodes found for each query in one layer, their scores, and how many were compared."""
        n, every = len(asked), np.arange(len(asked))[:, None]
        links = self.layers[level]
        seen = np.zeros((n, len(links) + 1), bool)
        seen[:, -1] = True
        beam, score, done = np.full((n, width), -1), np.full((n, width), -np.inf), np.ones((n, width), bool)
        compared = np.zeros(n, np.int64)
        fresh = start
        while True:
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            new = ~seen[every, fresh]
            seen[every, fresh] = True
            compared += new.sum(axis=1)
            value = np.where(new, np.einsum("qkd,qd->qk", self.x[fresh], asked), -np.inf)
            beam = np.concatenate([beam, np.where(new, fresh, -1)], axis=1)
            score = np.concatenate([score, value], axis=1)
            done = np.concatenate([done, ~new], axis=1)
            keep = np.argsort(-score, axis=1, kind="stable")[:, :width]
            beam, score, done = (np.take_along_axis(a, keep, axis=1) for a in (beam, score, done))
            lead = np.argsort(np.where(done, np.inf, -score), axis=1, kind="stable")[:, :ABREAST]
            open_ = ~np.take_along_axis(done, lead, axis=1)
            if not open_.any():
                return beam, score, compared
            np.put_along_axis(done, lead, True, axis=1)
            picked = np.where(open_, np.take_along_axis(beam, lead, axis=1), -1)
            fresh = np.where(picked[:, :, None] >= 0, links[picked], -1).reshape(n, -1).astype(np.int64)

    def search(self, asked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        top = len(self.layers) - 1
        start = np.broadcast_to(np.arange(len(self.layers[top])), (len(asked), len(self.layers[top]))).copy()
        total = np.zeros(len(asked), np.int64)
        for level in range(top, -1, -1):
            beam, score, compared = self.walk(asked, start, level, width if level == 0 else NARROW)
            total += compared
            start = beam
        return beam, score, total

    def fitted(self, asked: np.ndarray, k: int, width: int) -> int:
        """The first of width, twice it, … rows of a beam that finds RECALL of the k nearest nodes of a few of the asked."""
        n = len(self.x)
        trial, k = asked[:: -(-len(asked) // TRIALS)], min(k, n)
        least = np.partition(trial @ self.x.T, n - k, axis=1)[:, n - k, None] - 1e-12
        while width < n:
            found = (self.search(trial, width)[1] >= least).sum(axis=1)
            if np.minimum(found, k).mean() >= RECALL * k:
                break
            width *= 2
        return min(width, n)


def _searching(k: int, width: int, exclude_self: bool) -> Callable:
    def search(key: tuple[pa.Scalar, ...], rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = {name: [] for name in ("q", "at", "score", "compared")}
        if rows.num_rows and asked.num_rows:
            graph, q = Graph(rows), _unit(asked.column("embedding"))
            sizes = graph.upto - graph.first
            beam_rows = graph.fitted(q, k + exclude_self, width)
            for at in range(0, len(q), TOGETHER):
                beam, score, compared = graph.search(q[at : at + TOGETHER], beam_rows)
                for i, (nodes, values) in enumerate(zip(beam, np.round(score, DIGITS))):
                    own = nodes >= 0
                    nodes, values = nodes[own], values[own]
                    # A node stands for all rows with its vector; k + 1 of them are enough.
                    some = np.minimum(sizes[nodes], k + 1)
                    place = np.concatenate([np.arange(graph.first[x], graph.first[x] + s) for x, s in zip(nodes, some)])
                    out["at"].append(place)
                    out["q"].append(np.full(len(place), at + i))
                    out["score"].append(np.repeat(values, some))
                    out["compared"].append(np.full(len(place), compared[i]))
        flat = {name: np.concatenate(x) if x else np.empty(0, np.int64) for name, x in out.items()}
        table = pa.table({
            "qid": asked.column("qid").take(pa.array(flat["q"].astype(np.int64))) if rows.num_rows else asked.column("qid").slice(0, 0),
            "id": graph.ids.take(pa.array(flat["at"].astype(np.int64))) if flat["at"].size else rows.column("id").slice(0, 0),
            "score": pa.array(flat["score"].astype(np.float64)), "part": pa.array(np.full(len(flat["q"]), key[0].as_py() or 0, np.int32)),
            "compared": pa.array(flat["compared"].astype(np.int64)),
        })
        if exclude_self:
            table = table.filter(pc.invert(pc.equal(table.column("qid"), table.column("id"))))
        table = table.sort_by([("qid", "ascending"), ("score", "descending"), ("id", "ascending")])
        qid = table.column("qid").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) if table.num_rows else np.empty(0, np.int64)
        begin = np.flatnonzero(np.concatenate([[True], qid[1:] != qid[:-1]])) if len(qid) else np.empty(0, np.int64)
        rank = np.arange(len(qid)) - np.repeat(begin, np.diff(np.append(begin, len(qid))))
        return table.filter(pa.array(rank < k))

    return search


def graph_hits(graph: DataFrame, queries: DataFrame, k: int = TOP_K, *, beam: int = BEAM, exclude_self: bool = False) -> DataFrame:
    """(qid, id, score, part, compared): the k best found in each part, and how many rows were compared there."""
    parts = graph.agg(F.max("part")).first()[0]
    asked = queries.where(F.col("embedding").isNotNull()).select("qid", "embedding", F.explode(F.sequence(F.lit(0), F.lit(parts or 0))).alias("part"))
    schema = T.StructType([
        queries.schema["qid"], graph.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("part", T.IntegerType()),
        T.StructField("compared", T.LongType()),
    ])
    left, right = graph.groupBy("part"), asked.groupBy("part")
    return left.cogroup(right).applyInArrow(_searching(k, max(beam, k + 1), exclude_self), schema)


def graph_topk(graph: DataFrame, queries: DataFrame, k: int = TOP_K, *, beam: int = BEAM, exclude_self: bool = False) -> DataFrame:
    """(qid, id, score, rank): best k by cosine that the walk finds, with a beam of at least `beam`. queries(qid, embedding) are sent to every part;
    the vectors stay in theirs."""
    return best_k(graph_hits(graph, queries, k, beam=beam, exclude_self=exclude_self).select("qid", "id", "score"), k)


def compared_share(hits: DataFrame, rows: int) -> DataFrame:
    """One row: queries, rows compared for all of them, and their share of all pairs."""
    each = hits.groupBy("qid", "part").agg(F.max("compared").alias("compared")).groupBy("qid").agg(F.sum("compared").alias("compared"))
    return each.agg(
        F.count(F.lit(1)).alias("queries"), F.sum("compared").alias("compared"),
        F.round(F.sum("compared") / (F.count(F.lit(1)) * F.lit(max(1, rows))), 4).alias("share"),
    )
