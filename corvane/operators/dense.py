"""Vector search by cosine similarity: exact in the cells of pivots, and approximate over hyperplane buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.ranking import best_k
from corvane.session import stored_table

# Channel depth and declared vector size.
TOP_K = 20
DEFAULT_DIMS = 1024
DIGITS = 6
#: Vectors of one tile of a cell; queries that may share a task with one; rows that one product takes.
TILE_ROWS, QUERY_ROWS, STRIP = 16_384, 65_536, 256
#: Scores that one product makes, so that a task's arrays do not grow with the cells.
SCORES = 1 << 20
#: Pivots at most, and components (dimensions times pivots) at most.
PIVOTS, COMPONENTS = 1024, 1 << 21
#: Scores are rounded to six digits, so cells a little below the k-th score are still looked at.
SLACK = 2e-6
#: Buckets: signs of `bits` planes for each of `tables` tables. Fewer bits find more and compare more.
BITS, TABLES = 4, 16


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """An Arrow column of vectors of one length as unit rows."""
    if not len(column):
        return np.empty((0, 0))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


@dataclass
class Cells:
    """Vectors in the cells of their nearest pivots: rows(id, embedding, cell), stored, and per cell (a plain row for
    each pivot) how many there are and the least and greatest angle to the pivot."""

    rows: DataFrame
    pivots: np.ndarray
    count: np.ndarray
    least: np.ndarray
    most: np.ndarray


def pivot_cells(vectors: DataFrame, pivots: int | None = None) -> Cells:
    """Cells of vectors(id, embedding). Pivots are a fixed random draw, as many as an eighth of the root of the rows
    and PIVOTS at most; a cell of any size is searched in tiles."""
    vectors = vectors.where(F.col("embedding").isNotNull())
    rows, size = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    wanted = pivots or max(1, min(PIVOTS, COMPONENTS // max(1, size or 1), int(rows**0.5) // 8))
    drawn = _rows(vectors.orderBy(F.xxhash64("id"), "id").limit(wanted).select("embedding").toArrow().column("embedding"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strip = max(1, min(4096, SCORES // max(1, len(drawn))))
            for at in range(0, batch.num_rows, strip):
                part = batch.slice(at, strip)
                near = _rows(part.column("embedding")) @ drawn.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], [*part.schema.names, "cell", "angle"])

    schema = T.StructType([vectors.schema["id"], vectors.schema["embedding"], T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    placed = stored_table(vectors.select("id", "embedding").mapInArrow(place, schema), "cells")
    count, least, most = np.zeros(wanted, np.int64), np.zeros(wanted), np.zeros(wanted)
    # One row for each pivot.
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).collect():
        count[r.cell], least[r.cell], most[r.cell] = r.n, r.lo, r.hi
    return Cells(placed.drop("angle"), drawn, count, least, most)


def _visits(pivots: np.ndarray, count: np.ndarray, least: np.ndarray, most: np.ndarray, k: int) -> Callable:
    """The cells that a query reads: without a k-th score those with the best possible scores, as many as hold k
    vectors; with one, all others that could hold a vector as good. What a cell can hold follows from the triangle
    inequality on angles: no vector of it is nearer to the query than the pivot's angle less the cell's ring."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.flatnonzero(count)
        for batch in batches:
            for at in range(0, batch.num_rows if len(filled) else 0, STRIP):
                part = batch.slice(at, STRIP)
                angle = np.arccos(np.clip(_rows(part.column("embedding")) @ pivots[filled].T, -1, 1))
                off = np.maximum(0, np.maximum(angle - most[filled], least[filled] - angle) - 1e-9)
                best = np.cos(np.minimum(off, np.pi))
                order = np.argsort(-best, axis=1, kind="stable")
                held = count[filled][order]
                wanted = np.zeros(best.shape, bool)
                np.put_along_axis(wanted, order, held.cumsum(axis=1) - held < k, axis=1)
                if "kth" in part.schema.names:
                    kth = part.column("kth").fill_null(-2.0).to_numpy(zero_copy_only=False)
                    wanted = ~wanted & (best >= kth[:, None] - SLACK)
                row, cell = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays([part.column("qid").take(pa.array(row)), pa.array(filled[cell].astype(np.int32))], ["qid", "cell"])

    return visit


def _best_of_tile(k: int, exclude_self: bool) -> Callable:
    def search(key: tuple[pa.Scalar, ...], vectors: pa.Table, asked: pa.Table) -> pa.Table:
        out = [asked.select(["qid"]).slice(0, 0).append_column("id", vectors.column("id").slice(0, 0)).append_column("score", pa.array([], pa.float64()))]
        if vectors.num_rows and asked.num_rows:
            vectors = vectors.sort_by("id")
            ids, qids = vectors.column("id").to_numpy(), asked.column("qid").to_numpy()
            rows, want = _rows(vectors.column("embedding")), _rows(asked.column("embedding"))
            strip = max(1, min(STRIP, SCORES // len(ids)))
            for at in range(0, len(want), strip):
                scores = want[at : at + strip] @ rows.T
                np.round(scores, DIGITS, out=scores)
                if exclude_self:
                    own = np.searchsorted(ids, qids[at : at + strip])
                    last = np.searchsorted(ids, qids[at : at + strip], "right")
                    for i in np.flatnonzero(own < last):
                        scores[i, own[i] : last[i]] = -np.inf
                # The k-th score first, then only what reaches it is sorted; ids are in order already.
                kth = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(scores), -np.inf)
                q, v = np.nonzero((scores >= kth[:, None]) & (scores > -np.inf))
                value = scores[q, v]
                order = np.lexsort((v, -value, q))
                q, v, value = q[order], v[order], value[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                out.append(pa.table({
                    "qid": asked.column("qid").take(pa.array(at + q[keep])), "id": vectors.column("id").take(pa.array(v[keep])), "score": pa.array(value[keep]),
                }))
        return pa.concat_tables(out)

    return search


@dataclass
class ExactSearch:
    """hits(qid, id, score, rank), and the visits(qid, cell) that were made."""

    hits: DataFrame
    visits: DataFrame

    def compared_share(self, cells: Cells) -> DataFrame:
        """One row: queries, rows compared for all of them, and their share of all pairs."""
        sizes = cells.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        total = int(cells.count.sum())
        return self.visits.join(sizes, "cell").agg(
            F.count_distinct("qid").alias("queries"), F.sum("n").alias("compared"),
            F.round(F.sum("n") / (F.count_distinct("qid") * F.lit(max(1, total))), 4).alias("share"),
        )


def search_cells(cells: Cells, queries: DataFrame, k: int = TOP_K, *, exclude_self: bool = False) -> ExactSearch:
    """The exact best k by cosine for queries(qid, embedding).

    Each query first reads the cells that could hold its best vectors, as many as hold k. No vector outside a cell's
    ring of angles can lie in it, so a cell whose best possible score is below the k-th score found is skipped. Vectors
    stay in their cells; a query goes to the cells it has to read.
    """
    queries = queries.where(F.col("embedding").isNotNull()).select("qid", "embedding")
    schema = T.StructType([queries.schema["qid"], T.StructField("cell", T.IntegerType())])
    visit = _visits(cells.pivots, cells.count, cells.least, cells.most, k + int(exclude_self))
    first = queries.mapInArrow(visit, schema)
    found = T.StructType([queries.schema["qid"], cells.rows.schema["id"], T.StructField("score", T.DoubleType())])
    tiles = [max(1, -(-int(n) // TILE_ROWS)) for n in cells.count]
    tile = F.get(F.split(F.lit(",".join(map(str, tiles))), ",").cast("array<int>"), F.col("cell"))
    blocks = -(-queries.count() // QUERY_ROWS) or 1
    spread = cells.rows.withColumn("tile", F.pmod(F.xxhash64("id"), tile).cast("int"))
    if blocks > 1:
        spread = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    else:
        spread = spread.withColumn("block", F.lit(0))

    def read(wanted: DataFrame) -> DataFrame:
        sent = wanted.select("qid", "cell").join(queries, "qid").withColumn("tile", F.explode(F.sequence(F.lit(0), tile - 1)))
        sent = sent.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
        keys = ["cell", "tile", "block"]
        return spread.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_best_of_tile(k, exclude_self), found)

    one = stored_table(read(first), "first-hits")
    kth = best_k(one, k).groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    more = queries.join(kth, "qid", "left").mapInArrow(visit, schema)
    return ExactSearch(best_k(one.unionByName(read(more)), k), first.unionByName(more))


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, *, exclude_self: bool = False) -> DataFrame:
    """(qid, id, score, rank): exact best k by cosine of vectors(id, embedding) for queries(qid, embedding)."""
    return search_cells(pivot_cells(vectors), queries, k, exclude_self=exclude_self).hits


def planes(dims: int, bits: int = BITS, tables: int = TABLES) -> np.ndarray:
    """(tables, bits, dims) components in [-1, 1): multiplicative hashes of their places, so any engine can make them."""
    at = np.arange(tables * bits * dims, dtype=np.int64).reshape(tables, bits, dims) + 1
    for factor in (1103515245, 40503, 69069):
        at = (at * factor + 12345) % 2**32
        at ^= at >> 15
    return at / 2.0**31 - 1


def lsh_index(vectors: DataFrame, *, dims: int, bits: int = BITS, tables: int = TABLES) -> DataFrame:
    """Adds `codes`, one hyperplane bucket per hash table; store the result to build it once."""
    cut = planes(dims, bits, tables).reshape(tables * bits, dims)
    weight = 1 << np.arange(bits)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def codes(embedding: pd.Series) -> pd.Series:
        if not len(embedding):
            return pd.Series([], dtype=object)
        sign = np.stack(embedding).astype(np.float64) @ cut.T >= 0
        return pd.Series(list((sign.reshape(len(embedding), tables, bits) @ weight).astype(np.int32)))

    return vectors.withColumn("codes", codes("embedding"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def lsh_candidates(index: DataFrame, queries: DataFrame, *, exclude_self: bool = False) -> DataFrame:
    """Distinct (qid, id) that share a bucket in some table, by an equi-join on (table, code)."""
    left = index.select("id", F.posexplode("codes").alias("table", "code"))
    right = queries.select("qid", F.posexplode("codes").alias("table", "code"))
    pairs = right.join(left, ["table", "code"]).select("qid", "id").distinct()
    return pairs.where(F.col("qid") != F.col("id")) if exclude_self else pairs


def lsh_topk(index: DataFrame, queries: DataFrame, k: int = TOP_K, *, exclude_self: bool = False) -> DataFrame:
    """(qid, id, score, rank): best k by cosine among rows sharing a bucket with the query.

    index(id, embedding, codes) and queries(qid, embedding, codes) both come from lsh_index. Only candidates are
    compared.
    """
    unit = lambda df, key: df.select(key, F.col("embedding"), F.sqrt(_dot(F.col("embedding"), F.col("embedding"))).alias("norm"))
    one, two = unit(queries, "qid").toDF("qid", "_q", "_qn"), unit(index, "id").toDF("id", "_v", "_vn")
    pairs = lsh_candidates(index, queries, exclude_self=exclude_self).join(one, "qid").join(two, "id")
    cosine = F.coalesce(F.try_divide(_dot(F.col("_q"), F.col("_v")), F.col("_qn") * F.col("_vn")), F.lit(0.0))
    return best_k(pairs.select("qid", "id", F.round(cosine, DIGITS).alias("score")), k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits the approximate search found."""
    found = exact.join(approximate.select("qid", "id", F.lit(1).alias("_hit")), ["qid", "id"], "left")
    return found.agg(
        F.count(F.lit(1)).alias("exact_hits"),
        F.count("_hit").alias("found"),
        F.round(F.try_divide(F.count("_hit"), F.count(F.lit(1))), 3).alias("recall"),
    )


def vector_dims(vectors: DataFrame, declared: int = DEFAULT_DIMS, column: str = "embedding") -> DataFrame:
    """Rows per actual size and whether it is the declared one."""
    return vectors.groupBy(F.size(column).alias("dims")).agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "ok", F.col("dims") == declared
    )
