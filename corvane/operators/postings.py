"""A stored inverted index in segments, and top-k search that skips blocks and documents.

A segment is a run of documents that one task reads. In a segment, a term's postings are sorted by what they add to a
score, the highest first, and cut into blocks of BLOCK documents; a block carries its highest count and its shortest
document, which bound what it can add under any average length. Building moves nothing between tasks, and searching
moves only the blocks of asked terms, to the task of their segment.

For a query, a segment first reads the first block of each term: the k-th best of these partial sums is a lower bound
of a hit. Terms are then ordered by the most they can add. A document whose first term in that order is t scores no
more than its block's bound there and the most of all later terms together, so blocks that stay below are not read: the
tails of long lists, and most common words as a whole. Documents found in the others whose upper bound reaches the
k-th best sum are looked up in the lists, and only they are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.ranking import best_k
from corvane.session import stored_table

# Okapi parameters.
K1 = 1.5
B = 0.75
EPSILON = 0.25
#: Postings of a block, and tokens of a segment at least (the document that reaches them ends it, also within a batch).
BLOCK, SEGMENT = 128, 1 << 20
#: Tokens of a document that a row takes to a task, so that Arrow's batches stay small whatever the texts' lengths.
PIECE = 64
#: Queries that travel together.
TOGETHER = 256
#: Scores are rounded to six digits, so bounds give way by this much.
SLACK = 2e-6


@dataclass
class Index:
    """blocks(part, term, no, most, least, docs, counts, ids, lengths), stored; a block row without a term lists the
    segment's ids and lengths. stats(term, df, idf)."""

    blocks: DataFrame
    stats: DataFrame
    n_docs: int
    avgdl: float
    parts: list[int]


def _gain(tf, dl, avgdl: float):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _starts(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Where a document begins; a row with `no` above 0 goes on with the document before it."""
    if "no" not in rows.schema.names:
        return np.ones(rows.num_rows, bool)
    return rows.column("no").to_numpy(zero_copy_only=False) == 0 if rows.num_rows else np.ones(0, bool)


def _segment(part: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    new = _starts(table)
    ids, tokens = table.column("id").filter(pa.array(new)).combine_chunks(), table.column("tokens").combine_chunks()
    pieces = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    n, doc = len(ids), np.cumsum(new) - 1
    sizes = np.bincount(doc, pieces, n).astype(np.int64)
    words = tokens.flatten().dictionary_encode()
    del table, tokens
    key = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key *= n
    key += np.repeat(doc, pieces)
    words = words.dictionary
    key, tf = np.unique(key, return_counts=True)
    term, doc, tf = (key // n).astype(np.int32), (key % n).astype(np.int32), tf.astype(np.int32)
    del key
    # The segment's own mean length is near enough for the order.
    order = np.lexsort((doc, -_gain(tf, sizes[doc], max(1.0, sizes.mean())), term))
    term, doc, tf = term[order], doc[order], tf[order]
    del order
    place = np.arange(len(term)) - np.searchsorted(term, np.arange(len(words), dtype=np.int32))[term]
    begin = np.flatnonzero(place % BLOCK == 0)
    rows = len(begin) + 1
    offsets = pa.array(np.append(begin, len(term)).astype(np.int32))
    none = pa.nulls(1, pa.list_(pa.int32()))
    most = np.maximum.reduceat(tf, begin) if len(begin) else tf
    least = np.minimum.reduceat(sizes[doc], begin) if len(begin) else tf
    unlisted = pa.array([True] * len(begin) + [False])
    last = pa.array([0] * rows + [n], pa.int32())
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(rows, part, np.int64)),
        pa.concat_arrays([words.take(pa.array(term[begin])).cast(pa.string()), pa.nulls(1, pa.string())]),
        pa.array(np.append(place[begin] // BLOCK, 0).astype(np.int32)),
        pa.array(np.append(most, 0).astype(np.int32)), pa.array(np.append(least, 0).astype(np.int32)),
        pa.concat_arrays([pa.ListArray.from_arrays(offsets, pa.array(doc)), none]),
        pa.concat_arrays([pa.ListArray.from_arrays(offsets, pa.array(tf)), none]),
        pa.ListArray.from_arrays(last, ids, mask=unlisted),
        pa.ListArray.from_arrays(last, pa.array(sizes.astype(np.int32)), mask=unlisted),
    ], ["part", "term", "no", "most", "least", "docs", "counts", "ids", "lengths"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, held, size = TaskContext.get().partitionId() << 20, [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False)
        upto, at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), 0
        starts = np.flatnonzero(_starts(batch))
        while at < batch.num_rows:
            # Up to the first document that begins when the segment is full, or the rest of the batch.
            full = max(at, int(np.searchsorted(upto, upto[at] + SEGMENT - size)))
            to = int(starts[i]) if (i := np.searchsorted(starts, full)) < len(starts) else batch.num_rows
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(upto[to] - upto[at])
            if to < batch.num_rows:
                yield _segment(part, held)
                part, held, size = part + 1, [], 0
            at = to
    if held:
        yield _segment(part, held)
    del held
    # The worker stays, idle, beside others.
    pa.default_memory_pool().release_unused()


def _pieces(docs: DataFrame) -> DataFrame:
    """(id, no, tokens): PIECE tokens of a document in a row, in order; one row for a document without tokens."""
    words = F.coalesce("tokens", F.array().cast("array<string>"))
    begin = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(PIECE))
    return docs.select("id", F.posexplode(F.transform(begin, lambda a: F.slice(words, a + 1, PIECE))).alias("no", "tokens"))


def build(docs: DataFrame) -> Index:
    """The index of docs(id, tokens), stored."""
    lists = {name: T.ArrayType(T.IntegerType()) for name in ("docs", "counts")}
    fields = [("part", T.LongType()), ("term", T.StringType()), *[(c, T.IntegerType()) for c in ("no", "most", "least")], *lists.items()]
    fields += [("ids", T.ArrayType(docs.schema["id"].dataType)), ("lengths", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([T.StructField(*f) for f in fields])
    blocks = stored_table(_pieces(docs).mapInArrow(_segments, schema), "blocks")
    total = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, n: a + n)
    # One row for each segment.
    listed = blocks.where(F.col("term").isNull()).select("part", F.size("ids").alias("n"), total.alias("words")).collect()
    n = sum(r.n for r in listed)
    avgdl = sum(r.words for r in listed) / n if n else 1.0
    return Index(blocks, stored_table(_stats(blocks, n), "stats"), n, avgdl or 1.0, sorted(r.part for r in listed))


def _stats(blocks: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf); a negative idf becomes a share of the mean over all terms."""
    df = blocks.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    scored = df.withColumn("raw", F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = scored.select(F.avg("raw")).scalar()
    return scored.select("term", "df", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf"))


# ---- search -----------------------------------------------------------------------------------------------------


class Segment:
    """The blocks of one segment that hold asked terms, in a task."""

    def __init__(self, table: pa.Table, avgdl: float) -> None:
        listed = table.filter(pc.is_null(table.column("term")))
        self.ids = listed.column("ids").combine_chunks().flatten()
        lengths = listed.column("lengths").combine_chunks().flatten().to_numpy()
        order = pc.sort_indices(self.ids).to_numpy()
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        table = table.filter(pc.is_valid(table.column("term"))).sort_by([("term", "ascending"), ("no", "ascending")])
        names = table.column("term").combine_chunks().dictionary_encode()
        self.terms = names.dictionary
        code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.searchsorted(code, np.arange(len(self.terms) + 1))
        self.top = _gain(*(table.column(c).to_numpy().astype(np.float64) for c in ("most", "least")), avgdl)
        docs = table.column("docs").combine_chunks()
        sizes = pc.list_value_length(docs).to_numpy(zero_copy_only=False).astype(np.int64)
        self.upto = np.concatenate([[0], np.cumsum(sizes)])
        # Places in a segment, and so in its lists, fit 32 bits.
        self.docs = docs.flatten().to_numpy()
        counts = table.column("counts").combine_chunks().flatten().to_numpy().astype(np.float64)
        self.values = _gain(counts, lengths[self.docs].astype(np.float64), avgdl)
        # The same postings by document, to look some up.
        self.by_doc = np.lexsort((self.docs, np.repeat(code.astype(np.int32), sizes))).astype(np.int32)
        self.sorted_docs = self.docs[self.by_doc]
        # A block's bound may lie above an earlier one's; the highest of the rest bounds a tail.
        self.rest = self.top.copy()
        for t in range(len(self.terms)):
            a, b = self.first[t], self.first[t + 1]
            if b - a > 1:
                self.rest[a:b] = np.maximum.accumulate(self.top[a:b][::-1])[::-1]

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The best k documents for the terms, their rounded scores, and how many postings were read or looked up."""
        n, good = len(self.ids), weights > 0
        lost = -(weights * self.rest[self.first[terms]])[~good].sum()
        ts, ws = terms[good], weights[good]
        first, past = self.first[ts], self.first[ts + 1]
        most = ws * self.rest[first]
        order = np.argsort(-most, kind="stable")
        ts, ws, first, past, most = ts[order], ws[order], first[order], past[order], most[order]
        if not len(ts):
            return np.empty(0, np.int64), np.empty(0), 0
        partial = self._sums(ws, first, first + 1, n)
        floor = np.partition(partial, -k)[-k] - lost - SLACK if n > k else 0.0
        later = most.sum() - np.cumsum(most)
        # As many blocks of each term as can still hold a document whose first term it is.
        least = (max(floor, 0.0) - later) / ws
        take = np.array([a + np.searchsorted(-self.rest[a:b], -x, "right") for a, b, x in zip(first, past, least)])
        unread = np.where(take < past, ws * self.rest[np.minimum(take, past - 1)], 0.0)
        sums = self._sums(ws, first, take, n)
        open_ = unread.sum() - self._sums(unread, first, take, n, ones=True)
        if n > k:
            floor = max(floor, np.partition(sums, -k)[-k] - lost - SLACK)
        able = np.flatnonzero((sums > 0) & (sums + open_ >= floor))
        read = int((self.upto[take] - self.upto[first]).sum())
        exact, looked, own = np.zeros(len(able)), 0, able.astype(np.int32)
        # Every term in one fixed order, so that sums are the same on every run.
        for t, w in zip(terms, weights):
            lo, hi = self.upto[self.first[t]], self.upto[self.first[t + 1]]
            at = lo + np.searchsorted(self.sorted_docs[lo:hi], own)
            hit = (at < hi) & (self.sorted_docs[np.minimum(at, hi - 1)] == able)
            exact[hit] += w * self.values[self.by_doc[at[hit]]]
            looked += int(hit.sum())
        exact = np.round(exact, 6)
        keep = np.lexsort((self.rank[able], -exact))[:k]
        keep = keep[exact[keep] > 0]
        return able[keep], exact[keep], min(read + looked, int((self.upto[past] - self.upto[first]).sum()))

    def _sums(self, each: np.ndarray, first: np.ndarray, to: np.ndarray, n: int, ones: bool = False) -> np.ndarray:
        lo, hi = self.upto[first], self.upto[to]
        at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])
        value = np.repeat(each, hi - lo)
        return np.bincount(self.docs[at], value if ones else value * self.values[at], n)


def _searching(k: int, avgdl: float) -> Callable:
    def search(key: tuple[pa.Scalar, ...], blocks: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"q": [], "doc": [], "score": [], "read": [], "all": []}
        qids = pa.array([], asked.schema.field("terms").type.value_type.field("qid").type)
        ids = pa.array([], blocks.schema.field("ids").type.value_type)
        if blocks.num_rows and asked.num_rows:
            segment = Segment(blocks, avgdl)
            flat = asked.column("terms").combine_chunks().flatten()
            own = pc.index_in(flat.field("term"), value_set=segment.terms)
            here = pc.is_valid(own)
            qid = flat.field("qid").filter(here).dictionary_encode()
            own, weight = own.filter(here).to_numpy(zero_copy_only=False), flat.field("weight").filter(here).to_numpy(zero_copy_only=False)
            group = qid.indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((own, group))
            cuts = np.searchsorted(group[order], np.arange(len(qid.dictionary) + 1))
            lists = np.diff(segment.upto[segment.first])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                mine = order[lo:hi]
                docs, scores, read = segment.best(own[mine], weight[mine], k)
                out["q"].append(np.full(len(docs), group[mine[0]]))
                out["doc"].append(docs)
                out["score"].append(scores)
                out["read"].append(np.full(len(docs), read))
                out["all"].append(np.full(len(docs), lists[own[mine]].sum()))
            qids, ids = qid.dictionary, segment.ids
        flat = {name: np.concatenate(x) if x else np.empty(0) for name, x in out.items()}
        return pa.table({
            "qid": qids.take(pa.array(flat["q"].astype(np.int64))), "id": ids.take(pa.array(flat["doc"].astype(np.int64))),
            "score": pa.array(flat["score"].astype(np.float64)), "part": pa.array(np.full(len(flat["q"]), key[0].as_py() or 0, np.int64)),
            "read": pa.array(flat["read"].astype(np.int64)), "postings": pa.array(flat["all"].astype(np.int64)),
        })

    return search


def hits(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, part, read, postings): the best k of each segment for terms(qid, term, qtf), with scores above
    0, and how many of the postings of the query's terms were read or looked up there."""
    weights = terms.join(index.stats, "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    asked = stored_table(weights, "asked")
    wanted = asked.select("term").distinct()
    blocks = index.blocks.join(wanted, "term", "left_semi").unionByName(index.blocks.where(F.col("term").isNull()))
    groups = asked.select("qid").distinct().count() // TOGETHER + 1
    packed = asked.groupBy(F.pmod(F.xxhash64("qid"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("qid", "term", "weight")).alias("terms"))
    every = F.split(F.lit(",".join(map(str, index.parts))), ",").cast("array<bigint>")
    sent = packed.withColumn("part", F.explode(every if index.parts else F.array().cast("array<bigint>")))
    found = T.StructType([
        asked.schema["qid"], T.StructField("id", index.blocks.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType()),
        *[T.StructField(c, T.LongType()) for c in ("part", "read", "postings")],
    ])
    return blocks.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(_searching(k, index.avgdl), found)


def search(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the best k documents for terms(qid, term, qtf), with scores above 0."""
    return best_k(hits(index, terms, k).select("qid", "id", "score"), k)


def read_share(found: DataFrame) -> DataFrame:
    """One row for `hits`: postings of the asked terms in the segments that gave any, those read, and their share."""
    each = found.groupBy("qid", "part").agg(F.max("read").alias("read"), F.max("postings").alias("postings"))
    return each.agg(F.sum("postings").alias("postings"), F.sum("read").alias("read"), F.round(F.sum("read") / F.sum("postings"), 4).alias("share"))
