"""Token-id output: documents packed best-fit-decreasing into fixed rows of ids, ready for a trainer.

Each task packs windows of its own documents, so nothing is shuffled and a window bounds memory. Within a window the
longest piece goes first, into the fullest row that still has room; a segment tree over the free capacities finds
that row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import text_slices
from corvane.llm.tokens import STEP_BYTES, encode, word_ids

#: Tokens packed together.
WINDOW = 1 << 21
SCHEMA = (
    "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_starts array<int>, "
    "doc_ids array<long>, doc_starts array<long>"
)


class Capacities:
    """Rows by free capacity, under a segment tree that finds the smallest free capacity of at least n."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = np.zeros(2 * self.size, bool).tolist()
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._mark(free, True)

    def take(self, n: int) -> tuple[int, int] | None:
        """The fullest row with room for n: (free capacity, row), or None."""
        tree, at = self.tree, n + self.size
        if not tree[at]:
            # Up to the first right sibling that holds a row, then down its left edge.
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        free = at - self.size
        row = self.rows[free].pop()
        if not self.rows[free]:
            self._mark(free, False)
        return free, row

    def _mark(self, free: int, value: bool) -> None:
        at = free + self.size
        self.tree[at] = value
        while at > 1:
            at >>= 1
            value = self.tree[2 * at] or self.tree[2 * at + 1]
            if self.tree[at] == value:
                break
            self.tree[at] = value


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Piece numbers of each row, longest pieces first."""
    rows: list[list[int]] = []
    free = Capacities(capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = free.take(n)
        if found is None:
            found = capacity, len(rows)
            rows.append([])
        rows[found[1]].append(i)
        if found[0] > n:
            free.add(found[0] - n, found[1])
    return rows


def pack_ids(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end: int = 0, bits: int = 16, window: int = WINDOW) -> DataFrame:
    """Rows of at most `capacity` token ids from docs(doc_id, text).

    ids holds n_tokens little-endian unsigned numbers of `bits` bits (16 or 32; ids must fit). cu_seqlens are the
    cumulative segment lengths from 0, position_starts the position of each segment's first id: 0 where a document
    begins, and where a cut document goes on, the place it goes on from. doc_ids and doc_starts name each segment,
    so documents can be put together again without loss. Defined results: a null or empty text is its end id alone;
    a null doc_id is kept as null; repeated rows are packed once each; an empty table gives no rows; other columns
    are ignored.
    """
    kind = {16: "<u2", 32: "<u4"}[bits]

    def out(pieces: list[tuple[int | None, int, np.ndarray]], row: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.array([len(p[2]) for p in pieces])
        rows = []
        for members in best_fit(lengths, capacity):
            own = [pieces[i] for i in members]
            cu = np.concatenate([[0], np.cumsum(lengths[members])]).tolist()
            ids = np.concatenate([p[2] for p in own]).tobytes()
            rows.append((row, cu[-1], ids, cu, [p[1] for p in own], [p[0] for p in own], [p[1] for p in own]))
            row += 1
        types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["sequence_id", "n_tokens", "ids", "cu_seqlens", "position_starts", "doc_ids", "doc_starts"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names), row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_ids(tokenizer, end)
        row = TaskContext.get().partitionId() << 40
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held = 0
        for whole in batches:
            for batch in text_slices(whole, "text", STEP_BYTES):
                ids, offsets = encode(cache, batch.column("text"))
                if len(ids) and int(ids.max()) >> bits:
                    raise ValueError(f"token ids do not fit in {bits} bits")
                ids = ids.astype(kind)
                for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    pieces += [(doc, lo - a, ids[lo : min(lo + capacity, b)]) for lo in range(a, b, capacity)]
                held += len(ids)
                if held >= window:
                    made, row = out(pieces, row)
                    yield made
                    pieces, held = [], 0
        if pieces:
            yield out(pieces, row)[0]

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
