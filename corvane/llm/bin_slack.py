"""Best-fit packing by minimum bin slack over the lengths that exist.

There are at most `capacity` different lengths, so the packing is planned on their counts: for each bin, the longest
piece left and the combination of the others that fills the bin best, found by a subset sum over bitsets. A
combination is used as often as the counts allow, which makes the plan as short as there are lengths, whatever the
number of documents. Then every piece finds its place by its rank within its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import pieces_for, rank_within, row_key, stored, text_slices
from corvane.llm.tokens import STEP_BYTES, encode, word_ids

_PIECES = "doc_id long, rk long, piece int, start long, length long, ids_crc32 long"


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest bin that holds the longest piece left: length -> how many."""
    first = max(counts)
    room = capacity - first
    items, reach = [], [1]
    mask = (1 << room + 1) - 1
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length] - (length == first), room // length), 1
        while left > 0:
            take = min(take, left)
            items.append((length, take))
            reach.append((reach[-1] | reach[-1] << length * take) & mask)
            left -= take
            take *= 2
        if reach[-1] >> room:
            break
    at, out = reach[-1].bit_length() - 1, {first: 1}
    for (length, take), before in zip(reversed(items), reversed(reach[:-1])):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank, pieces, per bin, first bin, offset): where the pieces of a length from a rank on lie."""
    left = {k: v for k, v in counts.items() if v}
    used = dict.fromkeys(left, 0)
    rows, bins = [], 0
    while left:
        one = fullest(left, capacity)
        times = min(left[k] // m for k, m in one.items())
        offset = 0
        for length, m in one.items():
            rows.append((length, used[length], m * times, m, bins, offset))
            used[length] += m * times
            left[length] -= m * times
            offset += length * m
            if not left[length]:
                del left[length]
        bins += times
    return rows


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int = 0) -> DataFrame:
    """The ids of each document cut into pieces of `capacity`: (doc_id, rk, piece, start, length, ids_crc32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_ids(tokenizer, end)
        for whole in batches:
            for batch in text_slices(whole, "text", STEP_BYTES):
                ids, offsets = encode(cache, batch.column("text"))
                rows = []
                for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    for i, lo in enumerate(range(a, b, capacity)):
                        hi = min(lo + capacity, b)
                        rows.append((d, i, lo - a, hi - lo, zlib.crc32(ids[lo:hi].astype("<u4").tobytes())))
                d, piece, start, length, crc = zip(*rows)
                at = pa.array(d, pa.int32())
                cols = [batch.column("doc_id").take(at), batch.column("rk").take(at), pa.array(piece, pa.int32())]
                cols += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "rk", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long"), row_key(F.col("doc_id"), F.col("text")).alias("rk"), F.col("text").cast("string"))
    return rows.mapInArrow(run, _PIECES)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048) -> DataFrame:
    """Places the token pieces of docs(doc_id, text) in sequences of at most `capacity` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents longer than `capacity` are
    cut. Defined results: a null or empty text is its end id alone; a null doc_id is packed like any other; repeated
    rows are packed once each; an empty table gives no rows; other columns are ignored.
    """
    pieces = stored(token_pieces(docs, tokenizer, capacity), "pieces")
    # At most `capacity` rows.
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    total = sum(counts.values())
    split = pieces_for(total)
    ranked = rank_within(
        pieces, ["length"], [F.col("rk"), F.col("doc_id"), F.col("piece")],
        F.pmod(F.xxhash64("rk", "piece"), F.lit(split)).cast("int"), "rank",
    )
    schema = "length long, first long, pieces long, per_bin long, bin long, at long"
    places = docs.sparkSession.createDataFrame(plan(counts, capacity), schema)
    # The plan's size depends on `capacity` alone, so it can be sent to every task.
    hits = ranked.join(F.broadcast(places), "length").filter("rank >= first and rank < first + pieces")
    place = F.col("rank") - F.col("first")
    return hits.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.floor(place / F.col("per_bin"))).alias("sequence_id"),
        (F.col("at") + F.pmod(place, F.col("per_bin")) * F.col("length")).alias("offset"),
    )
