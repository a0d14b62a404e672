"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A document's signature is 32 minimum hashes of its word shingles, 16 bits each, held as 8 chunks of 4. Two
signatures at a distance (number of unequal positions) of at most 15 have, by the pigeonhole principle, a chunk with
at most one unequal position: eight chunks with two each would make 16. So every chunk gives four keys, each leaving
one position out, and all pairs within the distance share a key. A pair with a Jaccard similarity of 0.8 exceeds the
distance with a probability of 1.5e-4, and then still shares a key in all but about 1e-6 of cases. The distance itself
is not tested: every pair that shares a key is a candidate, unless exact bounds rule it out, and candidates are
confirmed on the full shingle sets.

Documents with equal sets are one node, so copies are never paired. Pairs are found in three rounds, so that a large
group of near copies never becomes all its pairs. First each node is tested, in the largest of its buckets, against
the most central nodes of a piece of it and its nearest one, and the links are joined into components. Then each node
is tested against the nearest nodes of other components in every bucket. Last, all pairs that share a bucket and
still lie in different components are tested, so no link between components can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import mix, row_key, stored, text_bytes, text_slices, windows, word_hashes, word_spans
from corvane.llm.components import connected

CHUNKS, PER_CHUNK, BITS = 8, 4, 16
POSITIONS = CHUNKS * PER_CHUNK
#: Rows of one bucket that are compared with each other in the first rounds, and that a task holds in the last.
PIECE, TILE = 256, 2048
#: Central nodes of a piece that all others are tested against, and nearest ones.
CENTRES, NEAREST = 2, 2
#: Bits of a set's parity, and the mark of a pair that is not to be tested.
PARITY, FAR = 1024, 1 << 30
#: Pairs of small groups that are compared in one step.
PAIRS = 1 << 16
#: Shingles of a shard in which they are compared for being shared.
SHARD_SHINGLES = 4 << 20
_SEEDS = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_C = [f"c{i}" for i in range(CHUNKS)]
_NODE = ["n", "s", "bits", *_C]
_SKETCH = "doc_id long, rk long, n int, cid long, " + ", ".join(f"{c} long" for c in _C)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row, row after row, and where each row begins."""
    raw, offsets = text_bytes(column)
    starts, ends, first = word_spans(raw, offsets)
    hashes, begin = windows(word_hashes(raw, starts, ends), first, k)
    sets = [np.unique(hashes[a:b]) for a, b in zip(begin[:-1], begin[1:])]
    return (np.concatenate(sets) if sets else hashes), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def sketch(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, rk, n, cid, c0..c7) of every row: set size, the set's name, and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                sets, begin = shingle_sets(batch.column("text"), k)
                n = np.diff(begin)
                some = np.flatnonzero(n)
                cid = np.zeros(len(n), np.uint64)
                chunks = np.zeros((CHUNKS, len(n)), np.uint64)
                if len(some):
                    at = begin[:-1][some]
                    one, two = np.add.reduceat(mix(sets), at), np.add.reduceat(mix(~sets), at)
                    cid[some] = mix(mix(one + n[some].astype(np.uint64)) ^ two)
                    for p in range(POSITIONS):
                        low = np.minimum.reduceat((sets ^ _SEEDS[p]) * np.uint64(0x9E3779B97F4A7C15 + 2 * p), at)
                        chunks[p // PER_CHUNK][some] |= (mix(low) >> np.uint64(64 - BITS)) << np.uint64(BITS * (p % PER_CHUNK))
                cols = [batch.column("doc_id"), batch.column("rk"), pa.array(n.astype(np.int32)), pa.array(cid.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(c.view(np.int64)) for c in chunks]], ["doc_id", "rk", "n", "cid", *_C])

    rows = docs.select(F.col("doc_id").cast("long"), row_key(F.col("doc_id"), F.col("text")).alias("rk"), F.col("text").cast("string"))
    return rows.mapInArrow(run, _SKETCH)


def classes(sketches: DataFrame) -> DataFrame:
    """One row for each different non-empty set, with one row key that has it."""
    aggs = [F.max("rk").alias("rk"), F.max("n").alias("n"), *[F.max(c).alias(c) for c in _C]]
    return sketches.filter("n > 0").groupBy("cid").agg(*aggs)


def bucket_keys(nodes: DataFrame) -> DataFrame:
    """(key, slot, cid, m): each chunk with each one of its positions left out, where m > 1 nodes share it."""
    ones = (1 << 64) - 1
    keys = []
    for i, c in enumerate(_C):
        for p in range(PER_CHUNK):
            mask = ones ^ ((1 << BITS) - 1 << BITS * p)
            mask -= (1 << 64) if mask >> 63 else 0
            keys.append(F.xxhash64(F.lit(i * PER_CHUNK + p), F.col(c).bitwiseAND(F.lit(mask).cast("long"))))
    rows = nodes.select("cid", F.posexplode(F.array(*keys)).alias("slot", "key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    return rows.join(shared, "key").select("key", "slot", "cid", "m")


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    packed = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _C], axis=1)
    return np.ascontiguousarray(packed).view(np.uint16)


def _first_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first slot whose key each pair of signatures of a group shares, POSITIONS if it shares none."""
    slot = np.full((*a.shape[:2], b.shape[1]), POSITIONS, np.uint8)
    for c in range(CHUNKS):
        unequal, where = np.zeros_like(slot), np.zeros_like(slot)
        for p in range(PER_CHUNK):
            off = a[:, :, None, c * PER_CHUNK + p] != b[:, None, :, c * PER_CHUNK + p]
            unequal += off
            where += off * np.uint8(p)
        # With no unequal position all four keys are shared, the first one first.
        new = (unequal <= 1) & (slot == POSITIONS)
        slot[new] = (c * PER_CHUNK + where)[new]
    return slot


def _parity(shingles: np.ndarray) -> bytes:
    """PARITY bits; each shingle flips one. Two sets differ in at least as many shingles as their bits differ."""
    return np.packbits(np.bincount((shingles >> np.uint64(48)).astype(np.int64) % PARITY, minlength=PARITY) & 1).tobytes()


@dataclass
class Nodes:
    """Nodes as arrays: names, set sizes, shared shingles, signatures and parities."""

    cid: np.ndarray
    n: np.ndarray
    s: np.ndarray
    sig: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Nodes:
        cid, n, s = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "n", "s"))
        bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(len(cid), -1)
        return cls(cid, n.astype(np.int64), s.astype(np.int64), _signatures(batch), bits)

    def apart(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """The least number of shingles in which the nodes i and j of each group (a row of both) can differ, FAR if
        they cannot reach the similarity."""
        total = self.n[i][:, :, None] + self.n[j][:, None]
        # Two sets have at most the shingles in common that each of them shares with any.
        near = (100 + percent) * np.minimum(self.s[i][:, :, None], self.s[j][:, None]) >= percent * total
        out = np.full(total.shape, FAR, np.int32)
        g, x, y = np.nonzero(near)
        differ = np.bitwise_count(self.bits[i[g, x]] ^ self.bits[j[g, y]]).sum(axis=1, dtype=np.int64)
        both = total[g, x, y]
        ok = (100 + percent) * (both - differ) >= 2 * percent * both
        out[g[ok], x[ok], y[ok]] = differ[ok]
        return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups of rows that arrive sorted by `keys`, many at a time, and where each begins (one more at the end);
    a group may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        both = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        same = np.ones(both.num_rows - 1, bool)
        for k in keys:
            v = both.column(k).to_numpy(zero_copy_only=False)
            same &= v[1:] == v[:-1]
        cuts = np.flatnonzero(~same) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        if last:
            yield both.slice(0, last), np.concatenate([[0], cuts])
        held = [both.slice(last)]
    if held:
        rest = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield rest, np.array([0, rest.num_rows])


def _pieces(begin: np.ndarray) -> np.ndarray:
    """Groups cut into pieces of at most PIECE rows."""
    long = np.flatnonzero(np.diff(begin) > PIECE)
    return np.unique(np.concatenate([begin, *[np.arange(begin[i], begin[i + 1], PIECE) for i in long]]))


def _alike(begin: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The rows of groups of one size from 2 to `most`, a group in each line, so many that their pairs are PAIRS at most
    (or one group)."""
    sizes = np.diff(begin)
    for size in np.unique(sizes[(sizes > 1) & (sizes <= most)]).tolist():
        at = begin[:-1][sizes == size]
        step = max(1, PAIRS // size**2)
        for lo in range(0, len(at), step):
            yield at[lo : lo + step, None] + np.arange(size)


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if found:
        a, b = (np.concatenate(x) for x in zip(*found))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _candidates(groups: Iterator[tuple[pa.RecordBatch, np.ndarray]], pick) -> Iterator[pa.RecordBatch]:
    """The pairs of rows that pick(batch, nodes, begin) yields, by name."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for batch, begin in groups:
        nodes = Nodes.of(batch)
        for i, j in pick(batch, nodes, begin):
            if len(i):
                found.append((nodes.cid[i], nodes.cid[j]))
                held += len(i)
            if held > 1 << 16:
                yield from _pairs(found)
                found, held = [], 0
    yield from _pairs(found)


def central_pairs(members: DataFrame, percent: int) -> DataFrame:
    """In pieces of each node's largest bucket: every node with the most central ones and its nearest one."""

    def pick(batch, nodes, begin):
        for rows in _alike(_pieces(begin), PIECE):
            d = nodes.apart(rows, rows, percent)
            d[:, np.arange(rows.shape[1]), np.arange(rows.shape[1])] = FAR
            g, j = np.nonzero(d.min(axis=1) < FAR)
            yield rows[g, d.argmin(axis=1)[g, j]], rows[g, j]
            for centre in np.argsort(-(d < FAR).sum(axis=1), axis=1, kind="stable")[:, :CENTRES].T:
                g, j = np.nonzero(d[np.arange(len(rows)), centre] < FAR)
                yield rows[g, centre[g]], rows[g, j]

    home = Window.partitionBy("cid").orderBy(F.desc("m"), "key")
    part = F.pmod(F.xxhash64("cid", "key"), F.ceil(F.col("m") / PIECE))
    rows = members.withColumn("home", F.row_number().over(home)).filter("home = 1").select("key", part.alias("part"), "cid", *_NODE)
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", "cid")
    return rows.mapInArrow(lambda b: _candidates(_groups(b, ["key", "part"]), pick), "a long, b long").distinct()


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their component, of buckets that hold more than one."""
    found = members.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    split = found.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    return found.join(split, "key")


def foreign_pairs(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """In pieces of each bucket: every node with the nearest ones of other components."""

    def pick(batch, nodes, begin):
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for rows in _alike(_pieces(begin), PIECE):
            rows = rows[(label[rows] != label[rows[:, :1]]).any(axis=1)]
            own = label[rows]
            d = nodes.apart(rows, rows, percent)
            d[own[:, :, None] == own[:, None]] = FAR
            for _ in range(NEAREST):
                best = d.argmin(axis=1)
                g, j = np.nonzero(d.min(axis=1) < FAR)
                i = best[g, j]
                yield rows[g, i], rows[g, j]
                d[g, i, j] = FAR

    part = F.pmod(F.xxhash64("cid", "key"), F.ceil(F.col("m") / PIECE))
    rows = _labelled(members, labels).select("key", part.alias("part"), "label", "cid", *_NODE)
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", "cid")
    return rows.mapInArrow(lambda b: _candidates(_groups(b, ["key", "part"]), pick), "a long, b long").distinct()


def crossing_pairs(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs whose nodes share a bucket and lie in different components, each once. Buckets
    are cut into tiles and tiles meet in twos, so that no task holds a bucket."""

    def pick(batch, nodes, begin):
        label, tile, slot = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "tile", "slot"))

        def crossing(i, j, upper):
            """Of nodes i and j of each group, those whose first common slot is that of the group."""
            tiles = tile[j]
            both = (tiles != tiles[:, :1]).any(axis=1)
            d = nodes.apart(i, j, percent)
            d[label[i][:, :, None] == label[j][:, None]] = FAR
            d[both[:, None, None] & (tile[i][:, :, None] == tiles[:, None])] = FAR
            g, x, y = np.nonzero((d < FAR) & upper)
            i, j = i[g, x], j[g, y]
            ok = _first_slots(nodes.sig[i][:, None], nodes.sig[j][:, None])[:, 0, 0] == slot[i]
            return i[ok], j[ok]

        for rows in _alike(begin, PIECE):
            yield crossing(rows, rows, np.triu(np.ones((rows.shape[1],) * 2, bool), 1))
        for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist()):
            if hi - lo <= PIECE:
                continue
            whole = np.arange(lo, hi)
            names, inverse, count = np.unique(label[lo:hi], return_inverse=True, return_counts=True)
            rest = inverse != count.argmax()
            lone = np.flatnonzero(rest)
            step = max(1, PAIRS // (hi - lo))
            for at in range(0, len(lone), step):
                i = lone[at : at + step]
                # Of two lone nodes, the pair is taken where the first comes first.
                yield crossing(lo + i[None], whole[None], ~rest | (i[:, None] < np.arange(hi - lo)))

    tiles = F.ceil(F.col("m") / TILE)
    rows = (
        _labelled(members, labels)
        .withColumn("tile", F.pmod(F.xxhash64("cid"), tiles))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
        .select("key", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "slot", "tile", "label", "cid", *_NODE)
        .repartition("key", "t", "u")
        .sortWithinPartitions("key", "t", "u", "cid")
    )
    return rows.mapInArrow(lambda b: _candidates(_groups(b, ["key", "t", "u"]), pick), "a long, b long")


def shared_counts(sets: DataFrame, total: int) -> DataFrame:
    """(cid, s): how many shingles of each set occur in another set, too.

    Shingles are compared by 32 bits within a shard; a clash can only make one look shared. Each task sorts those of
    about a thousand sets at a time, and shards grow in number with `total`, all shingles.
    """
    bits = max(0, int(total // SHARD_SHINGLES).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("shingles")]
                h = np.concatenate(found)
                owner = np.repeat(np.arange(len(found), dtype=np.uint16), [len(x) for x in found])
                order = np.argsort(h, kind="stable")
                h, owner = h[order], owner[order]
                cuts = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
                cuts = np.append(cuts, len(h))
                low = (h >> np.uint64(32 - bits)).astype(np.uint32)
                some = np.flatnonzero(np.diff(cuts)).tolist()
                cids = part.column("cid").to_numpy(zero_copy_only=False).tobytes()
                cols = [pa.array(some, pa.int32()), pa.array([cids] * len(some), pa.binary())]
                cols += [pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary()) for x in (low, owner)]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "cids", "keys", "owners"])

    def count(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("keys")]
        names, times = np.unique(np.concatenate(keys), return_counts=True)
        cids, shared = [], []
        for own, who, ids in zip(keys, table.column("owners"), table.column("cids")):
            more = times[np.searchsorted(names, own)] > 1
            ids = np.frombuffer(ids.as_buffer(), np.int64)
            cids.append(ids)
            shared.append(np.bincount(np.frombuffer(who.as_buffer(), np.uint16)[more], minlength=len(ids)))
        return pa.table({"cid": pa.array(np.concatenate(cids)), "s": pa.array(np.concatenate(shared).astype(np.int64))})

    dealt = sets.mapInArrow(deal, "shard int, cids binary, keys binary, owners binary")
    parts = dealt.repartition(1 << bits, "shard").groupBy("shard").applyInArrow(count, "cid long, s long")
    return parts.groupBy("cid").agg(F.sum("s").alias("s"))


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cid, shingles, bits): the whole set of each wanted node, as packed 64-bit numbers, and its parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                sets, begin = shingle_sets(batch.column("text"), k)
                own = [sets[a:b] for a, b in zip(begin[:-1], begin[1:])]
                cols = [pa.array([x.tobytes() for x in own], pa.binary()), pa.array([_parity(x) for x in own], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("cid"), *cols], ["cid", "shingles", "bits"])

    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rk"), F.col("text").cast("string"))
    # Rows of one key have one text, so any of them will do.
    rows = texts.join(wanted.select("rk", "cid"), "rk").withColumn("copy", F.row_number().over(Window.partitionBy("rk").orderBy("cid")))
    rows = rows.filter("copy = 1").select("cid", "text")
    return rows.mapInArrow(run, "cid long, shingles binary, bits binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                inter = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
                keep.append(100 * inter >= percent * (len(a) + len(b) - inter))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs(doc_id, text): (rk, doc_id, n_shingles, component_id, kept).

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of k-word shingles (A-Z in lower
    case; a text of 1 to k-1 words is one shingle). component_id is the smallest doc_id that can be reached.
    Defined results: a null, empty or blank text has no shingles, is its own component and is kept; a null doc_id is
    ignored when the smallest is taken, and such a row is kept only if its component has no id at all; repeated rows
    of one doc_id share their component and are all marked kept; other columns are ignored.
    """
    sketches = stored(sketch(docs, k), "sketch")
    nodes = stored(classes(sketches), "nodes")
    near = bucket_keys(nodes).select("cid").distinct().join(nodes, "cid").select("cid", "rk")
    sets = stored(full_sets(docs, near, k), "sets")
    # Most nodes that meet in a bucket share a passage only, and can be told by their own shingles. A second look
    # counts what is shared with nodes that are left.
    live, kept = nodes, sets
    for _ in range(2):
        total = kept.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
        live = live.drop("s").join(shared_counts(kept.select("cid", "shingles"), total // 8), "cid").filter(100 * F.col("s") >= percent * F.col("n"))
        live = stored(live, "live")
        kept = kept.join(live.select("cid"), "cid", "left_semi")
    live = live.drop("rk").join(sets.select("cid", "bits"), "cid")
    members = stored(bucket_keys(live).join(live, "cid"), "members")
    tested = stored(central_pairs(members, percent), "pairs")
    links = stored(confirmed(tested, sets, percent), "links")
    labels = connected(links)
    for step in (foreign_pairs, crossing_pairs):
        # Pairs are named from the smaller to the larger node everywhere.
        pairs = stored(step(members, labels, percent).join(tested, ["a", "b"], "left_anti"), "pairs")
        links = links.union(stored(confirmed(pairs, sets, percent), "links"))
        labels = connected(links)
        tested = tested.union(pairs)
    least = sketches.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("root"))
    final = least.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    tops = final.groupBy("label").agg(F.min("root").alias("component_id"))
    named = final.join(tops, "label").select("cid", "component_id")
    out = sketches.join(named, "cid", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "rk", "doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
