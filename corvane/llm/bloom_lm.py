"""A bigram language model in a log-frequency Bloom filter.

An n-gram with count c enters the filter once for each level 1 .. 1 + floor(log2 c). Asking for level 1, 2, ... until
one is missing gives the quantised count back; a false positive can only raise it. The filter is built in shards by
the n-grams' hash, each from counts that tasks have summed beforehand. Shards grow in number with the text and are
stored, so every n-gram of the corpus is in the filter, and no task holds more than one shard. Texts are scored in
blocks, which ask the shards for the levels of their n-grams and for the exact counts of their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import mix, row_key, stored, text_bytes, text_slices, word_hashes, word_spans

#: Bits for each entry, and probes.
ENTRY_BITS, PROBES = 8, 5
#: Tokens counted together in a task, text bytes of a scoring block, and text bytes for each shard.
TASK_TOKENS, BLOCK_BYTES, SHARD_BYTES = 4 << 20, 8 << 20, 12 << 20
#: Weight of the lower order, and what is added to each word's count.
MU, ADD = 2.0, 0.1
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, each row closed by END, and where each row begins."""
    raw, offsets = text_bytes(column)
    starts, ends, first = word_spans(raw, offsets)
    return np.insert(word_hashes(raw, starts, ends), first[1:], END), first + np.arange(len(first))


def bigrams(flat: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every token with the one before it, and that one (START at a row's first)."""
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[begin[:-1]] = START
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + flat), before


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _key(h: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits that follow the shard's."""
    return ((h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _probes(key: np.ndarray, level: np.ndarray | int, size: np.ndarray | int) -> Iterator[np.ndarray]:
    x = mix(key.astype(np.uint64) + (np.asarray(level).astype(np.uint64) << np.uint64(32)))
    a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((a + np.uint64(i) * b) % np.asarray(size).astype(np.uint64)).astype(np.int64)


@dataclass
class LogFilter:
    """The filter's shards one after the other: their first bytes and sizes in bits."""

    shard_bits: int
    data: np.ndarray
    begin: np.ndarray
    size: np.ndarray

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The highest level of each hash that is not missing, 0 without any."""
        level = np.zeros(len(h), np.int64)
        shard, key = _shard(h, self.shard_bits), _key(h, self.shard_bits)
        live = np.flatnonzero(self.size[shard] > 0)
        while len(live):
            s = shard[live]
            for at in _probes(key[live], level[live] + 1, self.size[s]):
                hit = (self.data[self.begin[s] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                level[live[~hit]] |= 1 << 40
            live = live[level[live] < 1 << 40]
            level[live] += 1
        return level & ((1 << 40) - 1)

    def counts(self, h: np.ndarray) -> np.ndarray:
        """The quantised count of each hash."""
        return _middle(self.levels(h))


def _middle(level: np.ndarray) -> np.ndarray:
    """0, 1, 2.5, 5.5, ...: the middle of each level's counts."""
    return np.where(level > 0, (3.0 * 2.0 ** (level - 1.0) - 1) / 2, 0.0)


def _level(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c), and 0 of 0."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def _shard_filter(keys: np.ndarray, counts: np.ndarray, most_bits: int | None = None) -> tuple[bytes, int]:
    """Bits of one shard and how many; under a bound, levels below the least that fits are left out together."""
    level = _level(counts)
    least = 1
    while most_bits is not None and level[level >= least].sum() * ENTRY_BITS > most_bits:
        least += 1
    keys, level = keys[level >= least], level[level >= least]
    size = int(level.sum()) * ENTRY_BITS
    bits = np.zeros(-(-size // 8) * 8, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        for at in _probes(keys[level >= q], q, size):
            bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes(), size


def _text_rows(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("rk"), held.alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )


def count_shards(rows: DataFrame, bits: int) -> DataFrame:
    """(shard, kind, keys, counts): words (kind 0, 64-bit keys) and bigrams (kind 1, 32-bit keys) of training rows,
    summed in each task and packed by shard."""

    def emit(kind: int, h: np.ndarray) -> Iterator[tuple]:
        keys, counts = np.unique(h, return_counts=True)
        cuts = np.searchsorted(_shard(keys, bits), np.arange((1 << bits) + 1))
        packed = keys if kind == 0 else _key(keys, bits)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[s], cuts[s + 1]
            yield s, kind, packed[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def out() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                if held[kind]:
                    h = np.concatenate(held[kind])
                    held[kind].clear()
                    made = list(emit(kind, h))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                        ["shard", "kind", "keys", "counts"],
                    )

        for whole in batches:
            for batch in text_slices(whole, "text"):
                flat, begin = tokens(batch.column("text"))
                held[0].append(flat)
                held[1].append(bigrams(flat, begin)[0])
                if sum(map(len, held[0])) >= TASK_TOKENS:
                    yield from out()
        yield from out()

    train = rows.filter("not held_out").select("text")
    return train.mapInArrow(run, "shard int, kind int, keys binary, counts binary")


def _unpacked(table: pa.Table, column: str, kind) -> np.ndarray:
    found = [np.frombuffer(x.as_buffer(), kind) for x in table.column(column)]
    return np.concatenate(found) if found else np.empty(0, kind)


def train(rows: DataFrame, bits: int) -> DataFrame:
    """(shard, data, size, n, v): each shard's filter of all its bigrams, and its training tokens and different words."""

    def build(table: pa.Table) -> pa.Table:
        single, other = (table.filter(pc.equal(table.column("kind"), kind)) for kind in (0, 1))
        words, times = _summed(_unpacked(single, "keys", np.uint64), _unpacked(single, "counts", np.uint32).astype(np.int64))
        data, size = _shard_filter(*_summed(_unpacked(other, "keys", np.uint32), _unpacked(other, "counts", np.uint32).astype(np.int64)))
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "data": pa.array([data], pa.binary()),
            "size": pa.array([size], pa.int64()), "n": pa.array([int(times.sum())], pa.int64()), "v": pa.array([len(words)], pa.int64()),
        })

    shards = count_shards(rows, bits).repartition(1 << bits, "shard").groupBy("shard")
    return stored(shards.applyInArrow(build, "shard int, data binary, size long, n long, v long"), "filter")


def score(docs: DataFrame) -> DataFrame:
    """Scores every row of docs(doc_id, text) with a model of the rows whose crc32(doc_id as text) mod 10 is not 0.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. base_score sums
    log10((c + 0.1) / (N + 0.1 * (V + 1))) over the tokens, with exact counts. score is the model's: a bigram's
    quantised count, from the filter, is smoothed with the word's own probability, (c(h w) + MU * p(w)) / (c(h) + MU);
    c(h) and p(w) are from the words' exact counts, quantised likewise. Defined results:
    a null or empty text is its end token alone; a null doc_id is trained on; repeated rows are counted and scored
    each; without training rows every base token scores log10(1); an empty table gives no rows; other columns are
    ignored.
    """
    rows = _text_rows(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / SHARD_BYTES))))
    model = train(rows, bits)
    n, v = (x or 0 for x in model.agg(F.sum("n"), F.sum("v")).first())
    blocks = -(-size // BLOCK_BYTES) or 1
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("rk", F.lit(3)), F.lit(blocks)))
    blocked = blocked.repartition(int(max(1, min(blocks, 1 << 16))), "block")

    def words_of(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for whole in table.combine_chunks().to_batches():
            for batch in text_slices(whole, "text"):
                yield batch, *tokens(batch.column("text"))

    def cut(keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(_shard(keys, bits), np.arange((1 << bits) + 1))

    def ask(table: pa.Table) -> pa.Table:
        seen, new, met = [], [], []
        for batch, flat, begin in words_of(table):
            held = np.repeat(batch.column("held_out").to_numpy(zero_copy_only=False), np.diff(begin))
            seen.append(flat)
            new.append(~held)
            met.append(bigrams(flat, begin)[0])
        keys, inverse = np.unique(np.concatenate(seen), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate(new), len(keys)).astype(np.uint32)
        pairs = np.unique(np.concatenate(met))
        one, two = cut(keys), cut(pairs)
        some = np.flatnonzero(np.diff(one) + np.diff(two)).tolist()
        low = _key(pairs, bits)
        return pa.table({
            "shard": pa.array(some, pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(some), pa.int64()),
            "keys": pa.array([keys[one[s] : one[s + 1]].tobytes() for s in some], pa.binary()),
            "counts": pa.array([counts[one[s] : one[s + 1]].tobytes() for s in some], pa.binary()),
            "pairs": pa.array([low[two[s] : two[s + 1]].tobytes() for s in some], pa.binary()),
        })

    def answer(table: pa.Table, shard: pa.Table) -> pa.Table:
        keys, counts = _summed(_unpacked(table, "keys", np.uint64), _unpacked(table, "counts", np.uint32).astype(np.int64))
        found = [counts[np.searchsorted(keys, np.frombuffer(x.as_buffer(), np.uint64))].tobytes() for x in table.column("keys")]
        # Each shard is a filter of its own here, whose hashes begin with the key.
        lm = LogFilter(0, _unpacked(shard, "data", np.uint8), np.zeros(1, np.int64), np.array([*shard.column("size").to_pylist(), 0][:1], np.int64))
        upto = np.cumsum([0, *(len(x.as_buffer()) // 4 for x in table.column("pairs"))])
        met = lm.levels(_unpacked(table, "pairs", np.uint32).astype(np.uint64) << np.uint64(32)).astype(np.uint8)
        levels = [met[a:b].tobytes() for a, b in zip(upto[:-1], upto[1:])]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "found": pa.array(found, pa.binary()), "levels": pa.array(levels, pa.binary())})

    def rate(table: pa.Table, found: pa.Table) -> pa.Table:
        parts = [(batch, flat, begin, bigrams(flat, begin)[0]) for batch, flat, begin in words_of(table)]
        found = found.take(pc.sort_indices(found, [("shard", "ascending")]))
        exact, levels = _unpacked(found, "found", np.int64), _unpacked(found, "levels", np.uint8)
        keys, pairs = (np.unique(np.concatenate([x[i] for x in parts])) for i in (1, 3))
        quantised, closed = _middle(_level(exact)), np.searchsorted(keys, END)
        out = []
        for batch, flat, begin, pair in parts:
            at = begin[:-1]
            word = np.searchsorted(keys, flat)
            c, own = exact[word], quantised[word]
            context = np.empty_like(own)
            context[1:] = own[:-1]
            context[at] = quantised[closed]
            joint = np.minimum(_middle(levels[np.searchsorted(pairs, pair)]), context)
            p = (joint + MU * (own + ADD) / (n + ADD * (v + 1))) / (context + MU)
            out.append(pa.table({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": pa.array(np.diff(begin), pa.int64()),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), at), pa.int64()),
                "base": pa.array(np.add.reduceat(np.log10(c + 0.1), at)), "score": pa.array(np.add.reduceat(np.log10(p), at)),
            }))
        return pa.concat_tables(out)

    asked = blocked.groupBy("block").applyInArrow(ask, "shard int, block long, keys binary, counts binary, pairs binary")
    asked = asked.repartition(1 << bits, "shard").groupBy("shard")
    shards = model.select("shard", "data", "size").repartition(1 << bits, "shard").groupBy("shard")
    answers = asked.cogroup(shards).applyInArrow(answer, "block long, shard int, found binary, levels binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    rated = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(rate, schema)
    base = F.col("base") - F.col("n_tokens") * math.log10(n + 0.1 * (v + 1))
    return rated.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
