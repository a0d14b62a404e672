"""Collocations by prefix-free parsing.

Every window of three words whose hash is 0 modulo EVERY is a trigger. A chunk goes from one trigger to the next, the
next one's window included, so neighbours overlap by three words and the cuts depend on the content alone: passages
that repeat give the same chunks wherever they stand. The different chunks with their frequencies are the dictionary.
A phrase of up to four words that starts before a chunk's end trigger lies in the chunk; it is counted there, with
the chunk's frequency, and nowhere else, so each occurrence counts once. Separators stand in a chunk as line ends,
which no phrase crosses.

Most phrases are rare. The dictionary is split into blocks, and before any phrase is sent as text, each block asks the
shards of a hash which of its phrases can be frequent: it sends a 32-bit name and a count (up to the support) for each
different one, and gets back the names whose counts reach the support. First words and pairs are asked for, then those
triples whose both pairs are frequent. Names that collide can only let a rare phrase through; what is left is counted
exactly, as text.

A null text is empty, a null language is `und`, repeated rows count again, texts without words or no documents give
no rows. Only `lang` and `text` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import _ODD, _ranges, mix, stored, text_bytes, text_slices, word_hashes, word_spans
from corvane.operators.ranking import first_per_key, top_n_per_group

LONGEST = 4
#: Words of a trigger, and of the overlap: a phrase that starts before a trigger ends within it.
WINDOW = LONGEST - 1
#: One window in so many is a trigger.
EVERY = 24
#: Words of a block, and words for which there is one shard.
BLOCK, SHARD = 1 << 20, 1 << 21

#: A-Z in lower case, separators as line ends, tabs as blanks.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 10
_FOLD[9] = 32
_FACTORS = [np.uint64(pow(_ODD, 2 * j + 3, 1 << 64)) for j in range(LONGEST)]


def _rolled(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place of `at` on."""
    total = np.zeros(len(at), np.uint64)
    for j in range(n):
        total += hashes[at + j] * _FACTORS[j]
    return mix(total + np.uint64(n))


def _texts(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte ranges as an Arrow text column."""
    sizes = ends - begins
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    data = raw[_ranges(begins, sizes)]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


def _breaks(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a line end stands between a word and the next one."""
    upto = np.concatenate([[0], np.cumsum(raw == 10)])
    following = np.concatenate([starts[1:], [len(raw)]])
    return upto[following] > upto[ends]


# ---- the dictionary ---------------------------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            raw, offsets = text_bytes(part.column("text"))
            raw = _FOLD[raw]
            starts, ends, first = word_spans(raw, offsets)
            if not len(starts):
                continue
            hashes = word_hashes(raw, starts, ends, lower=False)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            stop = first[1:][doc]
            where = np.arange(len(starts))
            trigger = where + WINDOW <= stop
            at = np.flatnonzero(trigger)
            trigger[at] = _rolled(hashes, at, WINDOW) % np.uint64(EVERY) == 0
            trigger[first[:-1][np.diff(first) > 0]] = True
            begin = np.flatnonzero(trigger)
            following = np.concatenate([begin[1:], [len(starts)]])
            last = following >= stop[begin]
            following = np.where(last, stop[begin], following)
            end = np.where(last, following, following + WINDOW)
            # The words again, each with one blank or line end behind it.
            sizes = ends - starts + 1
            upto = np.concatenate([[0], np.cumsum(sizes)])
            clean = np.append(raw, np.uint8(32))[_ranges(starts, sizes)]
            clean[upto[1:] - 1] = np.where(_breaks(raw, starts, ends), 10, 32)
            yield pa.RecordBatch.from_arrays([
                part.column("lang").cast(pa.large_string()).take(pa.array(doc[begin])),
                _texts(clean, upto[begin], upto[end] - 1),
                pa.array((following - begin).astype(np.int32)),
            ], ["lang", "chunk", "owned"])


def dictionary(docs: DataFrame) -> DataFrame:
    """(lang, chunk, owned, n): the different chunks; phrases are counted at a chunk's first `owned` words, n times."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_chunks, "lang string, chunk string, owned int")
    return found.groupBy("lang", "chunk", "owned").agg(F.count(F.lit(1)).alias("n"))


# ---- which phrases can be frequent ------------------------------------------------------------------------------


class Block:
    """The words of one block of chunks and what may be asked about them."""

    def __init__(self, table: pa.Table, shards: int) -> None:
        table = table.combine_chunks()
        text = table.column("chunk").combine_chunks() if table.num_rows else pa.array([], pa.large_string())
        self.raw, offsets = text_bytes(text)
        self.starts, self.ends, first = word_spans(self.raw, offsets)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.where = np.arange(len(self.starts))
        self.left = first[1:][row] - self.where
        self.owned = self.where - first[:-1][row] < table.column("owned").to_numpy()[row]
        self.times = table.column("n").to_numpy()[row] * self.owned
        langs = table.column("lang").combine_chunks().dictionary_encode()
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy()[row]
        own, at = text_bytes(self.langs)
        spans = [np.array(x, np.int64) for x in (at[:-1], at[1:])]
        self.hashes = word_hashes(self.raw, self.starts, self.ends, lower=False)
        self.salt = word_hashes(own, *spans, lower=False)[self.lang]
        self.open = ~_breaks(self.raw, self.starts, self.ends)
        self.shards = np.uint64(shards)

    def names(self, at: np.ndarray, n: int) -> np.ndarray:
        """Shard and name, in one number, of the n-word phrases at the places."""
        h = mix(_rolled(self.hashes, at, n) ^ self.salt[at])
        return ((h >> np.uint64(32)) % self.shards << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))

    def pairs(self) -> np.ndarray:
        return np.flatnonzero((self.left >= 2) & self.open)

    def longer(self, at: np.ndarray, n: int) -> np.ndarray:
        """Places of n-word phrases whose both parts of n-1 words are among the places `at`."""
        alive = np.zeros(len(self.where) + 1, bool)
        alive[at] = True
        return at[(self.left[at] >= n) & alive[at + 1]]

    def frequent(self, at: np.ndarray, n: int, known: np.ndarray) -> np.ndarray:
        """Those of the places whose names are known as frequent."""
        if not len(known):
            return at[:0]
        names = self.names(at, n)
        return at[known[np.minimum(np.searchsorted(known, names), len(known) - 1)] == names]


def _asked(block: int, names: np.ndarray, times: np.ndarray, support: int) -> pa.Table:
    """One row for each shard: the different names, sorted, and how often each occurs in the block."""
    order = np.argsort(names, kind="stable")
    names, times = names[order], times[order]
    begin = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.empty(0, np.int64)
    counts = np.minimum(np.add.reduceat(times, begin), support).astype(np.uint8) if len(begin) else np.empty(0, np.uint8)
    names = names[begin]
    shard = (names >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.empty(0, np.int64)
    ends = np.append(cuts[1:], len(shard))
    short = names.astype(np.uint32)
    return pa.table({
        "shard": pa.array(shard[cuts], pa.int64()), "block": pa.array(np.full(len(cuts), block), pa.int64()),
        "names": pa.array([short[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
        "counts": pa.array([counts[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
    })


def _answers(support: int):
    def answer(table: pa.Table) -> pa.Table:
        names = [np.frombuffer(x, np.uint32) for x in table.column("names").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()])
        shard = np.uint64(table.column("shard")[0].as_py()) << np.uint64(32)
        _, back = np.unique(np.concatenate(names), return_inverse=True)
        good = (np.bincount(back, weights=counts) >= support)[back]
        upto = np.concatenate([[0], np.cumsum([len(x) for x in names])])
        mine = [(x[good[a:b]].astype(np.uint64) | shard).tobytes() for x, a, b in zip(names, upto[:-1], upto[1:])]
        return pa.table({"block": table.column("block"), "names": pa.array(mine, pa.binary())})

    return answer


_ASK = "shard long, block long, names binary, counts binary"
_CHUNK = ["lang", "chunk", "owned", "n"]


def _known(table: pa.Table) -> np.ndarray:
    parts = [np.frombuffer(x, np.uint64) for x in table.column("names").to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def frequent_phrases(chunks: DataFrame, words: int, support: int) -> DataFrame:
    """(lang, phrase, words, f) of all words and phrases of up to four words that occur `support` times or more.

    `chunks` is a stored dictionary and `words` a count of its words, which sets how many blocks and shards there are.
    Blocks are rows grouped by a hash of their chunk; each is held by one task at a time.
    """
    if support > 255:
        raise ValueError("support is kept in one byte")
    shards = words // SHARD + 1
    blocked = chunks.withColumn("block", F.pmod(F.xxhash64("lang", "chunk", "owned"), F.lit(words // BLOCK + 1)))

    def ask_pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = Block(table, shards)
        one, two = np.flatnonzero(b.owned), b.pairs()
        names = np.concatenate([b.names(one, 1), b.names(two, 2)])
        return _asked(key[0].as_py(), names, np.concatenate([b.times[one], b.times[two]]), support)

    def ask_triples(key: tuple[pa.Scalar, ...], table: pa.Table, known: pa.Table) -> pa.Table:
        b, known = Block(table, shards), _known(known)
        three = b.longer(b.frequent(b.pairs(), 2, known), 3)
        return _asked(key[0].as_py(), b.names(three, 3), b.times[three], support)

    def counted(key: tuple[pa.Scalar, ...], table: pa.Table, known: pa.Table) -> pa.Table:
        b, known = Block(table, shards), _known(known)
        two = b.frequent(b.pairs(), 2, known)
        three = b.frequent(b.longer(two, 3), 3, known)
        places = [b.frequent(np.flatnonzero(b.owned), 1, known), two, three, b.longer(three, 4)]
        return pa.concat_tables([_phrases(b, places, n) for n in range(1, LONGEST + 1)])

    def answered(asked: DataFrame) -> DataFrame:
        return stored(asked.groupBy("shard").applyInArrow(_answers(support), "block long, names binary"), "answers")

    blocks = blocked.groupBy("block")
    pairs = answered(blocks.applyInArrow(ask_pairs, _ASK))
    triples = answered(blocks.cogroup(pairs.groupBy("block")).applyInArrow(ask_triples, _ASK))
    found = blocks.cogroup(pairs.unionByName(triples).groupBy("block")).applyInArrow(counted, "lang string, phrase string, words int, f long")
    total = found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return total.filter(F.col("f") >= support)


def _phrases(b: Block, places: list[np.ndarray], n: int) -> pa.Table:
    """The different n-word phrases at owned places, with their counts. They are told apart by whole texts: words are
    numbered, and a phrase is the number of its beginning and that of its last word."""
    at = places[n - 1][b.owned[places[n - 1]]]
    words = _texts(b.raw, b.starts, b.ends).dictionary_encode().indices.to_numpy().astype(np.int64)
    key = b.lang[at].astype(np.int64)
    for j in range(n):
        key = (np.unique(key, return_inverse=True)[1] if j else key) << 32 | words[at + j]
    _, some, back = np.unique(key, return_index=True, return_inverse=True)
    f = np.zeros(len(some), np.int64)
    np.add.at(f, back, b.times[at])
    some = at[some]
    lang = b.langs.cast(pa.large_string()).take(pa.array(b.lang[some]))
    return pa.table({
        "lang": lang.cast(pa.string()), "phrase": _texts(b.raw, b.starts[some], b.ends[some + n - 1]).cast(pa.string()),
        "words": pa.array(np.full(len(some), n, np.int32)), "f": pa.array(f),
    })


# ---- collocations -----------------------------------------------------------------------------------------------


def _joined(words: str, begin, n):
    return F.array_join(F.slice(words, begin, n), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of every phrase of two words or more, by its weakest cut."""
    phrases = frequent.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.select(
        "lang", "phrase", "words", "a", "k", _joined("w", F.lit(1), F.col("k")).alias("head"),
        _joined("w", F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"),
    )
    head = frequent.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tail = frequent.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    # Whole-number division of decimals is exact; long products could overflow.
    rated = cut.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).withColumn(
        "score", F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r)").cast("long")
    )
    ordered = rated.withColumn("by", F.col("score") * LONGEST + F.col("k"))
    return first_per_key(ordered, ["lang", "phrase"], F.col("by")).select("lang", "phrase", "words", "a", "l", "r", "score")


def covered(frequent: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of phrases inside a longer one that occurs at least `percent` as often."""
    longer = frequent.filter("words > 2").select("words", "lang", F.col("f").alias("whole"), F.split("phrase", " ").alias("w"))
    sizes = longer.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    parts = sizes.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
    best = parts.select("lang", _joined("w", F.col("i"), F.col("m")).alias("phrase"), "whole").groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    return frequent.join(best, ["lang", "phrase"]).filter(F.col("whole") * 100 >= F.col("f") * percent).select("lang", "phrase")


def collocations(docs: DataFrame, *, support: int = 30, percent: int = 80, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `most` phrases of two to four words."""
    chunks = stored(dictionary(docs), "chunks")
    words = F.sum(F.col("owned") * F.col("n"))
    size = chunks.agg(F.sum("owned")).first()[0] or 0
    sizes = chunks.groupBy("lang").agg(words.cast("long").alias("n"))
    frequent = stored(frequent_phrases(chunks, size, support), "phrases")
    left = scored(frequent).join(covered(frequent, percent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = top_n_per_group(left, ["lang"], order, most, salt=F.col("phrase"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
