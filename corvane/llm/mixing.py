"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule is the point frac(i / golden ratio), mapped through the sources' cumulative weights; every
stretch of the schedule, however short, is then mixed as the whole is. The k-th slot of a source reads the k-th block
of its documents, which are shuffled once and repeated when the source is used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import WORD, numbered, pieces_for, rank_within, row_key, stored, sum_before

#: Tokens of a block at most, and blocks that each source is cut into at least (if it has the tokens).
BLOCK, LEAST_BLOCKS = 4096, 64
#: 2**40 / golden ratio, odd; points are whole numbers modulo 2**40.
GOLDEN, POINTS = 679_535_556_991, 1 << 40
#: Width, in slots, of the cells by which points meet sources.
CELL = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, rk, copy, source, size): repeated rows are told apart by `copy`."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("rk"),
        F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
    )
    same = Window.partitionBy("rk").orderBy(F.col("source").asc_nulls_last())
    return rows.withColumn("copy", F.row_number().over(same))


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """(source, sid, source_size, target): weights 1, 2, 3, 1, ... by the sources' order share all words; no target
    exceeds `most` times its source, and what is cut is shared again by weight until none does."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = numbered(each, [F.col("source").asc_nulls_last()], "sid").withColumn("w", F.pmod("sid", F.lit(3)) + 1)
    rows = stored(rows.withColumn("cap", F.col("source_size") * most), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0
    # Every round fixes at least one more source at its cap, most of them all at once.
    while True:
        full = F.col("w") * F.lit(share) > F.col("cap")
        capped, weight = rows.agg(F.sum(F.when(full, F.col("cap")).otherwise(0)), F.sum(F.when(~full, F.col("w")))).first()
        new = (total - (capped or 0)) / weight if weight else share
        if new <= share:
            break
        share = new
    target = F.least(F.col("w") * F.lit(share), F.col("cap").cast("double"))
    return rows.select("source", "sid", "source_size", target.alias("target"))


def _cells(begin: Column, end: Column, width: Column) -> Column:
    """The cells of `width` that [begin, end) touches."""
    return F.explode(F.sequence(F.floor(begin / width), F.floor((end - 1) / width)))


def slots(sources: DataFrame) -> DataFrame:
    """(slot, sid, rank, block, goal, source_size): the schedule, each slot with its rank within its source.

    A source of m blocks owns m of the S units that the points fall into. Gaps between the first n golden-ratio
    points are below 1.9 / n, so 2 * S points give every source its m slots; further ones are not used.
    """
    goal = F.round("target").cast("long")
    need = sources.withColumn("goal", goal).filter("goal > 0")
    need = need.withColumn("block", F.least(F.lit(BLOCK), F.ceil(F.col("goal") / LEAST_BLOCKS)))
    need = need.withColumn("blocks", F.ceil(F.col("goal") / F.col("block")))
    spread = pieces_for(need.count())
    own = stored(sum_before(need.withColumn("one", F.lit(1)), ["one"], [F.col("sid")], F.pmod("sid", F.lit(spread)), F.col("blocks"), "begin"), "need")
    total = own.agg(F.sum("blocks")).first()[0] or 0
    low, high = F.col("id").bitwiseAND(F.lit((1 << 20) - 1)), F.shiftright("id", 20)
    point = F.pmod(F.pmod(high * GOLDEN, F.lit(POINTS)) * (1 << 20) + low * GOLDEN, F.lit(POINTS))
    points = own.sparkSession.range(2 * total).select(F.col("id").alias("slot"), F.floor(point / POINTS * total).alias("unit"))
    units = own.withColumn("cell", _cells(F.col("begin"), F.col("begin") + F.col("blocks"), F.lit(CELL)))
    drawn = points.withColumn("cell", F.floor(F.col("unit") / CELL)).join(units, "cell").filter("unit >= begin and unit < begin + blocks")
    drawn = drawn.select("slot", "sid", "block", "blocks", "goal", "source_size")
    step = -(-2 * total // pieces_for(2 * total)) or 1
    ranked = rank_within(drawn, ["sid"], [F.col("slot")], F.floor(F.col("slot") / step), "rank")
    return ranked.filter("rank < blocks").drop("blocks")


def schedule(docs: DataFrame, sizes: DataFrame, sources: DataFrame, seed: int = 7) -> DataFrame:
    """(slot, epoch, doc_id, rk, copy, begin, end): the words of each document that each slot reads.

    `begin` and `end` count words of the document. Documents of a source are shuffled by a hash of their content.
    """
    own = sizes.filter("size > 0").alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    own = own.select("doc_id", "rk", "copy", "size", "sid", "target")
    spread = F.pmod(F.xxhash64("rk", "copy", F.lit(seed)), F.lit(pieces_for(sizes.count())))
    placed = sum_before(own, ["sid"], [F.xxhash64("rk", F.lit(seed)), F.col("rk"), F.col("copy")], spread, F.col("size"), "at")
    drawn = slots(sources)
    # A slot reads [rank * block, ...) of its source repeated for ever; cut where the source begins anew.
    reads = drawn.withColumn("lo", F.col("rank") * F.col("block"))
    reads = reads.withColumn("hi", F.least(F.col("lo") + F.col("block"), F.col("goal")))
    reads = reads.withColumn("epoch", _cells(F.col("lo"), F.col("hi"), F.col("source_size")))
    base = F.col("epoch") * F.col("source_size")
    reads = reads.select(
        "slot", "epoch", "sid", "block", F.greatest(F.col("lo") - base, F.lit(0)).alias("lo"), F.least(F.col("hi") - base, "source_size").alias("hi")
    )
    reads = reads.withColumn("cell", _cells(F.col("lo"), F.col("hi"), F.col("block"))).drop("block")
    block = F.least(F.lit(BLOCK), F.ceil(F.round("target").cast("long") / LEAST_BLOCKS))
    placed = placed.withColumn("block", block).filter("block > 0")
    placed = placed.withColumn("cell", _cells(F.col("at"), F.col("at") + F.col("size"), F.col("block")))
    edge = F.col("cell") * F.col("block")
    placed = placed.withColumn("from", F.greatest("at", edge)).withColumn("to", F.least(F.col("at") + F.col("size"), edge + F.col("block")))
    both = placed.join(reads, ["sid", "cell"])
    begin, end = F.greatest("from", "lo"), F.least("to", "hi")
    return both.filter(begin < end).select("slot", "epoch", "doc_id", "rk", "copy", (begin - F.col("at")).alias("begin"), (end - F.col("at")).alias("end"))


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per row of docs(doc_id, text, source): (doc_id, rk, copy, source, size, source_size, target, taken, first_slot,
    last_slot, reads), and the schedule that takes them. The slots say where in the mix the document's words stand;
    they are null if none is taken, and `reads` counts the stretches of it that slots read.

    Each source gives its target rounded to whole words, exactly. Defined results: a null text has size 0; a document
    or a source without words is never taken; a null source is a source of its own, last in order; repeated rows are
    documents of their own; an empty table gives no rows; other columns are ignored.
    """
    sizes = stored(sized(docs), "sizes")
    sources = stored(targets(sizes), "targets")
    read = schedule(docs, sizes, sources)
    taken = read.groupBy("rk", "copy").agg(
        F.sum(F.col("end") - F.col("begin")).alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"),
        F.count(F.lit(1)).alias("reads"),
    )
    own = sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    own = own.select("doc_id", "rk", "copy", "d.source", "size", "source_size", "target")
    return own.join(taken, ["rk", "copy"], "left").fillna(0, ["taken", "reads"]), read


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: each document once for every epoch that takes words of it, its text
    cut to those words (a whole text stays as it is) and n_chars counted anew."""
    _, read = mix(docs)
    # Within one epoch a document's words are taken from one stretch.
    parts = read.groupBy("rk", "copy", "epoch").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    keyed = docs.withColumn("__rk", row_key(F.col("doc_id"), F.col("text")))
    same = Window.partitionBy("__rk").orderBy(F.col("source").asc_nulls_last())
    keyed = keyed.withColumn("__copy", F.row_number().over(same))
    parts = parts.select(F.col("rk").alias("__rk"), F.col("copy").alias("__copy"), "begin", "end")
    rows = keyed.join(parts.withColumnRenamed("begin", "__begin").withColumnRenamed("end", "__end"), ["__rk", "__copy"])
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.slice(words, (F.col("__begin") + 1).cast("int"), (F.col("__end") - F.col("__begin")).cast("int")), " ")
    whole = F.col("__end") - F.col("__begin") == word_count(F.col("text"))
    rows = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
