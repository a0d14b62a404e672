"""Sections to token-bounded chunks with stable ids, glossary and chunk statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators.jumps import reached
from corvane.operators.ranking import first_per_key, index_percentiles
from corvane.operators.sections import section_lines
from corvane.session import stored_table

# Budgets, markers and price table.
CHUNKER_VERSION = "struct-v2"
MERGE_BUDGET = 500
SPLIT_THRESHOLD = 900
WINDOW_SIZE = 450
WINDOW_OVERLAP = 60
RESPLIT_ORDINAL = 1000
LETTER_MARK = r"^\s*([⒜-⒵])"
NUMBER_MARK = r"^\s*([⑴-⒇])"
UPPER_MARK = r"^\s*\(([A-Z])\)"
ANNOTATION = r"^\s*\[(주|원주|부기|문|답)\]"
FRONT_RULE_ID = "CHG-2026"
EMBED_BATCH = 256
EMBED_PRICE_PER_1M = {"text-embedding-3-large": 0.13, "text-embedding-3-small": 0.02}
DEFAULT_EMBED_PRICE = 0.13

CHUNK_COLUMNS = (
    "id", "document_id", "chunk_index", "doc_type", "rule_chapter", "rule_no", "rule_title", "sub_item",
    "rule_id", "parent_id", "annotation", "term_no", "term_en", "term_ko", "page_start", "page_end",
    "breadcrumb", "content", "tokens",
)


def split_units(lines: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Adds unit_no, sub_item, suffix and annotation to section lines.

    Three marker levels (letter, number, upper-case); a higher level clears the lower ones. Within
    the rows since its last clearing a level is simply its last value.
    """

    def mark(pattern: str) -> Column:
        return F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))

    def upto(*extra: str) -> Window:
        return Window.partitionBy(*keys, *extra).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

    letter, number, upper = mark(LETTER_MARK), mark(NUMBER_MARK), mark(UPPER_MARK)
    marked = (
        lines.withColumn("_a", letter)
        .withColumn("_n", F.when(F.col("_a").isNull(), number))
        .withColumn("_u", F.when(F.col("_a").isNull() & F.col("_n").isNull(), upper))
        .withColumn("_mark", F.coalesce("_a", "_n", "_u").isNotNull())
        .withColumn("unit_no", F.sum(F.col("_mark").cast("int")).over(upto()))
        .withColumn("_ga", F.sum(F.col("_a").isNotNull().cast("int")).over(upto()))
        .withColumn("_gn", F.sum(F.coalesce("_a", "_n").isNotNull().cast("int")).over(upto()))
    )
    state = (
        marked.withColumn("_a", F.last("_a", ignorenulls=True).over(upto()))
        .withColumn("_n", F.last("_n", ignorenulls=True).over(upto("_ga")))
        .withColumn("_u", F.last("_u", ignorenulls=True).over(upto("_gn")))
    )
    whole = Window.partitionBy(*keys, "unit_no").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    note = F.when(~F.col("_mark"), mark(ANNOTATION))
    empty = F.lit("")

    def wrapped(c: Column) -> Column:
        return F.coalesce(F.concat(F.lit("("), c, F.lit(")")), empty)

    raw = F.concat(F.coalesce("_a", empty), F.coalesce("_n", empty), wrapped(F.col("_u")))
    suffix = F.concat(
        wrapped(X.decode_marker(F.col("_a"))), wrapped(X.decode_marker(F.col("_n"))), wrapped(F.col("_u"))
    )
    return (
        state.withColumn("sub_item", F.nullif(raw, empty))
        .withColumn("suffix", suffix)
        .withColumn("annotation", F.first(note, ignorenulls=True).over(whole))
        .drop("_a", "_n", "_u", "_mark", "_ga", "_gn")
    )


def merge_small(
    sections: DataFrame,
    *,
    doc: str = "doc_id",
    tokens: str = "tokens",
    budget: int = MERGE_BUDGET,
    threshold: int = SPLIT_THRESHOLD,
) -> DataFrame:
    """Adds merge_group: consecutive small sections of a chapter packed up to the budget.

    Greedy packing is a chain of jumps: a group that starts at a section ends before the first one whose end passes
    the budget, which a range window over running sums finds for every section at once, and the starts are what the
    chain from each run's first section stops at. Only numbers are moved; the sections meet their groups in one join.
    """
    order = Window.partitionBy(doc).orderBy("section_no")
    large = F.col(tokens) >= threshold
    restart = (
        large
        | F.coalesce(F.lag(large).over(order), F.lit(False))
        | F.coalesce(F.col("rule_no").endswith(".00"), F.lit(False))
        | (F.lag("rule_chapter").over(order) != F.col("rule_chapter"))
    )
    place = F.row_number().over(order)
    small = sections.select(
        doc, "section_no", F.col(tokens).cast("long").alias("_n"), place.alias("_at"),
        F.coalesce(restart, F.lit(False)).cast("int").alias("_restart"),
    ).withColumn("_run", F.sum("_restart").over(order))
    run = Window.partitionBy(doc, "_run")
    upto = run.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = small.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).withColumn("_last", F.max("_at").over(run))
    summed = summed.withColumn("_all", F.sum("_n").over(run))
    # Sections after the first of a run are below the threshold, so one of these starts past the budget if any does.
    past = run.orderBy("_before").rangeBetween(budget + 1, budget + max(threshold, 1))
    over = F.coalesce(F.min("_at").over(past), F.when(F.col("_all") - F.col("_before") > budget, F.col("_last") + 1))
    jump = F.when(over.isNotNull(), F.greatest(over - 1, F.col("_at") + 1))
    nodes = summed.withColumn("_to", jump).withColumn("_to", F.when(F.col("_to") <= F.col("_last"), F.col("_to")))
    nodes = stored_table(nodes.withColumn("_first", F.col("_at") == F.min("_at").over(run)).select(doc, "section_no", "_at", "_to", "_first"), "runs")
    starts = reached(nodes, [doc], "_at", "_to", "_first").withColumn("_start", F.lit(1))
    marked = nodes.join(starts, [doc, "_at"], "left")
    group = F.sum(F.coalesce("_start", F.lit(0))).over(Window.partitionBy(doc).orderBy("_at")) - 1
    groups = marked.select(doc, "section_no", group.cast("int").alias("merge_group"))
    return sections.join(groups, [doc, "section_no"])


def _joined(lines: Column) -> Column:
    return X.strip(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"))


def build_chunks(
    sections: DataFrame,
    *,
    doc: str = "doc_id",
    budget: int = MERGE_BUDGET,
    threshold: int = SPLIT_THRESHOLD,
    window: int = WINDOW_SIZE,
    overlap: int = WINDOW_OVERLAP,
) -> DataFrame:
    """All chunks of all documents; `document_id` keeps the input document key as text.

    Order inside a document: front, terms, rules. Rules under the threshold are merged, the others are
    cut at their sub-items, and units over the threshold into overlapping windows. Ids start from the
    `index_version` column of the sections, or from the document key when there is none.
    """
    if "index_version" not in sections.columns:
        sections = sections.withColumn("index_version", F.col(doc).cast("string"))
    sized = sections.withColumn("_text", _joined(F.col("lines"))).withColumn(
        "tokens", X.token_count(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    )
    attrs = ["rule_no", "rule_chapter", "rule_title", "chapter_title", "term_no", "term_en", "term_ko", "index_version"]
    none = F.lit(None).cast("string")

    simple = sized.where(F.col("doc_type") != "rule").select(
        doc, "doc_type", *attrs, "section_no",
        F.when(F.col("doc_type") == "front", 0).otherwise(1).alias("_kind"),
        F.lit(0).alias("_unit"), F.lit(0).alias("_piece"),
        F.when(F.col("doc_type") == "front", F.lit(FRONT_RULE_ID)).otherwise(F.concat(F.lit("DEF-"), "term_no")).alias("rule_id"),
        none.alias("sub_item"), none.alias("annotation"),
        "page_start", "page_end", F.col("_text").alias("body"), F.lit(0).alias("ordinal"),
    )

    rules = sized.where(F.col("doc_type") == "rule")
    small = merge_small(rules, doc=doc, budget=budget, threshold=threshold).where(F.col("tokens") < threshold)
    first = {c: F.min_by(c, "section_no").alias(c) for c in attrs}
    members = F.array_sort(F.collect_list(F.struct("section_no", "lines")))
    merged = (
        small.groupBy(doc, "merge_group")
        .agg(
            *first.values(),
            F.min("section_no").alias("section_no"),
            F.max_by("rule_no", "section_no").alias("_last_no"),
            F.count(F.lit(1)).alias("_n"),
            F.min("page_start").alias("page_start"),
            F.max("page_end").alias("page_end"),
            F.flatten(F.transform(members, lambda m: m["lines"])).alias("_lines"),
        )
        .select(
            doc, F.lit("rule").alias("doc_type"), *attrs, "section_no", F.lit(2).alias("_kind"),
            F.lit(0).alias("_unit"), F.lit(0).alias("_piece"),
            F.when(F.col("_n") > 1, F.concat_ws("~", "rule_no", "_last_no")).otherwise(F.col("rule_no")).alias("rule_id"),
            none.alias("sub_item"), none.alias("annotation"),
            "page_start", "page_end", _joined(F.col("_lines")).alias("body"), F.lit(0).alias("ordinal"),
        )
    )

    unit_lines = split_units(
        section_lines(rules.where(F.col("tokens") >= threshold), doc, "section_no", *attrs), [doc, "section_no"]
    )
    rows = F.array_sort(F.collect_list(F.struct("pos", "page", "line")))
    units = (
        unit_lines.groupBy(doc, "section_no", "unit_no", *attrs, "sub_item", "suffix", "annotation")
        .agg(F.min("page").alias("_p0"), F.max("page").alias("_p1"), _joined(rows).alias("_text"))
        .where(F.col("_text") != "")
    )
    fits = X.token_count(F.col("_text")) <= threshold
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("n_tokens"), F.col("_text").alias("piece")))
    pieces = units.withColumn("_fits", fits).select(
        "*", F.posexplode(F.when(F.col("_fits"), whole).otherwise(X.token_windows(F.col("_text"), window, overlap))).alias("_piece", "_w")
    )
    in_section = Window.partitionBy(doc, "section_no").orderBy("unit_no", "_piece")
    split = pieces.select(
        doc, F.lit("rule").alias("doc_type"), *attrs, "section_no", F.lit(2).alias("_kind"),
        F.col("unit_no").cast("int").alias("_unit"), "_piece",
        F.concat("rule_no", "suffix").alias("rule_id"), "sub_item", "annotation",
        F.col("_p0").alias("page_start"), F.when(F.col("_fits"), F.col("_p1")).otherwise(F.col("_p0")).alias("page_end"),
        F.col("_w.piece").alias("body"), (F.row_number().over(in_section) - 1).alias("ordinal"),
    )

    crumb = X.breadcrumb(
        *[F.col(c) for c in ("doc_type", "rule_chapter", "chapter_title", "rule_no", "rule_title", "sub_item", "term_no", "term_en", "term_ko")]
    )
    drafted = (
        simple.unionByName(merged)
        .unionByName(split)
        .withColumn("breadcrumb", crumb)
        .withColumn("content", X.content(F.col("breadcrumb"), F.col("body")))
        .withColumn("tokens", X.token_count(F.col("content")))
    )
    return _finish(drafted, doc, threshold, window, overlap)


def _finish(drafted: DataFrame, doc: str, threshold: int, window: int, overlap: int) -> DataFrame:
    """Re-split contents still over the threshold, then ids and running indexes."""
    over = F.col("tokens") > threshold
    keep = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("n_tokens"), F.col("body").alias("piece")))
    cut = drafted.withColumn("_over", over).select(
        "*", F.posexplode(F.when(F.col("_over"), X.token_windows(F.col("body"), window, overlap)).otherwise(keep)).alias("_re", "_w")
    )
    place = ["_kind", "section_no", "_unit", "_piece", "_re"]
    again = Window.partitionBy(doc, "_over", "rule_id").orderBy(*place)
    running = F.lit(RESPLIT_ORDINAL - 1) + F.row_number().over(again)
    index = Window.partitionBy(doc).orderBy(*place)
    parent = F.when((F.col("doc_type") == "rule") & F.col("sub_item").isNotNull(), F.col("rule_no"))
    done = (
        cut.withColumn("ordinal", F.when(F.col("_over"), running).otherwise(F.col("ordinal")))
        .withColumn("content", F.when(F.col("_over"), X.content(F.col("breadcrumb"), F.col("_w.piece"))).otherwise(F.col("content")))
        .withColumn("tokens", F.when(F.col("_over"), X.token_count(F.col("content"))).otherwise(F.col("tokens")))
        .withColumn("chunk_index", F.row_number().over(index) - 1)
        .withColumn("id", X.chunk_id(F.col("index_version"), F.col("rule_id"), F.col("ordinal")))
        .withColumn("parent_id", parent)
        .withColumn("document_id", F.col(doc).cast("string"))
    )
    return done.select(*CHUNK_COLUMNS)


def renumber(chunks: DataFrame, order: list[str], *, doc: str = "document_id") -> DataFrame:
    """chunk_index 0..n-1 per document."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1)


def window_chunks(docs: DataFrame, *keys: str, text: str = "text", size: int = WINDOW_SIZE, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """Fixed overlapping token windows of whole texts; made inside the row, nothing is shuffled."""
    return docs.select(*keys, F.posexplode(X.token_windows(F.col(text), size, overlap)).alias("piece_no", "_w")).select(
        *keys, "piece_no", "_w.start", "_w.n_tokens", F.col("_w.piece").alias("piece")
    )


def chunk_stats(chunks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Count, largest, index-picked p50 and p90 of tokens, and chapter-crossing rule ids."""
    keys = keys or []
    total = F.col("total")
    picks = index_percentiles(
        chunks, keys, "tokens",
        {"p50": F.floor(total / 2), "p90": F.floor(total * 0.9), "max_tokens": total - 1},
    ).withColumnRenamed("total", "chunks")
    ends = F.split("rule_id", "~")
    crossing = (F.col("doc_type") == "rule") & (F.size(ends) > 1) & (
        F.substring(ends[0], 1, 1) != F.substring(ends[1], 1, 1)
    )
    crossed = chunks.groupBy(*keys).agg(
        F.count_if(crossing).alias("chapter_crossing"),
        *[F.count_if(F.col("doc_type") == t).alias(f"{t}_chunks") for t in ("rule", "term", "front")],
    )
    if keys:
        return picks.join(crossed, keys)
    return picks.withColumn("_x", crossed.select(F.struct(*crossed.columns)).scalar()).select(*picks.columns, "_x.*")


def build_glossary(chunks: DataFrame) -> DataFrame:
    """One entry per term number, from its first chunk, with sorted distinct aliases."""
    terms = chunks.where((F.col("doc_type") == "term") & (F.coalesce("term_en", F.lit("")) != ""))
    first = first_per_key(terms, ["document_id", "term_no"], F.col("chunk_index"))
    first = first.select("document_id", "term_no", "term_en", "term_ko", "rule_id", F.col("page_start").alias("page"))
    ko = F.coalesce("term_ko", F.lit(""))
    names = F.concat(F.array("term_en", X.title_case(F.col("term_en")), ko), F.split(ko, "·"))
    return first.withColumn("aliases", F.array_sort(F.array_distinct(F.filter(names, lambda a: a != ""))))


def ingest_cost(chunks: DataFrame, model: str, keys: list[str] | None = None) -> DataFrame:
    price = EMBED_PRICE_PER_1M.get(model, DEFAULT_EMBED_PRICE)
    n = F.count(F.lit(1))
    return chunks.groupBy(*(keys or [])).agg(
        n.alias("chunks"),
        F.sum("tokens").alias("tokens"),
        F.ceil(n / EMBED_BATCH).alias("batches"),
        F.round(F.sum("tokens") / 1e6 * price, 6).alias("cost_usd"),
    )


def page_span(lines: DataFrame, *keys: str) -> DataFrame:
    return lines.groupBy(*keys).agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"))
