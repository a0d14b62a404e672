"""Lines to sections: body start, accepted headers, rule and term sections, parse statistics.

All windows are keyed by document (or a finer key), so one exchange on the document serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import strip
from corvane.operators.ranking import top_n_per_group

# Structural patterns of the rule book and title limits.
BODY_ANCHOR = r"^1\.00 경기의 목적"
RULE_HEADER = r"^(\d)\.(\d{2}) (\S.*)$"
TERMS_TITLE = r"^<용어의 정의>"
APPENDIX = r"^<(?!용어의 정의)[^>]+>"
TERM_HEADER = r"^\s*(\d{1,3})\.\s*([A-Z][A-Za-z \-'’`/&.]+?)\s*\(([^)]+)\)\s*$"
CHANGE_SUMMARY = r"2026.*변경"
CHANGE_SUMMARY_TITLE = "2026년 공식야구규칙 변경 요약사항"
FRONT_PAGE = 7
TITLE_BAD_TAIL = r"(니다|한다|된다|이다|는다|있다|없다)$"
TITLE_MAX_CHARS = 25

ORDER = ("page_no", "line_no")


def accepted_title(candidate: Column) -> Column:
    """The stripped title, or null when it reads like a sentence."""
    t = strip(candidate)
    bad = (t == "") | (F.length(t) > TITLE_MAX_CHARS) | t.rlike(r"[.,]$") | t.rlike(TITLE_BAD_TAIL)
    return F.when(~bad, t)


def find_body_start(lines: DataFrame, anchor: str = BODY_ANCHOR, doc: str = "doc_id") -> DataFrame:
    """Second page with the anchor, else the first; a document without one is absent."""
    pages = lines.where(F.col("line").rlike(anchor)).select(doc, "page_no").distinct()
    two = top_n_per_group(pages, [doc], [F.col("page_no")], 2)
    return two.groupBy(doc).agg(F.max("page_no").alias("body_start"))


def find_terms_start(lines: DataFrame, title: str = TERMS_TITLE, doc: str = "doc_id") -> DataFrame:
    return lines.where(F.col("line").rlike(title)).groupBy(doc).agg(F.min("page_no").alias("terms_start"))


def header_value(line: Column, pattern: str = RULE_HEADER) -> Column:
    """Chapter and number as one integer (5.09 is 509), null for other lines."""
    digits = F.concat(F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2))
    return F.when(line.rlike(pattern), digits.cast("int"))


def accept_headers(lines: DataFrame, pattern: str = RULE_HEADER, doc: str = "doc_id") -> DataFrame:
    """Adds `value` and `accepted`.

    A header is accepted when no earlier candidate is larger. A rejected candidate lies below the
    running maximum already, so the maximum over all candidates equals the one over accepted ones.
    """
    earlier = Window.partitionBy(doc).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    valued = lines.withColumn("value", header_value(F.col("line"), pattern))
    top = F.coalesce(F.max("value").over(earlier), F.lit(-1))
    return valued.withColumn("accepted", F.coalesce(F.col("value") >= top, F.lit(False)))


def sectionize(
    lines: DataFrame,
    *,
    doc: str = "doc_id",
    body_anchor: str = BODY_ANCHOR,
    terms_title: str = TERMS_TITLE,
    appendix: str = APPENDIX,
) -> DataFrame:
    """One row per rule and term section with its lines as an ordered array.

    Columns: doc, doc_type, section_no, rule_no, rule_chapter, rule_title, chapter_title, term_no,
    term_en, term_ko, header_page, lines (page, line), page_start, page_end.
    """
    page, line = F.col("page_no"), F.col("line")
    whole = Window.partitionBy(doc)
    first = F.min(F.when(line.rlike(body_anchor), page)).over(whole)
    second = F.min(F.when(line.rlike(body_anchor) & (page > F.col("_first")), page)).over(whole)
    bounded = (
        lines.withColumn("_first", first)
        .withColumn("_body", F.coalesce(second, "_first"))
        .withColumn("_terms", F.min(F.when(line.rlike(terms_title), page)).over(whole))
    )
    zone = F.when((page >= F.col("_body")) & (page < F.col("_terms")), F.lit("rule")).when(
        page >= F.col("_terms"), F.lit("term")
    )
    zoned = bounded.withColumn("doc_type", F.when(F.col("_body").isNotNull(), zone)).where(F.col("doc_type").isNotNull())

    upto = Window.partitionBy(doc, "doc_type").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(doc, "doc_type").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    is_rule, is_term = F.col("doc_type") == "rule", F.col("doc_type") == "term"

    flagged = (
        zoned.withColumn("_stop", F.max(is_term & line.rlike(appendix)).over(upto))
        .where(~F.col("_stop"))
        .withColumn("_value", F.when(is_rule, header_value(line)))
        .withColumn("_rule", F.coalesce(F.col("_value") >= F.coalesce(F.max("_value").over(before), F.lit(-1)), F.lit(False)))
        .withColumn("_term", is_term & line.rlike(TERM_HEADER))
        .withColumn("_start", F.col("_rule") | F.col("_term"))
    )
    number = F.concat_ws(".", F.regexp_extract(line, RULE_HEADER, 1), F.regexp_extract(line, RULE_HEADER, 2))
    rest = F.regexp_extract(line, RULE_HEADER, 3)
    head = F.struct(
        F.when(F.col("_rule"), number).alias("rule_no"),
        F.when(F.col("_rule"), F.concat(F.regexp_extract(line, RULE_HEADER, 1), F.lit(".00"))).alias("rule_chapter"),
        F.when(F.col("_rule"), accepted_title(rest)).alias("rule_title"),
        F.when(F.col("_term"), F.regexp_extract(line, TERM_HEADER, 1).try_cast("int")).alias("term_no"),
        F.when(F.col("_term"), strip(F.regexp_extract(line, TERM_HEADER, 2))).alias("term_en"),
        F.when(F.col("_term"), strip(F.regexp_extract(line, TERM_HEADER, 3))).alias("term_ko"),
        page.alias("header_page"),
    )
    islands = (
        flagged.withColumn("section_no", F.sum(F.col("_start").cast("int")).over(upto))
        .where(F.col("section_no") > 0)
        .withColumn("_head", F.when(F.col("_start"), head))
    )
    kept = (
        F.when(F.col("_rule"), F.when(F.col("_head.rule_title").isNull(), strip(rest)))
        .when(F.col("_term"), F.lit(None))
        .when(strip(line) != "", line)
    )
    body = F.struct(page.alias("page"), F.col("line_no"), F.col("_kept").alias("line"))
    grouped = (
        islands.withColumn("_kept", F.nullif(kept, F.lit("")))
        .groupBy(doc, "doc_type", "section_no")
        .agg(
            F.max("_head").alias("_head"),
            F.array_sort(F.collect_list(F.when(F.col("_kept").isNotNull(), body))).alias("_lines"),
        )
        .select(doc, "doc_type", "section_no", "_head.*", "_lines")
    )
    label = F.concat_ws(" ", "rule_no", "rule_title")
    filled = F.when((F.col("doc_type") == "rule") & (F.size("_lines") == 0),
                    F.array(F.struct(F.col("header_page").alias("page"), label.alias("line")))).otherwise(
        F.transform("_lines", lambda x: F.struct(x["page"].alias("page"), x["line"].alias("line")))
    )
    return (
        attach_chapter_title(grouped, doc=doc)
        .withColumn("lines", filled)
        .drop("_lines")
        .where(F.size("lines") > 0)
        .withColumn("page_start", F.col("lines")[0]["page"])
        .withColumn("page_end", F.element_at("lines", -1)["page"])
    )


def attach_chapter_title(sections: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """Title of the last titled `x.00` header of the same chapter."""
    own = F.when(F.col("rule_no").endswith(".00"), F.col("rule_title"))
    chapter = Window.partitionBy(doc, "doc_type", "rule_chapter").orderBy("section_no").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    title = F.last(own, ignorenulls=True).over(chapter)
    return sections.withColumn("chapter_title", F.when(F.col("rule_chapter").isNotNull(), title))


def section_lines(sections: DataFrame, *keys: str) -> DataFrame:
    """Sections back to one row per line, ordered by `pos`."""
    keep = keys or tuple(c for c in sections.columns if c != "lines")
    return sections.select(*keep, F.posexplode("lines").alias("pos", "_l")).select(
        *keep, "pos", F.col("_l.page").alias("page"), F.col("_l.line").alias("line")
    )


def front_lines(cells: DataFrame, *keys: str) -> DataFrame:
    """Change-table rows (label, before, after) as `label: before → after` lines."""

    def clean(name: str) -> Column:
        return strip(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), "\n", " "))

    label, before, after = clean("label"), clean("before"), clean("after")
    text = (
        F.when(before.isin("-", ""), F.concat(label, F.lit(": "), after))
        .when(after.isin("-", ""), F.concat(label, F.lit(": "), before))
        .otherwise(F.concat(label, F.lit(": "), before, F.lit(" → "), after))
    )
    return cells.where(label != "").select(*keys, text.alias("line"))


def front_sections(
    lines: DataFrame, cells: DataFrame | None = None, *, doc: str = "doc_id", front_page: int = FRONT_PAGE
) -> DataFrame:
    """The change-summary page as one section: its table when given, else its own non-blank lines."""
    own = lines.where((F.col("page_no") == front_page) & (strip(F.col("line")) != ""))
    flagged = lines.where((F.col("page_no") == front_page) & F.col("line").rlike(CHANGE_SUMMARY)).select(doc).distinct()
    plain = own.join(flagged, doc, "left_semi").groupBy(doc).agg(
        F.array_sort(F.collect_list(F.struct("line_no", F.struct(F.col("page_no").alias("page"), "line").alias("v")))).alias("_p")
    ).select(doc, F.transform("_p", lambda x: x["v"]).alias("_plain"))
    out = plain
    if cells is not None:
        rows = front_lines(cells, doc, "row_no").groupBy(doc).agg(
            F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("_r")
        )
        title = F.struct(F.lit(front_page).alias("page"), F.lit(CHANGE_SUMMARY_TITLE).alias("line"))
        table = rows.select(
            doc,
            F.concat(
                F.array(title),
                F.transform("_r", lambda x: F.struct(F.lit(front_page).alias("page"), x["line"].alias("line"))),
            ).alias("_table"),
        )
        out = plain.join(table, doc, "left")
    lines_col = F.coalesce("_table", "_plain") if cells is not None else F.col("_plain")
    null = F.lit(None)
    return out.select(
        doc,
        F.lit("front").alias("doc_type"),
        F.lit(0).cast("bigint").alias("section_no"),
        *[null.cast("string").alias(c) for c in ("rule_no", "rule_chapter", "rule_title")],
        null.cast("int").alias("term_no"),
        *[null.cast("string").alias(c) for c in ("term_en", "term_ko")],
        F.lit(front_page).alias("header_page"),
        null.cast("string").alias("chapter_title"),
        lines_col.alias("lines"),
        F.lit(front_page).alias("page_start"),
        F.lit(front_page).alias("page_end"),
    )


def term_gaps(sections: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """Terms whose number differs from their ordinal in document order."""
    order = Window.partitionBy(doc).orderBy("section_no")
    terms = sections.where(F.col("doc_type") == "term")
    return (
        terms.withColumn("expected", F.row_number().over(order))
        .where(F.col("term_no") != F.col("expected"))
        .select(doc, "term_no", "expected")
    )


def parse_stats(lines: DataFrame, sections: DataFrame, *, doc: str = "doc_id", anchor: str = BODY_ANCHOR) -> DataFrame:
    """One row per document: pages, stripped counters, body start, nearly empty pages, sections, order check and terms
    out of order.

    The lines are read once: all line counters, the anchor and the kept text of a page come from one grouping by page,
    whose rows are then summed by document. The sections are read once, too.
    """
    from corvane.sources.lines import MIN_PAGE_CHARS, noise_class

    kind = noise_class(F.col("line"))
    kept = F.array_sort(F.collect_list(F.when(kind.isNull(), F.struct("line_no", "line"))))
    pages = lines.groupBy(doc, "page_no").agg(
        F.count_if(kind == "marker").alias("_m"), F.count_if(kind == "header").alias("_h"), F.count_if(kind.isNull()).alias("_k"),
        F.bool_or(kind.isNull() & F.col("line").rlike(anchor)).alias("_a"),
        F.length(strip(F.array_join(F.transform(kept, lambda x: x["line"]), ""))).alias("_chars"),
    )
    starts = F.slice(F.array_sort(F.collect_list(F.when(F.col("_a"), F.col("page_no")))), 1, 2)
    per = pages.groupBy(doc).agg(
        F.count(F.lit(1)).alias("pages"), F.element_at(F.when(F.size(starts) > 0, starts), -1).alias("body_start"),
        F.sum("_m").alias("markers_stripped"), F.sum("_h").alias("running_headers_stripped"), F.sum("_k").alias("lines_kept"),
        F.array_sort(F.collect_list(F.when(F.col("_chars") < MIN_PAGE_CHARS, F.col("page_no")))).alias("skipped_pages"),
    )
    value = F.regexp_replace("rule_no", r"\.", "").cast("int")
    order = Window.partitionBy(doc, "doc_type").orderBy("section_no")
    earlier = F.max("_v").over(order.rowsBetween(Window.unboundedPreceding, -1))
    checked = sections.select(doc, "doc_type", "section_no", "term_no", value.alias("_v")).withColumn(
        "_ok", F.coalesce(F.col("_v") >= earlier, F.lit(True))
    )
    off = F.when((F.col("doc_type") == "term") & (F.col("term_no") != F.row_number().over(order)), F.struct("section_no", "term_no"))
    counts = checked.withColumn("_gap", off).groupBy(doc).agg(
        F.count_if(F.col("doc_type") == "rule").alias("rules"),
        F.count_if(F.col("doc_type") == "term").alias("terms"),
        F.bool_and("_ok").alias("monotonic"),
        F.transform(F.array_sort(F.collect_list("_gap")), lambda g: g["term_no"]).alias("term_gaps"),
    )
    joined = per.join(counts, doc, "left").fillna(0, ["rules", "terms"]).fillna({"monotonic": True})
    return joined.withColumn("term_gaps", F.coalesce("term_gaps", F.array().cast("array<int>")))
