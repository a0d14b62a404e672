"""Page text to lines: explode, noise classes, short pages, merged pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import strip

# Shapes of page markers and running headers.
PAGE_MARKER = r"^\s*[․·.]\s*\d+\s*[․·.]\s*$"
HEADER_NUMBER_FIRST = r"^\d\.\d{2}(~\d\.\d{2})?\s{2,}\S"
HEADER_TITLE_FIRST = r"^\S.*\s{2,}\d\.\d{2}(~\d\.\d{2})?\s*$"
HEADER_TERMS = r"^(?:\d+(?:~\d+)?\s{2,}용어의 정의|용어의 정의\s{2,}\d+(?:~\d+)?)\s*$"
MIN_PAGE_CHARS = 50


def noise_class(line: Column) -> Column:
    """`marker`, `header` or null; the marker test comes first."""
    header = line.rlike(HEADER_NUMBER_FIRST) | line.rlike(HEADER_TITLE_FIRST) | line.rlike(HEADER_TERMS)
    return F.when(line.rlike(PAGE_MARKER), F.lit("marker")).when(header, F.lit("header"))


def explode_lines(pages: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row per line, in order, blank lines kept."""
    return pages.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def strip_noise(lines: DataFrame) -> DataFrame:
    """Lines that are neither page markers nor running headers."""
    return lines.where(noise_class(F.col("line")).isNull())


def noise_counts(lines: DataFrame, *keys: str) -> DataFrame:
    kind = noise_class(F.col("line"))
    return lines.groupBy(*keys).agg(
        F.count_if(kind == "marker").alias("markers_stripped"),
        F.count_if(kind == "header").alias("running_headers_stripped"),
        F.count_if(kind.isNull()).alias("lines_kept"),
    )


def short_pages(pages: DataFrame, *keys: str, text: str = "text", min_chars: int = MIN_PAGE_CHARS) -> DataFrame:
    """Pages whose kept text is nearly empty; decided inside the row, so nothing is shuffled."""
    kept = F.filter(F.split(F.col(text), "\n"), lambda line: noise_class(line).isNull())
    return pages.select(*keys, F.length(strip(F.array_join(kept, ""))).alias("kept_chars")).where(
        F.col("kept_chars") < min_chars
    )


def squeeze(text: Column) -> Column:
    """Newlines to blanks, then runs of blanks and of dots to one."""
    flat = F.regexp_replace(text, "\n", " ")
    return F.regexp_replace(F.regexp_replace(flat, " {2,}", " "), r"\.{2,}", ".")


def merge_pages(pages: DataFrame, *keys: str, order: str = "page_no", text: str = "text") -> DataFrame:
    """One text per file. A file is one string here, so a group is bounded by one row's size."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("text"))))
    joined = F.array_join(F.transform(ordered, lambda p: F.concat(p["text"], F.lit(" "))), "")
    return pages.groupBy(*keys).agg(squeeze(joined).alias("page_content"))
