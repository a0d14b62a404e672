"""Text columns: tokens, rule numbers, identifiers, breadcrumbs, snippets."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and formats results must agree on.
RULE_NO = r"(?<![\d.])([1-9]\.\d{2})(?![\d.])"
TERM_EN = r"\b([A-Z][A-Z'’`\-]{2,}(?:\s+(?:or\s+)?[A-Z][A-Z'’`\-]{2,})*)\b"
CIRCLED = "[⒜-⒵⑴-⒇]"
TOKEN = r"[\p{L}\p{N}]{2,}|[\p{IsLatin}\p{N}\p{IsHan}]"
TOKEN_WITH_TAIL = r"[\p{L}\p{N}]+[^\p{L}\p{N}]*"
FRONT_BREADCRUMB = "[2026년 공식야구규칙 변경 요약]"
TERM_BREADCRUMB_HEAD = "[용어의 정의]"
DOCUMENT_ID_PREFIX = "rulebook-"
CIRCLED_LETTER_BASE = 0x249C
CIRCLED_NUMBER_BASE = 0x2474


# Characters the compatibility form leaves alone and never joins with a neighbour.
STABLE = r"^[\x00-\x7F¡§«°·»¿À-ıĴ-ľŁ-ňŊ-žА-я‐–—‘’“”가-힣一-鿿]*$"


@F.pandas_udf(T.StringType())
def _normalized(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None else unicodedata.normalize("NFKC", s))


def nfkc(text: Column) -> Column:
    """Unicode compatibility form. Spark has no built-in for it, so only texts it can change leave the JVM. A text of
    as many octets as characters is ASCII; of the others, only what is not ASCII is looked at."""
    beyond = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    stable = (F.octet_length(text) == F.length(text)) | beyond.rlike(STABLE)
    return F.coalesce(_normalized(F.when(~stable, text)), text)


def rule_numbers(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RULE_NO), F.lit(1))


def tokens(text: Column, *, with_rule_numbers: bool = True) -> Column:
    """Lower-cased word tokens; one-character tokens only when Latin, digit or Han."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.concat(words, rule_numbers(text)) if with_rule_numbers else words


def token_count(text: Column) -> Column:
    return F.size(tokens(text, with_rule_numbers=False))


def decode_marker(marker: Column) -> Column:
    """A circled letter or number as its plain letter or number."""
    code = F.ascii(marker)
    letter = F.substring(
        F.lit("abcdefghijklmnopqrstuvwxyz"), code - F.lit(CIRCLED_LETTER_BASE - 1), F.lit(1)
    )
    number = (code - F.lit(CIRCLED_NUMBER_BASE - 1)).cast("string")
    return F.when(code >= CIRCLED_LETTER_BASE, letter).otherwise(number)


def normalize_rule_id(text: Column) -> Column:
    """Rule number followed by its sub-items in plain brackets, each once."""
    raw = F.trim(text)
    split_at = "(?s)^.*?" + RULE_NO + "(.*)$"
    number = F.regexp_extract(raw, split_at, 1)
    tail = F.regexp_extract(raw, split_at, 2)
    circled = F.regexp_extract_all(tail, F.lit("(" + CIRCLED + ")"), F.lit(1))
    bracketed = F.regexp_extract_all(tail, F.lit(r"\(\s*([a-zA-Z0-9]{1,2})\s*\)"), F.lit(1))
    parts = F.array_distinct(F.concat(F.transform(circled, decode_marker), bracketed))
    suffix = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("("), p, F.lit(")"))), "")
    return F.when(number == "", raw).otherwise(F.concat(number, suffix))


def chunk_id(index_version: Column, rule_id: Column, ordinal: Column) -> Column:
    return F.sha1(F.concat_ws("|", index_version, rule_id, ordinal.cast("string")))


def index_version(sha256: Column, chunker: str, model: str, dims: int) -> Column:
    return F.concat_ws(":", F.substring(sha256, 1, 12), F.lit(chunker), F.lit(model), F.lit(str(dims)))


def document_id(version: Column) -> Column:
    return F.concat(F.lit(DOCUMENT_ID_PREFIX), F.substring(F.sha1(version), 1, 16))


def breadcrumb(
    doc_type: Column,
    chapter: Column,
    chapter_title: Column,
    rule_no: Column,
    rule_title: Column,
    sub_item: Column,
    term_no: Column,
    term_en: Column,
    term_ko: Column,
) -> Column:
    head = F.concat(
        F.lit("["),
        F.coalesce(chapter, F.lit("")),
        F.lit(" "),
        F.coalesce(chapter_title, F.lit("")),
        F.lit("]"),
    )
    full = [F.nullif(c, F.lit("")) for c in (rule_no, rule_title, sub_item)]
    rule = F.concat_ws(" ", F.regexp_replace(head, "  ", " "), *full)
    term = F.concat(
        F.lit(TERM_BREADCRUMB_HEAD + " "),
        term_no.cast("string"),
        F.lit(". "),
        term_en,
        F.lit(" ("),
        term_ko,
        F.lit(")"),
    )
    return (
        F.when(doc_type == "term", term)
        .when(doc_type == "front", F.lit(FRONT_BREADCRUMB))
        .otherwise(rule)
    )


def content(crumb: Column, body: Column) -> Column:
    return F.when(F.coalesce(body, F.lit("")) == "", crumb).otherwise(F.concat(crumb, F.lit("\n"), body))


def body(text: Column) -> Column:
    """Everything after the first newline, or all of it when there is none."""
    at = F.instr(text, "\n")
    return F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def snippet(text: Column, limit: int = 160) -> Column:
    return F.substring(F.regexp_replace(strip(body(text)), "\n", " "), 1, limit)


def clean_text(text: Column) -> Column:
    """Leading markdown marks removed, blanks collapsed, `<` and `$` escaped."""
    lead = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"(?m)^[\s>#*\-+|]+", " ")
    flat = F.trim(F.regexp_replace(lead, r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(flat, "<", "&lt;"), r"\$", r"\\\$")


def title_case(text: Column) -> Column:
    """Capital after every non-letter, not only after blanks."""
    runs = F.regexp_extract_all(text, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    cased = F.transform(
        runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))
    )
    return F.array_join(cased, "")


def token_windows(text: Column, size: int, overlap: int) -> Column:
    """Overlapping pieces of `size` tokens; the pieces keep the original spelling and blanks."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(" + TOKEN_WITH_TAIL + ")"), F.lit(1))

    def cut(p: Column) -> Column:
        last = F.greatest(F.size(p) - F.lit(overlap + 1), F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), last, F.lit(size - overlap)),
            lambda s: F.struct(
                s.alias("start"),
                F.least(F.lit(size), F.size(p) - s).alias("n_tokens"),
                F.rtrim(F.array_join(F.slice(p, s + 1, size), "")).alias("piece"),
            ),
        )

    # One-element wrapping binds the extracted parts once per row instead of once per window.
    windows = F.flatten(F.transform(F.array(parts), cut))
    return F.filter(windows, lambda w: w["n_tokens"] > 0)
