"""Names, keywords and topics found inside texts.

A small lexicon, of checked size, becomes part of the scan's own expressions: every text is decided in its own row and
nothing moves. A larger one meets the texts by an equi-join on the first letters of its names.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import lexicon as L
from corvane.functions.text import nfkc

#: Names that go into the scan, at most; more are joined.
INLINE_NAMES = 512
#: First letters of a name by which it meets a text.
HEAD_CHARS = 3

# List caps and shortest name.
MAX_SNAPSHOT_ITEMS = 6
MAX_TOPICS = 2
MIN_NAME_CHARS = 2


def _literal(value, kind: T.DataType) -> Column:
    return F.lit(value).cast(kind)


def _inline(text: Column, rows: list, schema: T.StructType, name: str) -> Column:
    entries = F.array(*[F.struct(*[_literal(r[f.name], f.dataType).alias(f.name) for f in schema]) for r in rows])
    return F.filter(entries, lambda e: F.contains(text, e[name]))


def _joined(df: DataFrame, text: str, lexicon: DataFrame, name: str, out: str, sure: Column) -> DataFrame:
    """Each different text meets the names that begin with three letters found in it (shorter names: with all of
    theirs); `sure` then decides. Only text hashes and names move until a pair is to be decided."""
    key = F.xxhash64(F.col(text)).alias("_text")
    texts = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_body")).dropDuplicates(["_text"])

    def grams(n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length("_body") - (n - 1), F.lit(1)))
        return F.array_distinct(F.transform(at, lambda i: F.substring(F.col("_body"), i, F.lit(n))))

    heads = F.explode(F.array_distinct(F.concat(*[grams(n) for n in range(1, HEAD_CHARS + 1)]))).alias("_head")
    row = F.struct(*lexicon.columns).alias("_row")
    names = lexicon.select(F.substring(name, 1, HEAD_CHARS).alias("_head"), F.col(name).alias("_name"), row)
    met = texts.select("_text", heads).join(names, "_head").join(texts, "_text").where(F.contains("_body", F.col("_name")) & sure)
    found = met.groupBy("_text").agg(F.collect_list("_row").alias(out))
    none = F.array().cast(T.ArrayType(lexicon.schema))
    return df.withColumn("_text", key).join(found, "_text", "left").withColumn(out, F.coalesce(out, none)).drop("_text")


def lexicon_hits(df: DataFrame, text: str, lexicon: DataFrame, name: str, *, out: str = "found", inline: int = INLINE_NAMES) -> DataFrame:
    """Adds `out`: the lexicon rows whose `name` occurs in `text`, as an array of structs, in no fixed order."""
    usable = lexicon.where(F.coalesce(F.col(name), F.lit("")) != "")
    rows = usable.limit(inline + 1).collect()
    if not rows:
        return df.withColumn(out, F.array().cast(T.ArrayType(lexicon.schema)))
    if len(rows) <= inline:
        return df.withColumn(out, _inline(F.coalesce(F.col(text), F.lit("")), rows, lexicon.schema, name))
    return _joined(df, text, usable, name, out, F.lit(True))


def alias_rows(dim: DataFrame, *columns: str, aliases: str = "aliases") -> DataFrame:
    """One row per alias of a dimension with its other columns."""
    return dim.select(F.explode(aliases).alias("alias"), *columns)


def expand_query(queries: DataFrame, glossary: DataFrame, *, text: str = "text") -> DataFrame:
    """Adds `extra`: both names of every glossary entry with an alias of 2 or more letters in the text."""
    names = alias_rows(glossary, "term_en", "term_ko").where(F.length("alias") >= MIN_NAME_CHARS)
    hit = lexicon_hits(queries.withColumn("_plain", nfkc(F.col(text))), "_plain", names, "alias", out="_hits").drop("_plain")
    both = F.flatten(F.transform("_hits", lambda h: F.array(h["term_en"], h["term_ko"])))
    kept = F.filter(both, lambda t: F.coalesce(t, F.lit("")) != "")
    return hit.withColumn("extra", F.array_sort(F.array_distinct(kept))).drop("_hits")


def match_team(texts: DataFrame, teams: DataFrame, *, text: str = "text") -> DataFrame:
    """Adds `team`: the code with the longest contained alias; the earlier team wins a tie.

    teams: code, ord, aliases.
    """
    plain = texts.withColumn("_plain", nfkc(F.col(text)))
    hit = lexicon_hits(plain, "_plain", alias_rows(teams, "code", "ord"), "alias", out="_hits").drop("_plain")
    best = F.array_max(
        F.transform("_hits", lambda h: F.struct(F.length(h["alias"]).alias("n"), (-h["ord"]).alias("o"), h["code"].alias("code")))
    )
    return hit.withColumn("team", best["code"]).drop("_hits")


def venue_names(teams: DataFrame) -> DataFrame:
    """(name, code) for each distinct stadium or home-town name of a team."""
    names = F.array("stadium_short", "stadium", "stadium_secondary_short", "hometown")
    return teams.select("code", F.explode(names).alias("name")).where(F.trim("name") != "").select(
        F.trim("name").alias("name"), "code"
    ).distinct()


def match_venue(texts: DataFrame, venues: DataFrame, *, text: str = "text") -> DataFrame:
    """Adds `venue`, the longest contained name, and `venue_codes`, all teams sharing it."""
    plain = texts.withColumn("_plain", nfkc(F.col(text)))
    hit = lexicon_hits(plain, "_plain", venues.select("name", "code"), "name", out="_hits").drop("_plain")
    first = F.array_min(
        F.transform("_hits", lambda h: F.struct((-F.length(h["name"])).alias("n"), h["code"].alias("code"), h["name"].alias("name")))
    )
    named = hit.withColumn("venue", first["name"])
    shared = F.filter("_hits", lambda h: h["name"] == F.col("venue"))
    codes = F.array_sort(F.transform(shared, lambda h: h["code"]))
    return named.withColumn("venue_codes", F.when(F.col("venue").isNotNull(), codes)).drop("_hits")


def team_or_venue(matched: DataFrame) -> DataFrame:
    """`team` falls back to the venue's team when exactly one team uses it."""
    only = F.when(F.size("venue_codes") == 1, F.col("venue_codes")[0])
    return matched.withColumn("team", F.coalesce("team", only))


def keyword_hit(lowered: Column, keyword: str) -> Column:
    """The keyword occurs in lower-cased text, a blank in it standing for any amount of blanks.

    Plain substring tests decide most texts; the pattern runs only where all parts occur.
    """
    parts = keyword.lower().split()
    found = F.lit(True)
    for part in parts:
        found = found & F.contains(lowered, F.lit(part))
    return found & lowered.rlike(r"\s*".join(re.escape(p) for p in parts)) if len(parts) > 1 else found


def match_keywords(
    texts: DataFrame, items: DataFrame, *, text: str = "text", limit: int = MAX_SNAPSHOT_ITEMS, out: str = "items", inline: int = INLINE_NAMES
) -> DataFrame:
    """Adds the ids of the first `limit` items, in table order, with a keyword in the text.

    items: ord, id, keywords.
    """
    # Wrapped once, so that lower-casing runs once per row and not once per keyword.
    lowered = F.array(F.struct(F.lower(nfkc(F.coalesce(F.col(text), F.lit("")))).alias("_low")))
    ready = texts.select("*", F.inline(lowered))
    known = items.select("ord", "id", "keywords")
    rows = sorted(known.limit(inline + 1).collect(), key=lambda r: r["ord"])
    if len(rows) > inline:
        return _joined_keywords(ready, known, limit, out).drop("_low")
    low = F.col("_low")
    hits = []
    for r in rows:
        words = [keyword_hit(low, k) for k in r["keywords"] if k and k.strip()]
        if words:
            hits.append(F.when(reduce(Column.__or__, words), F.lit(r["id"])))
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return ready.withColumn(out, F.slice(found, 1, limit)).drop("_low")


def _joined_keywords(ready: DataFrame, items: DataFrame, limit: int, out: str) -> DataFrame:
    """The same for many items: keywords meet texts by the first letters of their first part."""
    each = items.select("ord", "id", F.explode("keywords").alias("_word"))
    words = each.withColumn("_word", F.lower("_word")).where(F.trim("_word") != "")
    parts = F.split(F.trim("_word"), r"\s+")
    quoted = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("\\Q"), p, F.lit("\\E"))), r"\s*")
    heads = words.select("ord", "id", parts[0].alias("_first"), quoted.alias("_pattern"))
    met = _joined(ready, "_low", heads, "_first", "_items", F.expr("rlike(_body, _row._pattern)"))
    first = F.array_sort(F.array_distinct(F.transform("_items", lambda h: F.struct(h["ord"].alias("ord"), h["id"].alias("id")))))
    return met.withColumn(out, F.slice(F.transform(first, lambda h: h["id"]), 1, limit)).drop("_items")


def snapshot_entries(matched: DataFrame, items: DataFrame, *, key: str = "qid") -> DataFrame:
    """Context entries of the matched regulation items, in table order."""
    each = matched.select(key, F.explode("items").alias("id"))
    return each.join(items, "id").select(
        key,
        F.lit("snapshot").alias("kind"),
        F.concat(F.lit("KBO 리그 규정 — "), "title").alias("label"),
        "text",
        F.col("as_of").cast("string").alias("as_of"),
        "source_url",
        "confidence",
        F.col("ord").alias("position"),
    )


def tag_topics_teams(
    texts: DataFrame, teams: DataFrame, *, text: str = "text", topics: tuple[L.Pattern, ...] = L.TOPICS, limit: int = MAX_TOPICS
) -> DataFrame:
    """Adds `topics`, first `limit` in table order, and `teams`, longest contained alias first, any case."""
    upper = alias_rows(teams, "code", "ord").withColumn("alias", F.upper("alias"))
    shouted = texts.withColumn("_plain", nfkc(F.col(text))).withColumn("_upper", F.upper("_plain"))
    hit = lexicon_hits(shouted, "_upper", upper, "alias", out="_hits")
    ordered = F.array_sort(
        F.transform("_hits", lambda h: F.struct((-F.length(h["alias"])).alias("n"), h["ord"].alias("o"), h["code"].alias("code")))
    )
    return (
        hit.withColumn("topics", F.slice(L.hits(F.col("_plain"), topics), 1, limit))
        .withColumn("teams", F.array_distinct(F.transform(ordered, lambda h: h["code"])))
        .drop("_hits", "_upper", "_plain")
    )


def name_lexicon(*names: DataFrame) -> DataFrame:
    """Distinct names of 2 or more letters from one-column tables."""
    out = names[0].toDF("name")
    for n in names[1:]:
        out = out.unionByName(n.toDF("name"))
    return out.where(F.length("name") >= MIN_NAME_CHARS).distinct()
