"""Route, scope and answer status as column decisions over a text table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import lexicon as L
from corvane.functions.text import RULE_NO, nfkc
from corvane.operators.matching import lexicon_hits

# Tail length that still counts as a pure refusal, and the noise it ignores.
REFUSAL_TAIL_CHARS = 40
REFUSAL_NOISE = r"[\s\"'“”‘’.。!?,\-–—*_`>#:()\[\]]+"


@dataclass(frozen=True)
class Lexicon:
    rule: L.Pattern = L.RULE
    latest: L.Pattern = L.LATEST
    domain: L.Pattern = L.DOMAIN
    concept: L.Pattern = L.CONCEPT
    league: L.Pattern = L.LEAGUE
    live: L.Pattern = L.LIVE
    off_domain: L.Pattern = L.OFF_DOMAIN
    topics: tuple[L.Pattern, ...] = L.TOPICS


def route_queries(tagged: DataFrame, *, text: str = "text", lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Adds rule_hit, latest_hit, domain_hit, route and routed_by; expects `topics` and `teams` arrays."""
    t = F.col("_plain")
    flagged = (
        tagged.withColumn("_plain", nfkc(F.col(text)))
        .withColumn("rule_hit", L.hit(t, lexicon.rule))
        .withColumn("_latest", L.hit(t, lexicon.latest))
        .withColumn("domain_hit", L.hit(t, lexicon.domain))
        .withColumn("_data", (F.size("topics") > 0) & (F.size("teams") > 0))
    )
    any_hit = F.col("_data") | F.col("rule_hit") | F.col("_latest") | F.col("domain_hit")
    kind = (
        F.when(F.col("_data"), F.lit("latest"))
        .when(F.col("rule_hit") & F.col("_latest"), F.lit("mixed"))
        .when(F.col("_latest"), F.lit("latest"))
        .otherwise(F.lit("rule"))
    )
    return (
        flagged.withColumn("latest_hit", F.col("_latest") | F.col("_data"))
        .withColumn("route", kind)
        .withColumn("routed_by", F.when(any_hit, F.lit("keyword")).otherwise(F.lit("default")))
        .drop("_latest", "_data", "_plain")
    )


def scope_queries(
    texts: DataFrame, *, text: str = "text", lexicon: Lexicon = Lexicon(), names: DataFrame | None = None
) -> DataFrame:
    """Adds scope (`in_scope` or `out_of_scope`) and scope_by."""
    t = F.col("_plain")
    off = L.hit(t, lexicon.off_domain)
    masked = texts.withColumn("_plain", nfkc(F.coalesce(F.col(text), F.lit("")))).withColumn("_off", off).withColumn("_masked", F.regexp_replace(t, lexicon.off_domain.java, " "))
    m = F.col("_masked")
    generic = ("(?iu)" if lexicon.concept.ignore_case else "") + f"^(?:{lexicon.concept.regex})$"
    labelled = (lexicon.domain, lexicon.rule, lexicon.concept, lexicon.league, lexicon.live)
    firsts = [L.first_hit(m, p) for p in labelled]
    topic = F.size(L.hits(m, lexicon.topics)) > 0
    any_hit, strong = topic, topic
    for f in firsts:
        any_hit = any_hit | f.isNotNull()
        strong = strong | F.coalesce(~F.trim(f).rlike(generic), F.lit(False))
    decided = masked.withColumn("_any", any_hit).withColumn("_strong", strong)
    named = F.lit(False)
    if names is not None:
        lowered = names.select(F.lower(names.columns[0]).alias("name")).distinct()
        decided = lexicon_hits(decided.withColumn("_low", F.lower("_masked")), "_low", lowered, "name", out="_names")
        named = ~F.col("_any") & (F.size("_names") > 0)
    by = (
        F.when(t.rlike(RULE_NO), F.lit("rule_no"))
        .when(F.col("_strong") | named, F.lit("lexicon"))
        .when(F.col("_off"), F.lit("negative"))
        .when(F.col("_any"), F.lit("lexicon"))
        .otherwise(F.lit("default"))
    )
    return (
        decided.withColumn("scope_by", by)
        .withColumn("scope", F.when(F.col("scope_by") == "negative", F.lit("out_of_scope")).otherwise(F.lit("in_scope")))
        .drop("_plain", "_off", "_masked", "_any", "_strong", "_low", "_names")
    )


def answer_status(
    text: Column,
    *,
    off_topic: L.Pattern = L.OFF_TOPIC,
    not_in_context: L.Pattern = L.NOT_IN_CONTEXT,
    tail_chars: int = REFUSAL_TAIL_CHARS,
) -> Column:
    """A refusal with at most `tail_chars` of other text keeps its refusal status."""
    t = F.coalesce(text, F.lit(""))

    def rest(p: L.Pattern) -> Column:
        return F.length(F.regexp_replace(F.regexp_replace(t, p.java, ""), REFUSAL_NOISE, ""))

    def settled(p: L.Pattern, label: str) -> Column:
        return F.when(rest(p) <= tail_chars, F.lit(label)).otherwise(F.lit("answered"))

    return (
        F.when(t.rlike(r"^\s*$"), F.lit("not_in_rulebook"))
        .when(L.hit(t, off_topic), settled(off_topic, "out_of_scope"))
        .when(L.hit(t, not_in_context), settled(not_in_context, "not_in_rulebook"))
        .otherwise(F.lit("answered"))
    )


def partial_refusal(
    status: Column, text: Column, *, off_topic: L.Pattern = L.OFF_TOPIC, not_in_context: L.Pattern = L.NOT_IN_CONTEXT
) -> Column:
    return (status == "answered") & (L.hit(text, off_topic) | L.hit(text, not_in_context))
