"""Golden-set evaluation as one job: recall, per-case checks, summary, gates, verdict averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Gates, axes and codes.
RECALL_AT = 6
GATES = {
    "recall_at_6": 0.8,
    "route_mismatch_allowed": 0,
    "status_mismatch_allowed": 2,
    "answer_kind_mismatch_allowed": 1,
    "sources_nonempty_ratio": 1.0,
    "judge_grounded_avg": 4.0,
    "judge_grounded_min": 3,
    "judge_schema_format_avg": 4.0,
}
BLOCKING_LINT = ("REFUSAL_INSIDE_ANSWER", "EMPTY_HEADLINE")
SCHEMA_FALLBACK = "SCHEMA_FALLBACK"
BASELINES = {
    "rrf": {"exact": 1.0, "dense": 0.5, "bm25": 0.5},
    "dense": {"exact": 1.0, "dense": 0.5, "bm25": 0.0},
    "bm25": {"exact": 1.0, "dense": 0.0, "bm25": 0.5},
}


def covered_refs(expected: Column, retrieved: Column) -> Column:
    """Expected references some retrieved one equals or continues."""
    return F.filter(expected, lambda e: F.exists(retrieved, lambda r: r.startswith(e)))


def retrieved_refs(docs: DataFrame, k: int = RECALL_AT, *, ref: str = "rule_id", position: str = "position") -> DataFrame:
    """Per query the references of its first k results, in order."""
    rows = docs.where(F.col(position) <= k)
    ordered = F.array_sort(F.collect_list(F.struct(position, F.col(ref).alias("r"))))
    return rows.groupBy("qid").agg(F.transform(ordered, lambda x: x["r"]).alias("retrieved"))


def recall_at_k(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """cases: qid, expected array → qid, scored, recall. Cases without expectations are not scored."""
    empty = F.array().cast("array<string>")
    joined = cases.join(retrieved, "qid", "left")
    want, got = F.coalesce("expected", empty), F.coalesce("retrieved", empty)
    share = F.try_divide(F.size(covered_refs(want, got)).cast("double"), F.size(want))
    return joined.withColumn("scored", F.size(want) > 0).withColumn("recall", F.when(F.size(want) > 0, share).otherwise(F.lit(1.0)))


def case_checks(cases: DataFrame) -> DataFrame:
    """Adds route_ok, top1_ok, status_ok, must_contain_ok, refusal_exact_ok and answer_kind_ok; null where not asked.

    cases: golden columns joined with route, status, freshness, answer, answer_kind, called, retrieved.
    """
    none = F.lit(None).cast("boolean")
    single = F.when(F.col("expect_status").isNotNull(), F.array("expect_status"))
    given = F.when(F.size("expect_status_in") > 0, F.col("expect_status_in"))
    allowed = F.coalesce(given, single, F.array().cast("array<string>"))
    in_status = F.when(F.size(allowed) > 0, F.array_contains(allowed, F.col("status")))
    fresh_asked = F.coalesce(F.size("expect_freshness_in"), F.lit(0)) > 0
    fresh = F.array_contains("expect_freshness_in", F.col("freshness"))
    patterns = F.coalesce(F.size("must_contain"), F.lit(0)) > 0
    first = F.get("retrieved", F.lit(0))
    return (
        cases.withColumn("route_ok", F.col("route") == F.col("expect_route"))
        .withColumn("top1_ok", F.when(F.col("expect_top1").isNotNull(), F.coalesce(first.startswith(F.col("expect_top1")), F.lit(False))))
        .withColumn("status_ok", F.when(fresh_asked, F.coalesce(in_status, F.lit(False)) & fresh).otherwise(in_status))
        .withColumn("must_contain_ok", F.when(patterns, F.forall("must_contain", lambda p: F.regexp_like(F.col("answer"), p))))
        .withColumn("refusal_exact_ok", F.when(F.col("expect_answer_exact").isNotNull(), F.col("answer") == F.col("expect_answer_exact")))
        .withColumn(
            "answer_kind_ok",
            F.when(F.col("expect_answer_kind").isNotNull() & F.col("called"), F.col("answer_kind") == F.col("expect_answer_kind")).otherwise(none),
        )
    )


def eval_summary(cases: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per key: counts of matches and totals, recall over scored cases, source coverage."""

    def matched(c: str) -> Column:
        return F.count_if(F.coalesce(F.col(c), F.lit(False)))

    answered = F.col("status") == "answered"
    scored = F.greatest(F.count_if("scored"), F.lit(1))
    codes = F.coalesce("lint_codes", F.array().cast("array<string>"))
    return cases.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("cases"),
        matched("route_ok").alias("route_match"),
        F.round(F.coalesce(F.sum(F.when(F.col("scored"), F.col("recall"))), F.lit(0.0)) / scored, 3).alias("recall_at_6"),
        F.count_if("scored").alias("recall_scored_cases"),
        F.coalesce(F.bool_and("top1_ok"), F.lit(True)).alias("top1_ok"),
        matched("status_ok").alias("status_match"),
        F.count("status_ok").alias("status_total"),
        matched("must_contain_ok").alias("must_contain_match"),
        F.count("must_contain_ok").alias("must_contain_total"),
        matched("refusal_exact_ok").alias("refusal_exact"),
        F.count("refusal_exact_ok").alias("refusal_exact_total"),
        F.round(F.count_if(answered & (F.col("sources") > 0)) / F.greatest(F.count_if(answered), F.lit(1)), 3).alias("sources_nonempty_ratio"),
        matched("answer_kind_ok").alias("answer_kind_match"),
        F.count("answer_kind_ok").alias("answer_kind_total"),
        F.count_if(F.array_contains(codes, SCHEMA_FALLBACK)).alias("schema_fallback"),
        F.count_if(F.arrays_overlap(codes, F.array(*[F.lit(c) for c in BLOCKING_LINT]))).alias("blocking_lint"),
    )


def verdict_averages(verdicts: DataFrame, axes: tuple[str, ...], keys: list[str] | None = None) -> DataFrame:
    """Per axis average (2 digits) and minimum of valid verdicts, scores held to 1..5; failures counted apart.

    A verdict with any missing score counts as failed.
    """
    valid = F.lit(True)
    for a in axes:
        valid = valid & F.col(a).isNotNull()

    def score(a: str) -> Column:
        return F.when(valid, F.greatest(F.lit(1), F.least(F.lit(5), F.col(a).cast("int"))))

    stats = [s for a in axes for s in (F.round(F.avg(score(a)), 2).alias(f"judge_{a}_avg"), F.min(score(a)).alias(f"judge_{a}_min"))]
    return verdicts.groupBy(*(keys or [])).agg(
        F.count_if(valid).alias("judge_scored"), F.count_if(~valid).alias("judge_failed"), *stats
    )


def check_gates(summary: DataFrame, gates: dict[str, float] | None = None, *, answers: bool = True, schema: bool = True) -> DataFrame:
    """Adds `failures`, the names of the gates a summary row misses, and `passed`."""
    g = {**GATES, **(gates or {})}
    c = F.col

    def gap(total: str, match: str) -> Column:
        return c(total) - c(match)

    checks = [
        ("recall_at_6", c("recall_at_6") < g["recall_at_6"]),
        ("route", gap("cases", "route_match") > g["route_mismatch_allowed"]),
        ("top1", ~c("top1_ok")),
    ]
    if answers:
        checks += [
            ("status", gap("status_total", "status_match") > g["status_mismatch_allowed"]),
            ("refusal_exact", c("refusal_exact") < c("refusal_exact_total")),
            ("sources_nonempty", c("sources_nonempty_ratio") < g["sources_nonempty_ratio"]),
            ("must_contain", c("must_contain_match") < c("must_contain_total")),
        ]
        if schema:
            checks += [
                ("schema_fallback", c("schema_fallback") > 0),
                ("lint_blocking", c("blocking_lint") > 0),
                ("answer_kind", gap("answer_kind_total", "answer_kind_match") > g["answer_kind_mismatch_allowed"]),
            ]
        for name in ("judge_grounded_avg", "judge_schema_format_avg", "judge_grounded_min"):
            if name in summary.columns:
                checks.append((name, c(name) < g[name]))
    failures = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in checks]))
    return summary.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)
