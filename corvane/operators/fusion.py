"""Channel ranks to fused, parent-expanded, budgeted and packed context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.functions.values import freshness_text
from corvane.operators.ranking import top_n_per_group

# Fusion constant, weights, budgets and block formats.
RRF_K = 60
WEIGHTS = {"exact": 1.0, "dense": 0.5, "bm25": 0.5}
DEFAULT_WEIGHT = 1.0
CHANNEL_ORDER = ("exact", "dense", "bm25")
EXACT_LIMIT = 8
PARENT_TOP = 3
PARENT_BUDGET = 900
TOP_K = 6
CONTEXT_MAX_TOKENS = 3000
CONTEXT_MIN_RATIO = 0.55
CONTEXT_MIN_DOCS = 3
BLOCK_BUDGETS = {"rule": 3000, "latest": 800, "league": 2200}
BLOCK_ORDER = ("rule", "latest", "league")
BLOCK_SEPARATOR = "\n\n"
# Every block starts with a bracketed header of at least this many tokens.
MODEL_LABEL = "일반 지식"
MODEL_TEXT = (
    "이 질문의 답은 규칙집·리그 규정·KBO 데이터에서 확인되지 않았습니다. "
    "web_search 도구를 쓸 수 있으면 먼저 확인하고, 그래도 없으면 널리 합의된 야구 상식으로 답하세요. "
    "순위·기록·일정 같은 값은 확인된 자료 없이 말하지 말고, 규칙 번호는 인용하지 마세요."
)


def channel(hits: DataFrame, name: str) -> DataFrame:
    """Hits of one search as (qid, channel, rank, id, score)."""
    return hits.select("qid", F.lit(name).alias("channel"), F.col("rank").cast("int").alias("rank"), "id", "score")


def channel_rank(hits: DataFrame, name: str, order: list[Column], limit: int) -> DataFrame:
    """0-based rank of the best `limit` hits per query."""
    ranked = top_n_per_group(hits, ["qid"], order, limit).withColumn("rank", F.col("rank") - 1)
    return channel(ranked, name)


def union_channels(*channels: DataFrame) -> DataFrame:
    out = channels[0]
    for c in channels[1:]:
        out = out.unionByName(c)
    return out


def _per_channel(values: dict[str, float | int], default: Column) -> Column:
    out = default
    for name, value in values.items():
        out = F.when(F.col("channel") == name, F.lit(value)).otherwise(out)
    return out


def rrf_fuse(hits: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """(qid, id, score_fused, fused_rank): weighted reciprocal ranks, ties in first-seen order.

    A channel of weight 0 keeps its ids at score 0.
    """
    weight = _per_channel(WEIGHTS if weights is None else weights, F.lit(DEFAULT_WEIGHT))
    priority = _per_channel({c: i for i, c in enumerate(CHANNEL_ORDER)}, F.lit(len(CHANNEL_ORDER)))
    summed = hits.groupBy("qid", "id").agg(
        F.round(F.sum(weight / (k + F.col("rank") + 1)), 9).alias("score_fused"),
        # Channel, then rank, in one number: a plain minimum.
        F.min(priority.cast("bigint") * (1 << 40) + F.col("rank")).alias("_seen"),
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score_fused"), "_seen", "id")
    return summed.withColumn("fused_rank", F.row_number().over(order)).drop("_seen")


def retrieval_signals(hits: DataFrame, references: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query dense_top, bm25_max, bm25_ratio and exact hits; queries without hits get zeros."""
    is_dense, is_bm25 = F.col("channel") == "dense", F.col("channel") == "bm25"
    is_exact = F.col("channel") == "exact"
    exact = F.array_sort(F.collect_list(F.when(is_exact, F.struct("rank", "id"))))
    per = hits.groupBy("qid").agg(
        F.coalesce(F.max(F.when(is_dense, F.col("score"))), F.lit(0.0)).alias("dense_top"),
        F.coalesce(F.max(F.when(is_bm25, F.col("score"))), F.lit(0.0)).alias("bm25_max"),
        F.transform(exact, lambda x: x["id"]).alias("exact_hits"),
    )
    joined = queries.select("qid").join(per, "qid", "left")
    reference = references.select("ref_score").scalar()
    ratio = F.coalesce(F.try_divide(F.col("bm25_max"), reference), F.lit(0.0))
    return (
        joined.fillna(0.0, ["dense_top", "bm25_max"])
        .withColumn("bm25_ratio", F.round(ratio, 6))
        .withColumn("n_exact", F.when(F.col("exact_hits").isNull(), 0).otherwise(F.size("exact_hits")))
    )


def exact_match(queries: DataFrame, chunks: DataFrame, limit: int = EXACT_LIMIT, *, text: str = "text") -> DataFrame:
    """Chunks whose rule number a query names, first `limit` by chunk_index.

    A query's first chunks lie among the first of each rule number, so each number is cut before the
    join and a number holding much of the table stays small.
    """
    asked = queries.select("qid", F.explode(F.array_distinct(X.rule_numbers(X.nfkc(F.col(text))))).alias("rule_no"))
    per_rule = top_n_per_group(
        chunks.where(F.col("rule_no").isNotNull()).select("id", "rule_no", "chunk_index"),
        ["rule_no"], [F.col("chunk_index"), F.col("id")], limit, rank=None,
    )
    found = asked.join(per_rule, "rule_no").withColumn("score", F.lit(1.0))
    return channel_rank(found, "exact", [F.col("chunk_index"), F.col("id")], limit)


def pool_payload(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fused ids with their chunk columns; ids without a chunk are dropped."""
    return fused.join(chunks, "id")


def sibling_prefix(chunks: DataFrame, parents: DataFrame, budget: int = PARENT_BUDGET) -> DataFrame:
    """Siblings of the given parents, in order, while their tokens fit the budget."""
    rows = chunks.where(F.col("parent_id").isNotNull()).join(parents, "parent_id", "left_semi")
    own = Window.partitionBy("parent_id").orderBy("chunk_index", "id")
    first = rows.withColumn("sibling_no", F.row_number().over(own))
    upto = Window.partitionBy("parent_id").orderBy("sibling_no").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("_used", F.sum("tokens").over(upto)).where(F.col("_used") <= budget).drop("_used")


def expand_parents(
    ranked: DataFrame, chunks: DataFrame, *, top: int = PARENT_TOP, budget: int = PARENT_BUDGET
) -> DataFrame:
    """Replaces sub-item hits among the first `top` by their whole parent.

    ranked: qid, id, fused_rank, score_fused. chunks: id, parent_id, sub_item, chunk_index, tokens,
    page_start, page_end, content, breadcrumb. A merged parent takes the place and score of its first
    ranked member; later members of that parent are dropped, also below the first `top`.
    """
    pooled = pool_payload(ranked, chunks)
    named = (F.coalesce("sub_item", F.lit("")) != "") & (F.coalesce("parent_id", F.lit("")) != "")
    leads = (F.col("fused_rank") <= top) & named
    picked = sibling_prefix(chunks, pooled.where(leads).select("parent_id").distinct(), budget)
    marker = F.coalesce("sub_item", F.lit(""))
    part = X.strip(F.concat_ws(" ", F.nullif(marker, F.lit("")), X.strip(X.body(F.col("content")))))
    parts = F.array_sort(F.collect_list(F.struct("sibling_no", part.alias("t"))))
    merged = picked.groupBy("parent_id").agg(
        F.sum("tokens").alias("m_tokens"),
        F.min("page_start").alias("m_page_start"),
        F.max("page_end").alias("m_page_end"),
        F.concat(
            F.substring_index(F.min_by("content", "sibling_no"), "\n", 1),
            F.lit("\n"),
            F.array_join(F.transform(parts, lambda p: p["t"]), "\n"),
        ).alias("m_content"),
        F.min_by("breadcrumb", "sibling_no").alias("m_crumb"),
    )
    crumb = F.regexp_replace("m_crumb", r"(?s) [^ ]*$", "")
    member = Window.partitionBy("qid", "parent_id").orderBy("fused_rank")
    led = F.max(F.coalesce(leads, F.lit(False))).over(Window.partitionBy("qid", "parent_id"))
    joined = (
        # Windows follow the join, whose exchange by parent serves them, too.
        pooled.join(merged, "parent_id", "left")
        .withColumn("_wanted", led)
        .withColumn("_merge", F.col("_wanted") & F.col("m_tokens").isNotNull())
        .withColumn("_nth", F.when(F.col("_merge"), F.row_number().over(member)).otherwise(F.lit(1)))
        .where(F.col("_nth") == 1)
    )

    def either(merged_value: Column, own: str) -> Column:
        return F.when(F.col("_merge"), merged_value).otherwise(F.col(own)).alias(own)

    rows = joined.select(
        "qid", "fused_rank", "score_fused",
        F.when(F.col("_merge"), F.concat(F.lit("parent:"), "parent_id")).otherwise(F.col("id").cast("string")).alias("id"),
        either(F.col("m_tokens"), "tokens"),
        either(F.col("m_page_start"), "page_start"),
        either(F.col("m_page_end"), "page_end"),
        either(F.col("m_content"), "content"),
        either(crumb, "breadcrumb"),
        F.when(~F.col("_merge"), F.col("sub_item")).alias("sub_item"),
        "parent_id",
    )
    place = Window.partitionBy("qid").orderBy("fused_rank")
    return rows.withColumn("position", F.row_number().over(place)).drop("fused_rank")


def select_context(
    ranked: DataFrame,
    k: int = TOP_K,
    *,
    max_tokens: int = CONTEXT_MAX_TOKENS,
    min_ratio: float = CONTEXT_MIN_RATIO,
    min_docs: int = CONTEXT_MIN_DOCS,
) -> DataFrame:
    """First rows by `position` within k, the token budget and, after `min_docs`, the score floor.

    Scores do not rise along the list, so the walk is a prefix: once a row falls below the floor all
    later rows do too, and the budget test needs only the running sum.
    """
    top = top_n_per_group(ranked, ["qid"], [F.col("position")], k, rank="_rn")
    upto = Window.partitionBy("qid").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max("score_fused").over(Window.partitionBy("qid"))
    return (
        top.withColumn("context_tokens", F.sum("tokens").over(upto))
        .withColumn("_best", best)
        .where(F.col("context_tokens") <= max_tokens)
        .where((F.col("_rn") <= min_docs) | (F.col("score_fused") >= min_ratio * F.col("_best")))
        .drop("_best", "_rn")
    )


def rule_block(crumb: Column, page: Column, content: Column) -> tuple[Column, Column]:
    head = F.concat(F.lit("2026 공식야구규칙 | "), crumb, F.lit(" | p."), page.cast("string"))
    return head, X.strip(X.body(content))


def latest_block(label: Column, as_of: Column, url: Column, confidence: Column, text: Column) -> tuple[Column, Column]:
    def shown(c: Column, other: str) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(other))

    head = F.concat(
        F.lit("최신정보 | "), label, F.lit(" | 기준일 "), as_of, F.lit(" | 출처 "), shown(url, "내부 스냅샷"),
        F.lit(" | 신뢰도 "), shown(confidence, "-"),
    )
    return head, X.strip(text)


def league_block(label: Column, as_of: Column, source: Column, freshness: Column, text: Column) -> tuple[Column, Column]:
    head = F.concat(
        F.lit("KBO 데이터 | "), label, F.lit(" | 기준 "), as_of, F.lit(" | 출처 "), source, F.lit(" | 상태 "),
        freshness_text(freshness, as_of),
    )
    return head, X.strip(text)


def pack_context(
    blocks: DataFrame,
    *,
    budgets: dict[str, int] | None = None,
    knowledge_only: DataFrame | None = None,
    separator: str = BLOCK_SEPARATOR,
) -> DataFrame:
    """(qid, context, n_blocks, used): numbered blocks per query within each type's token budget.

    blocks: qid, block_type, position, head, body, freshness (nullable). Unavailable entries do not
    count. The number is part of a block, but every number is one token, so costs do not depend on it.
    """
    limits = BLOCK_BUDGETS if budgets is None else budgets
    ready = blocks.where(F.coalesce("freshness", F.lit("")) != "unavailable")
    counted = X.token_count(F.concat(F.lit("자료 1 | "), "head", F.lit("\n"), "body"))
    cost = counted
    parts = []
    for order, kind in enumerate(BLOCK_ORDER):
        budget = limits[kind]
        rows = ready.where(F.col("block_type") == kind).withColumn("cost", cost)
        first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("qid").orderBy("position")))
        upto = Window.partitionBy("qid").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
        fits = first.withColumn("_used", F.sum("cost").over(upto)).where(F.col("_used") <= budget)
        parts.append(fits.withColumn("_kind", F.lit(order)).drop("_used"))
    kept = union_channels(*parts)
    number = F.row_number().over(Window.partitionBy("qid").orderBy("_kind", "_rn"))
    shown = F.concat(F.lit("[자료 "), F.col("number").cast("string"), F.lit(" | "), "head", F.lit("]\n"), "body")
    ordered = F.array_sort(F.collect_list(F.struct("number", shown.alias("b"))))
    packed = (
        kept.withColumn("number", number)
        .groupBy("qid")
        .agg(
            F.array_join(F.transform(ordered, lambda x: x["b"]), separator).alias("context"),
            F.count(F.lit(1)).alias("n_blocks"),
            F.sum("cost").alias("used"),
        )
    )
    if knowledge_only is None:
        return packed
    model = F.lit(f"[자료 1 | {MODEL_LABEL} | 규칙집·웹에서 확인되지 않은 질문 | 출처 없음 | 신뢰도 uncertain]\n{MODEL_TEXT}")
    alone = knowledge_only.select("qid", model.alias("context"), F.lit(1).cast("bigint").alias("n_blocks"), X.token_count(model).cast("bigint").alias("used"))
    return packed.join(knowledge_only, "qid", "left_anti").unionByName(alone)
