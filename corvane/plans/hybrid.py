"""The whole search for a table of queries: three channels, fusion, expansion, context."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.values import should_abstain
from corvane.operators import bm25, dense, fusion
from corvane.operators.graph import graph_topk
from corvane.operators.postings import Index
from corvane.session import stored_table


@dataclass
class SearchIndex:
    """Tables a search reads.

    chunks: id, content, rule_no, parent_id, sub_item, chunk_index, tokens, page_start, page_end,
    breadcrumb. vectors: id, embedding. terms: the BM25 index of the chunk contents. With a stored `graph` of the
    vectors the vector channel walks it instead of comparing exactly.
    """

    chunks: DataFrame
    terms: Index
    vectors: DataFrame
    reference: DataFrame
    graph: DataFrame | None = None
    weights: dict[str, float] = field(default_factory=lambda: dict(fusion.WEIGHTS))


@dataclass
class SearchResult:
    channels: DataFrame
    fused: DataFrame
    ranked: DataFrame
    docs: DataFrame
    signals: DataFrame


def search_channels(queries: DataFrame, query_vectors: DataFrame, index: SearchIndex, extra: str | None = None) -> DataFrame:
    """(qid, channel, rank, id, score) of exact, dense and BM25 hits."""
    exact = fusion.exact_match(queries, index.chunks)
    near = graph_topk(index.graph, query_vectors) if index.graph is not None else dense.dense_topk(index.vectors, query_vectors)
    near = fusion.channel(near, "dense")
    words = bm25.query_terms(queries, "qid", "text", extra)
    lexical = fusion.channel(bm25.bm25_topk(index.terms, words), "bm25")
    return fusion.union_channels(exact, near, lexical)


def hybrid_search(
    queries: DataFrame, query_vectors: DataFrame, index: SearchIndex, k: int = fusion.TOP_K, *, extra: str | None = None
) -> SearchResult:
    """queries(qid, text, and, as `extra`, an array of phrases that expand_query added), query_vectors(qid, embedding); a query without a vector counts as dense-failed."""
    hits = stored_table(search_channels(queries, query_vectors, index, extra), "hits")
    fused = fusion.rrf_fuse(hits, index.weights)
    ranked = fusion.expand_parents(fused, index.chunks)
    docs = fusion.select_context(ranked, k)
    base = fusion.retrieval_signals(hits, index.reference, queries)
    failed = base.join(query_vectors.select("qid", F.lit(False).alias("_ok")), "qid", "left").withColumn(
        "dense_failed", F.col("_ok").isNull()
    )
    decided = should_abstain(F.col("n_exact") > 0, F.col("dense_failed"), F.col("dense_top"), F.col("bm25_ratio"))
    return SearchResult(hits, fused, ranked, docs, failed.withColumn("abstain", decided).drop("_ok"))
