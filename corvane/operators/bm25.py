"""BM25 over a corpus table for a table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import postings
from corvane.operators.postings import Index
from corvane.operators.ranking import in_order
from corvane.session import spread

# Channel depth and reference-score sample.
TOP_K = 20
LEGACY_TOP_K = 5
LEGACY_SEPARATOR = "\n---\n"
REFERENCE_SAMPLE = 30
REFERENCE_BODY_CHARS = 120
REFERENCE_TERMS = 3
MIN_REFERENCE = 1e-6


def index_corpus(docs: DataFrame, id: str = "doc_id", text: str = "text", *, normalize: bool = True) -> Index:
    """The stored index of the texts: built once, searched as often as wanted."""
    rows = spread(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "id")
    source = X.nfkc(F.col("text")) if normalize else F.col("text")
    return postings.build(rows.select("id", X.tokens(source).alias("tokens")))


def term_stats(index: Index) -> DataFrame:
    """(term, df, idf)."""
    return index.stats.select("term", "df", "idf")


def query_terms(queries: DataFrame, qid: str = "qid", text: str = "text", extra: str | None = None, *, normalize: bool = True) -> DataFrame:
    """(qid, term, qtf) with repeated query terms counted; `extra` is an array of added phrases."""
    source = X.nfkc(F.col(text)) if normalize else F.col(text)
    words = X.tokens(source)
    if extra:
        added = F.flatten(F.transform(F.coalesce(F.col(extra), F.array().cast("array<string>")), lambda t: X.tokens(t)))
        words = F.concat(words, added)
    return (
        queries.select(F.col(qid).alias("qid"), F.explode(words).alias("term"))
        .groupBy("qid", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def bm25_topk(index: Index, terms: DataFrame, k: int = TOP_K) -> DataFrame:
    """(qid, id, score, rank) best k per query with a rounded score > 0."""
    return postings.search(index, terms, k)


def systematic_sample(docs: DataFrame, id: str, sample: int = REFERENCE_SAMPLE) -> DataFrame:
    """Rows 0, step, 2·step, … in id order, at most `sample`, with step = max(1, n // sample)."""
    step = max(1, docs.count() // sample)
    placed = in_order(docs.select(id), [F.col(id)], "_pos")
    picked = placed.where((F.col("_pos") % step == 0) & (F.col("_pos") < sample * step)).select(id)
    # At most `sample` ids, so they can go into the scan as a pushed-down filter.
    return docs.where(F.col(id).isin([r[0] for r in picked.collect()]))


def bm25_reference(
    docs: DataFrame, index: Index, kind: str = "short", *, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row `ref_score`: the 0.9 index pick of the best scores of sampled own texts."""
    sample = systematic_sample(docs.select(id, text), id)
    if kind == "sentence":
        asked = F.substring(X.body(F.col(text)), 1, REFERENCE_BODY_CHARS)
        terms = query_terms(sample.select(F.col(id).alias("qid"), asked.alias("q")), "qid", "q")
    else:
        head = F.substring_index(F.col(text), "\n", 1)
        words = F.slice(X.tokens(X.nfkc(head)), 1, REFERENCE_TERMS)
        terms = sample.select(F.col(id).alias("qid"), F.explode(words).alias("term")).groupBy("qid", "term").agg(
            F.count(F.lit(1)).alias("qtf")
        )
    asked_ids = sample.select(F.col(id).alias("qid")) if kind == "sentence" else terms.select("qid").distinct()
    top = bm25_topk(index, terms, 1).select("qid", "score")
    # At most `sample` values, so one sorted array is small by construction.
    tops = asked_ids.join(top, "qid", "left").agg(
        F.array_sort(F.collect_list(F.coalesce("score", F.lit(0.0)))).alias("_t")
    )
    at = F.least(F.size("_t") - 1, F.floor(F.size("_t") * 0.9).cast("int"))
    value = F.when(F.size("_t") == 0, F.lit(1.0)).otherwise(F.greatest(F.get("_t", at), F.lit(MIN_REFERENCE)))
    return tops.select(value.alias("ref_score"), F.size("_t").alias("sampled"))


def joined_results(hits: DataFrame, docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per query the hit texts with their source, best first, in one string."""
    rows = hits.join(docs.select(F.col(id).alias("id"), F.col(text).alias("_t"), F.col(source).alias("_s")), "id")
    piece = F.concat("_t", F.lit("\nURL: "), "_s")
    ordered = F.array_sort(F.collect_list(F.struct("rank", piece.alias("p"))))
    return rows.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["p"]), LEGACY_SEPARATOR).alias("context"))
