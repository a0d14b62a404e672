"""The registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import (
    best_fit, bin_slack, bloom_lm, collocations, licenses, metric_join, mixing, near_dedup, oracles, pii, posting_lists, resampling,
    risk_rules, site_quality,
)
from corvane.llm.common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The vocabulary that token counts refer to.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, similarity 0.8."""
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 2048 ids in 16 bits, end id 0."""
    return best_fit.pack_ids(table(spark, sf_dir, "documents"), TOKENIZER, capacity=2048, end=0, bits=16)


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return bin_slack.pack(table(spark, sf_dir, "documents"), TOKENIZER, capacity=2048)


@query
def op6_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every row whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    return posting_lists.nearest(rows, rows.filter("vec_id % 100 = 0"), k=10)


@query
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 1, 2, 3 in turn, targets up to three times a source's size."""
    found, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot", "last_slot", "reads")


@query
def op8_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the bigram model of nine tenths of them."""
    return bloom_lm.score(table(spark, sf_dir, "documents"))


@query
def op1_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as hosts, languages as their sections."""
    found = site_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("rk")


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notices in all texts."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op4_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as strata; at most one in a hundred good documents at risk for each rule."""
    return risk_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rk")


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *pii.counts("base"), F.sha2(pii.digest("base"), 256).alias("base_sha256"), pii.digest("found").alias("spans"))


@query
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's words."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op11_resampling"] = oracles.RESAMPLING


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two to four words that occur 30 times or more, 2000 for each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


SQL["op12_collocations"] = oracles.COLLOCATIONS


@query
def op13_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors at a cosine of 0.9 or more."""
    return metric_join.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


SQL["op13_metric_join"] = oracles.METRIC_JOIN


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
