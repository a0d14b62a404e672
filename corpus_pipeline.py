"""A training corpus from documents: five stages, each an operator of corvane.llm over all rows that the one before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm import bin_slack, mixing, near_dedup, pii, site_quality
from corvane.llm.common import row_key, table
from corvane.session import shared_dir

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _of_keys(docs: DataFrame, keys: DataFrame, once: bool = False) -> DataFrame:
    """The rows of docs whose content key is among `keys`(rk); with `once`, one row for each key."""
    named = docs.withColumn("__row", row_key(F.col("doc_id"), F.col("text")))
    rows = named.join(keys.select(F.col("rk").alias("__row")).distinct(), "__row", "left_semi")
    if once:
        same = Window.partitionBy("__row").orderBy(F.xxhash64(*docs.columns))
        rows = rows.withColumn("__copy", F.row_number().over(same)).filter(F.col("__copy") == 1)
    return rows.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    verdicts = site_quality.classify(docs, table(spark, sf_dir, "labels"))
    return _of_keys(docs, verdicts.filter("kept"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id. Repeated rows of it become one."""
    found = near_dedup.near_duplicates(docs)
    return _of_keys(docs, found.filter("kept"), once=True)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.masked(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often, and as far, as their sources' targets take them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces in training sequences."""
    return bin_slack.pack(docs, TOKENIZER)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicate removal", deduplicated),
    ("personal data", without_personal_data),
    ("source mixing", mixed),
    ("packing", packed),
]
#: SQL has no form for the trained and the scheduled stages; tests hold run() against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{base}/{n}")
        docs = spark.read.schema(made.schema).parquet(f"{base}/{n}")
    return docs
