"""Pages of new documents to stored chunks: skip what is current, check, write, activate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators.chunks import CHUNKER_VERSION, build_chunks
from corvane.operators.sections import front_sections, sectionize
from corvane.session import cut_lineage
from corvane.sources.files import write_chunks, write_documents
from corvane.sources.lines import explode_lines, strip_noise


@dataclass
class Ingested:
    documents: DataFrame
    chunks: DataFrame
    rejected: DataFrame


def versioned(pages: DataFrame, *, model: str, dims: int, chunker: str = CHUNKER_VERSION) -> DataFrame:
    """Adds sha256, index_version and document_id per source file.

    pages: source, page_no, text. The digest covers the page digests in order, so a file's text is not
    gathered to hash it.
    """
    page = F.sha2(F.col("text"), 256)
    ordered = F.array_sort(F.collect_list(F.struct("page_no", page.alias("h"))))
    digest = F.sha2(F.array_join(F.transform(ordered, lambda p: p["h"]), ""), 256)
    files = pages.groupBy("source").agg(digest.alias("sha256"), F.count_distinct("page_no").alias("page_count"))
    version = X.index_version(F.col("sha256"), chunker, model, dims)
    return files.withColumn("index_version", version).withColumn("document_id", X.document_id(F.col("index_version")))


def ingest(
    pages: DataFrame,
    documents: DataFrame | None = None,
    *,
    model: str,
    dims: int,
    cells: DataFrame | None = None,
    force: bool = False,
) -> Ingested:
    """Chunks of every file whose index_version is not active yet.

    A file passes the structural gate when it has chunks and all of them carry a rule id and a page;
    the others land in `rejected` and activate nothing.
    """
    files = versioned(pages, model=model, dims=dims)
    todo = files
    if documents is not None and not force:
        todo = files.join(documents.where("active").select("index_version"), "index_version", "left_anti")
    picked = pages.join(todo.select("source", F.col("document_id").alias("doc_id"), "index_version"), "source")
    lines = strip_noise(explode_lines(picked, "doc_id", "index_version", "page_no"))
    body = sectionize(lines.drop("index_version"))
    sections = body.unionByName(front_sections(lines.drop("index_version"), cells), allowMissingColumns=True)
    known = todo.select(F.col("document_id").alias("doc_id"), "index_version")
    chunks = cut_lineage(build_chunks(sections.join(known, "doc_id")))
    sound = chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.bool_and(F.col("rule_id").isNotNull() & (F.coalesce("page_start", F.lit(0)) > 0)).alias("sound"),
    )
    checked = todo.join(sound, "document_id", "left").fillna({"chunk_count": 0, "sound": False})
    good = checked.where("sound").select(
        F.col("document_id").alias("id"), "source", "sha256", "index_version", "page_count", "chunk_count", F.lit(True).alias("active")
    )
    bad = checked.where(~F.col("sound")).select("document_id", "source", "index_version", "chunk_count")
    return Ingested(good, chunks.join(good.select(F.col("id").alias("document_id")), "document_id", "left_semi"), bad)


def store(result: Ingested, path: str) -> None:
    """Chunks first, then the document rows that make them visible."""
    write_chunks(result.chunks, f"{path}/chunks")
    write_documents(result.documents, f"{path}/documents")
