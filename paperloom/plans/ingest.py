"""Ingest: metadata, skip what is done, gate and chunk the rest, report a status per paper."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import paper_id, present
from paperloom.operators.pages import block_spans, block_status, chunk_pages, document_status, page_lengths, page_spans
from paperloom.operators.store import chunk_count, latest_per_key, with_chunk_ids
from paperloom.schemas import (
    ALREADY_CACHED,
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    DOWNLOAD_FAILED,
    EXTRACTION_FAILED,
    MIN_CHARS_PER_PAGE,
    NO_PDF_AVAILABLE,
    SCANNED_PDF,
    SUCCESS,
)
from paperloom.session import cut_lineage


@dataclass(frozen=True)
class IngestResult:
    """``metadata``: every paper, latest write.  ``log``: one status row per paper.  ``chunks``: of new successes."""

    metadata: DataFrame
    log: DataFrame
    chunks: DataFrame


def with_paper_id(papers: DataFrame) -> DataFrame:
    return papers.withColumn("paper_id", paper_id(F.col("source"), F.col("external_id")))


def ingest_status() -> Column:
    """First match wins over ``done, pdf_url, fetched, extract_error, page_count, gate``."""
    return (
        F.when(F.col("done"), F.lit(ALREADY_CACHED))
        .when(~present(F.col("pdf_url")), F.lit(NO_PDF_AVAILABLE))
        .when(~F.coalesce("fetched", F.lit(False)), F.lit(DOWNLOAD_FAILED))
        .when(F.col("extract_error").isNotNull(), F.lit(EXTRACTION_FAILED))
        .when((F.coalesce("page_count", F.lit(0)) == 0) | (F.col("gate") == SCANNED_PDF), F.lit(SCANNED_PDF))
        .otherwise(F.lit(SUCCESS))
    )


def known_flags(papers: DataFrame, fetches: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Papers with what the status depends on, short of their pages.

    ``fetches(paper_id, fetched, extract_error)``; ``done(paper_id, chunk_count, page_count)``.
    """
    marker = done.select(
        "paper_id",
        F.lit(not force).alias("done"),
        F.col("chunk_count").alias("stored_chunks"),
        F.col("page_count").alias("stored_pages"),
    )
    return (
        papers.select("paper_id", "title", "pdf_url")
        .join(marker, "paper_id", "left")
        .join(fetches, "paper_id", "left")
        .withColumn("done", F.coalesce("done", F.lit(False)))
    )


def readable_pages(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Pages of the papers whose status depends on them."""
    readable = known.where(
        ~F.col("done") & present(F.col("pdf_url")) & F.col("fetched") & F.col("extract_error").isNull()
    )
    return pages.join(readable.select("paper_id"), "paper_id", "left_semi")


def with_gate(known: DataFrame, gate: DataFrame) -> DataFrame:
    return known.join(gate.select("paper_id", "page_count", F.col("status").alias("gate")), "paper_id", "left")


def ingest_flags(
    papers: DataFrame, fetches: DataFrame, pages: DataFrame, done: DataFrame, min_chars: float = MIN_CHARS_PER_PAGE
) -> DataFrame:
    """Papers with everything :func:`ingest_status` reads."""
    known = known_flags(papers, fetches, done)
    return with_gate(known, document_status(readable_pages(pages, known), min_chars))


def ingest_papers(
    papers: DataFrame,
    fetches: DataFrame,
    pages: DataFrame,
    done: DataFrame,
    seq: str | Sequence[str] = "seq",
    force: bool = False,
    min_chars: float = MIN_CHARS_PER_PAGE,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> IngestResult:
    """Ingest every paper of ``papers(paper_id, title, pdf_url, ..., seq)``.

    Metadata is kept whatever the outcome; only papers that succeed now are chunked; papers already done report their
    stored counts.
    """
    metadata = latest_per_key(papers, "paper_id", seq)
    known = cut_lineage(known_flags(metadata, fetches, done, force))
    blocks = cut_lineage(block_spans(readable_pages(page_lengths(pages), known)))
    flags = with_gate(known, block_status(blocks, min_chars))
    judged = flags.withColumn("status", ingest_status())
    fresh = judged.where(F.col("status") == SUCCESS).select("paper_id", "title")
    fresh_blocks = blocks.join(fresh.select("paper_id"), "paper_id", "left_semi")
    pieces = chunk_pages(page_spans(pages, min_chars, fresh_blocks), size, overlap)
    chunks = with_chunk_ids(pieces.join(fresh, "paper_id"))
    log = judged.join(chunk_count(pieces), "paper_id", "left").select(
        "paper_id",
        "status",
        F.when(F.col("status") == ALREADY_CACHED, F.coalesce("stored_chunks", F.lit(0)))
        .otherwise(F.coalesce("chunk_count", F.lit(0)))
        .cast("bigint")
        .alias("chunk_count"),
        F.when(F.col("status") == ALREADY_CACHED, F.col("stored_pages"))
        .when(F.col("status") == SUCCESS, F.col("page_count"))
        .cast("bigint")
        .alias("page_count"),
        ingest_message(F.col("status"), F.col("extract_error")).alias("message"),
    )
    return IngestResult(metadata, log, chunks)


def ingest_message(status: Column, error: Column) -> Column:
    """What to tell the user, null on success."""
    return (
        F.when(status == ALREADY_CACHED, F.lit("ingested before; force a new run to redo it"))
        .when(status == NO_PDF_AVAILABLE, F.lit("the source names no PDF"))
        .when(status == DOWNLOAD_FAILED, F.lit("the PDF could not be fetched"))
        .when(status == EXTRACTION_FAILED, error)
        .when(status == SCANNED_PDF, F.lit("the PDF holds no text layer"))
    )


def new_markers(log: DataFrame) -> DataFrame:
    """Markers to append to the done table: successes only, so failures are tried again."""
    return log.where(F.col("status") == SUCCESS).select("paper_id", "chunk_count", "page_count")


def summarizable(log: DataFrame) -> DataFrame:
    return log.where(F.col("status").isin(SUCCESS, ALREADY_CACHED))
