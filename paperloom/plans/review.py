"""The whole review for many topics: search, select, ingest, summarise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.model import ModelFn
from paperloom.operators.search import check_cap, per_source_cap, restrict_sources, select_top_n
from paperloom.plans.ingest import IngestResult, ingest_papers, summarizable, with_paper_id
from paperloom.plans.search import refine_hits
from paperloom.plans.summarize import SummaryResult, summarize_papers
from paperloom.schemas import DOWNLOAD_FAILED, EXTRACTION_FAILED, LLM_FAILED, SELECTED_PAPERS, SUCCESS, ALREADY_CACHED
from paperloom.session import cut_lineage


@dataclass(frozen=True)
class ReviewResult:
    selected: DataFrame
    ingest: IngestResult
    summary: SummaryResult
    report: DataFrame
    errors: DataFrame


def literature_review(
    hits: DataFrame,
    fetches: DataFrame,
    pages: DataFrame,
    ingested: DataFrame,
    stored_chunks: DataFrame,
    summarised: DataFrame,
    summary_fn: ModelFn,
    entity_fn: ModelFn,
    max_papers: int = SELECTED_PAPERS,
    year_from: int | None = None,
    year_to: int | None = None,
    min_chars: float | None = None,
    rejects: DataFrame | None = None,
    **asking,
) -> ReviewResult:
    """Review every topic among ``hits``.

    Each source is asked for twice the wanted number, so that the selection has a choice.  Bad papers end up in
    ``errors`` and never stop the others, as do the ``rejects`` of the source mappers.  ``asking`` is for
    :func:`call_model`.
    """
    capped = per_source_cap(restrict_sources(hits), check_cap(2 * max_papers))
    selected = cut_lineage(with_paper_id(select_top_n(refine_hits(capped, year_from, year_to), max_papers)))
    limits = {} if min_chars is None else {"min_chars": min_chars}
    ingest = ingest_papers(selected, fetches, pages, ingested, seq=["selected_rank", "topic"], **limits)
    ready = summarizable(ingest.log)
    chunks = stored_chunks.join(ingest.chunks.select("paper_id").distinct(), "paper_id", "left_anti").unionByName(
        ingest.chunks.select(stored_chunks.columns)
    )
    summary = summarize_papers(ready, ingest.metadata, chunks, summarised, summary_fn, entity_fn, **asking)
    return ReviewResult(
        selected,
        ingest,
        summary,
        review_report(selected, ingest.log, summary.log),
        review_errors(ingest.log, summary.log, rejects),
    )


def review_report(selected: DataFrame, ingest_log: DataFrame, summary_log: DataFrame) -> DataFrame:
    """Per topic: papers selected, ready for a summary, summarised."""
    outcome = (
        selected.select("topic", "paper_id")
        .join(ingest_log.select("paper_id", F.col("status").alias("ingest_status")), "paper_id", "left")
        .join(summary_log.select("paper_id", F.col("status").alias("summary_status")), "paper_id", "left")
    )
    good = (SUCCESS, ALREADY_CACHED)
    return outcome.groupBy("topic").agg(
        F.count("*").alias("selected"),
        F.count_if(F.col("ingest_status").isin(*good)).alias("ingested"),
        F.count_if(F.col("summary_status").isin(*good)).alias("summarised"),
    )


def review_errors(ingest_log: DataFrame, summary_log: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """``(stage, paper_id, message)`` of everything that went wrong; a rejected search item has no paper id."""
    ingest = ingest_log.where(F.col("status").isin(DOWNLOAD_FAILED, EXTRACTION_FAILED))
    summary = summary_log.where(F.col("status") == LLM_FAILED)
    errors = ingest.select(F.lit("ingest").alias("stage"), "paper_id", "message").unionByName(
        summary.select(F.lit("summarize").alias("stage"), "paper_id", "message")
    )
    if rejects is None:
        return errors
    item = F.concat_ws(" ", "source", F.lit("item"), F.col("source_rank").cast("string"))
    return errors.unionByName(
        rejects.select(
            F.lit("search").alias("stage"),
            F.lit(None).cast("string").alias("paper_id"),
            F.concat(item, F.lit(": "), F.col("reject_reason")).alias("message"),
        )
    )
