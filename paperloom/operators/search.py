"""Merging, limiting, filtering and ordering search hits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions.text import present
from paperloom.schemas import MAX_SOURCE_CAP, PER_SOURCE_CAP, SELECTED_PAPERS, SOURCES


def check_topic(topic: str) -> str:
    if not 2 <= len(topic) <= 300:
        raise ValueError("a topic has 2 to 300 characters")
    return topic


def check_cap(cap: int | None) -> int:
    """Null or zero means the default; anything else must lie in the allowed range."""
    cap = cap or PER_SOURCE_CAP
    if not 1 <= cap <= MAX_SOURCE_CAP:
        raise ValueError(f"max_results must lie between 1 and {MAX_SOURCE_CAP}")
    return cap


def check_years(year_from: int | None, year_to: int | None) -> None:
    for year in (year_from, year_to):
        if year is not None and not 1900 <= year <= 2100:
            raise ValueError("years must lie between 1900 and 2100")


def merge_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate normalised sources; list order is carried by ``source_pos`` and ``source_rank``."""
    return reduce(DataFrame.unionByName, frames)


def restrict_sources(papers: DataFrame, sources: Sequence[str] | None = None) -> DataFrame:
    """Keep the asked sources (all when none are named) and number them in the asked order."""
    active = list(sources) if sources else list(SOURCES)
    unknown = set(active) - set(SOURCES)
    if unknown:
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    names = F.array(*[F.lit(name) for name in active])
    return papers.where(F.col("source").isin(active)).withColumn(
        "source_pos", (F.array_position(names, F.col("source")) - 1).cast("int")
    )


def per_source_cap(papers: DataFrame, cap: int | None = None, by: Sequence[str] = ("topic",)) -> DataFrame:
    """The first ``cap`` hits of every source, per topic.  Ranks beyond the cap are cut before the shuffle."""
    best = W.partitionBy(*by, "source").orderBy("source_rank")
    ranked = papers.withColumn("_position", F.row_number().over(best))
    return ranked.where(F.col("_position") <= check_cap(cap)).drop("_position")


def year_filter(papers: DataFrame, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """Inclusive year range; once a bound is given, undated papers are out."""
    year = F.year("published_date")
    if year_from is not None:
        papers = papers.where(year >= year_from)
    if year_to is not None:
        papers = papers.where(year <= year_to)
    return papers


def recency_keys() -> list[Column]:
    """Newest first, undated last, ties in merge order."""
    return [F.col("published_date").desc_nulls_last(), F.col("source_pos").asc(), F.col("source_rank").asc()]


def recency_sort(papers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return papers.orderBy(*by, *recency_keys())


def select_top_n(papers: DataFrame, n: int = SELECTED_PAPERS, by: Sequence[str] = ("topic",)) -> DataFrame:
    """Per topic, papers with a PDF first, then by recency; ``selected_rank`` starts at 1."""
    order = [present(F.col("pdf_url")).desc(), *recency_keys()]
    ranked = papers.withColumn("selected_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("selected_rank") <= n)


def search_totals(papers: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    """Number of results per topic."""
    return papers.groupBy(*by).agg(F.count("*").alias("results"))
