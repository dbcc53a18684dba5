"""Result-page projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.citation import byline, source_label


def summary_with_paper(summaries: DataFrame, papers: DataFrame) -> DataFrame:
    """Summaries with the heading of their paper."""
    heading = papers.select(
        "paper_id",
        "title",
        source_label(F.col("source")).alias("source_label"),
        byline(F.col("authors")).alias("byline"),
    )
    return summaries.join(heading, "paper_id")
