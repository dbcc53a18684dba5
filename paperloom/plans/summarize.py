"""Summaries: skip what is done, prompt, call, validate, build cards, extract entities, index the graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.graph import edges_from_papers
from paperloom.operators.model import (
    ModelFn,
    call_model,
    entity_prompt,
    parse_entities,
    parse_responses,
    summary_cards,
    summary_prompt,
)
from paperloom.operators.store import chunk_rows, first_chunks
from paperloom.schemas import (
    ALREADY_CACHED,
    ENTITY_CHUNKS,
    LLM_FAILED,
    NO_CHUNKS_AVAILABLE,
    NOT_INGESTED,
    SUCCESS,
    SUMMARY_CHUNKS,
)
from paperloom.session import cut_lineage


@dataclass(frozen=True)
class SummaryResult:
    """``log``: one status row per asked paper.  ``cards``: new cards; ``all_cards``: with the stored ones of asked papers.

    ``entities`` and ``edges``: for the graph.
    """

    log: DataFrame
    cards: DataFrame
    all_cards: DataFrame
    entities: DataFrame
    edges: DataFrame


def prompts_for(papers: DataFrame, chunks: DataFrame, build, limit: int) -> DataFrame:
    """``(paper_id, prompt)`` for papers that have chunks; chunks of other papers are dropped before they are grouped."""
    titles = papers.select("paper_id", "title")
    wanted = chunk_rows(chunks, limit).join(titles.select("paper_id"), "paper_id", "left_semi")
    return first_chunks(wanted, limit).join(titles, "paper_id").select(
        "paper_id", build(F.col("title"), F.col("chunks")).alias("prompt")
    )


def summary_status() -> Column:
    """First match wins over ``done, known, has_chunks, ok``."""
    return (
        F.when(F.col("done"), F.lit(ALREADY_CACHED))
        .when(~F.col("known"), F.lit(NOT_INGESTED))
        .when(~F.col("has_chunks"), F.lit(NO_CHUNKS_AVAILABLE))
        .when(~F.coalesce("ok", F.lit(False)), F.lit(LLM_FAILED))
        .otherwise(F.lit(SUCCESS))
    )


def _flag(frame: DataFrame, name: str) -> DataFrame:
    return frame.select("paper_id").distinct().withColumn(name, F.lit(True))


def summarize_papers(
    asked: DataFrame,
    papers: DataFrame,
    chunks: DataFrame,
    done: DataFrame,
    summary_fn: ModelFn,
    entity_fn: ModelFn,
    force: bool = False,
    **asking,
) -> SummaryResult:
    """Summarise every ``asked(paper_id)``.

    ``papers`` is the metadata table, ``chunks`` the chunk table, ``done`` the stored cards.  Papers summarised before
    are still indexed in the graph; indexing cannot change a summary's outcome.  ``asking`` is for :func:`call_model`.
    """
    asked = asked.select("paper_id").distinct()
    if force:
        done = done.where(F.lit(False))
    flags = asked
    for frame, name in ((done, "done"), (papers, "known"), (chunks.where(F.col("chunk_index") == 0), "has_chunks")):
        flags = flags.join(_flag(frame.join(asked, "paper_id", "left_semi"), name), "paper_id", "left")
    # Read by the prompts, the log and the graph step.
    flags = cut_lineage(flags.fillna(False, ["done", "known", "has_chunks"]))
    todo = flags.where(~F.col("done") & F.col("known") & F.col("has_chunks")).select("paper_id")

    wanted = papers.join(todo, "paper_id", "left_semi")
    responses = call_model(prompts_for(wanted, chunks, summary_prompt, SUMMARY_CHUNKS), summary_fn, ["paper_id"], **asking)
    parsed = parse_responses(responses)
    log = flags.join(parsed.select("paper_id", "ok", "message"), "paper_id", "left").select(
        "paper_id", summary_status().alias("status"), "message"
    )
    cards = summary_cards(parsed, papers)
    stored = done.select([name for name in done.columns if name in cards.columns]).join(asked, "paper_id", "left_semi")
    all_cards = cards.unionByName(stored, allowMissingColumns=True)

    indexed = flags.where("done").select("paper_id").unionByName(cards.select("paper_id"))
    graph_papers = papers.join(indexed, "paper_id", "left_semi")
    entity_responses = call_model(prompts_for(graph_papers, chunks, entity_prompt, ENTITY_CHUNKS), entity_fn, ["paper_id"], **asking)
    empty = F.array().cast("array<string>")
    entities = graph_papers.select("paper_id", "authors").join(parse_entities(entity_responses), "paper_id", "left").select(
        "paper_id",
        "authors",
        F.coalesce("methods", empty).alias("methods"),
        F.coalesce("datasets", empty).alias("datasets"),
    )
    return SummaryResult(log, cards, all_cards, entities, edges_from_papers(entities))
