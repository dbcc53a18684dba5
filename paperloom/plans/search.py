"""Search: map, cap, merge, dedupe, filter by year, order by recency, answer from the cache; many topics in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.dedupe import dedupe_papers
from paperloom.operators.metrics import MICROS, ttl_dedupe
from paperloom.operators.search import (
    check_cap,
    check_years,
    merge_sources,
    per_source_cap,
    recency_sort,
    restrict_sources,
    year_filter,
)
from paperloom.operators.store import cache_key, cache_lookup
from paperloom.schemas import CACHE_TTL_SECONDS, SOURCES
from paperloom.session import cut_lineage
from paperloom.sources.payloads import MAPPERS, accepted


def refine_hits(
    hits: DataFrame, year_from: int | None = None, year_to: int | None = None, topic: str = "topic"
) -> DataFrame:
    """Everything after the sources have answered.

    The year filter stays above the dedupe: an out-of-range winner still removes its in-range copies.
    """
    check_years(year_from, year_to)
    return year_filter(dedupe_papers(hits, scope=topic), year_from, year_to)


def search_papers(
    hits: DataFrame,
    max_results: int | None = None,
    sources: Sequence[str] | None = None,
    year_from: int | None = None,
    year_to: int | None = None,
    topic: str = "topic",
) -> DataFrame:
    """Search results for every topic among the landed ``hits``, each topic newest first.

    The hits within the cap are stored before they are used: the dedupe and the sort read them several times, and what
    leads to them, such as the parsing of payloads, is work on all hits.
    """
    capped = cut_lineage(per_source_cap(restrict_sources(hits, sources), check_cap(max_results), by=[topic]))
    return recency_sort(refine_hits(capped, year_from, year_to, topic), by=[topic])


def landed_papers(landed: Mapping[str, DataFrame]) -> DataFrame:
    """Usable hits of the landed payloads by source."""
    return merge_sources([accepted(MAPPERS[source](rows)) for source, rows in landed.items()])


def with_cache_key(
    asked: DataFrame,
    max_results: int | None = None,
    sources: Sequence[str] | None = None,
    year_from: int | None = None,
    year_to: int | None = None,
) -> DataFrame:
    """Adds the ``cache_key`` of a search for ``topic`` with these arguments."""
    names = F.array(*[F.lit(name) for name in (sources or SOURCES)])
    years = [F.lit(year).cast("int") for year in (year_from, year_to)]
    return asked.withColumn("cache_key", cache_key(F.col("topic"), names, F.lit(check_cap(max_results)), *years))


@dataclass(frozen=True)
class SearchAnswers:
    """``results``: the papers of every request.  ``entries`` and ``stored``: rows to append to the two cache tables."""

    results: DataFrame
    entries: DataFrame
    stored: DataFrame


def search_with_cache(
    requests: DataFrame,
    hits: DataFrame,
    entries: DataFrame,
    stored: DataFrame,
    ttl_seconds: int = CACHE_TTL_SECONDS,
    **search,
) -> SearchAnswers:
    """Answer ``requests(topic, asked_at, ...)`` from the cache, and search for what it does not hold.

    The cache is two tables: ``entries(cache_key, created_at)``, a row per stored search, and
    ``stored(cache_key, created_at, <paper columns>)``, its papers, if any.  Of the requests that no entry answers, those
    that pass :func:`ttl_dedupe` are searched and stored at their time; they answer the others.  Only topics searched for
    are read from ``hits``.  ``search`` goes to :func:`search_papers`.
    """
    asked = cut_lineage(with_cache_key(requests, **search))
    missed = cache_lookup(asked, entries.select("cache_key", "created_at"), ttl_seconds).where(~F.col("hit"))
    moments = cut_lineage(missed.select("cache_key", F.unix_micros("asked_at").alias("asked_us"), "topic"))
    passed = ttl_dedupe(moments.select("cache_key", "asked_us"), ttl_seconds)
    # Spellings of one topic share a key; the first in order is searched.
    fresh = cut_lineage(
        passed.join(moments, ["cache_key", "asked_us"])
        .groupBy("cache_key", "asked_us")
        .agg(F.min("topic").alias("topic"))
        .select("cache_key", F.timestamp_micros("asked_us").alias("created_at"), "topic")
    )
    wanted = fresh.select("topic").distinct()
    found = search_papers(hits.join(wanted, "topic", "left_semi"), **search)
    new = cut_lineage(found.join(fresh, "topic"))
    new_entries = fresh.drop("topic")
    answered = cache_lookup(asked, entries.select("cache_key", "created_at").unionByName(new_entries), ttl_seconds)
    papers = [name for name in new.columns if name not in ("cache_key", "created_at", "topic")]
    known = stored.select([name for name in stored.columns if name != "topic"]).unionByName(
        new.drop("topic"), allowMissingColumns=True
    )
    keep = [name for name in requests.columns if name not in papers]
    results = answered.select("cache_key", "created_at", *keep).join(known, ["cache_key", "created_at"])
    return SearchAnswers(results.select(*keep, "created_at", *papers), new_entries, new.drop("topic"))
