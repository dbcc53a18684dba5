"""Keyed tables: replace, latest-wins, skip-if-done, cached results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions.chunking import chunk_id
from paperloom.functions.text import strip
from paperloom.schemas import CACHE_TTL_SECONDS
from paperloom.session import cut_lineage

def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", chunk_id(F.col("paper_id"), F.col("chunk_index")))


def upsert_chunks(current: DataFrame, new: DataFrame) -> DataFrame:
    """Replace all chunks of every paper that has new ones; a paper without new chunks keeps its old ones."""
    replaced = new.select("paper_id").distinct()
    return current.join(replaced, "paper_id", "left_anti").unionByName(new)


def chunk_rows(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunk rows of every paper, the first ``limit`` of them in document order (null: all, zero: none).

    Stored indexes are dense from 0, so the limit is a plain filter that reaches the scan.
    """
    return chunks if limit is None else chunks.where(F.col("chunk_index") < limit)


def first_chunks(chunks: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` chunks of every paper as one array."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "text")))
    texts = F.transform(ordered, lambda chunk: chunk["text"])
    return chunk_rows(chunks, limit).groupBy("paper_id").agg(texts.alias("chunks"))


def chunk_count(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("paper_id").agg(F.count("*").alias("chunk_count"))


def latest_per_key(writes: DataFrame, key: str, seq: str | Sequence[str]) -> DataFrame:
    """Last write per key by ``seq``; later nulls overwrite.  Losing rows are cut before the shuffle."""
    order = [seq] if isinstance(seq, str) else seq
    newest = W.partitionBy(key).orderBy(*[F.col(name).desc() for name in order])
    return writes.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") == 1).drop("_nth")


def split_done(
    papers: DataFrame, done: DataFrame, key: str = "paper_id", force: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(still to do, already done with the stored record)``.

    Records flagged in an optional ``_corrupt`` column count as absent; ``force`` redoes everything.
    """
    if "_corrupt" in done.columns:
        done = done.where(F.col("_corrupt").isNull()).drop("_corrupt")
    if force:
        done = done.where(F.lit(False))
    return papers.join(done.select(key), key, "left_anti"), papers.join(done, key)


def cache_key(topic: Column, sources: Column, cap: Column, year_from: Column, year_to: Column) -> Column:
    """Digest of a search: topic regardless of case and outer white space, sources regardless of order."""

    def shown(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("None"))

    plain = F.concat_ws(
        "|",
        strip(F.lower(topic)),
        F.array_join(F.sort_array(sources), ","),
        shown(cap),
        shown(year_from),
        shown(year_to),
    )
    return F.sha2(plain, 256)


def cache_lookup(
    requests: DataFrame, entries: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS, tie: Sequence[str] = ()
) -> DataFrame:
    """Adds ``hit`` and the answering entry's remaining columns, null on a miss, to ``requests(cache_key, asked_at, ...)``.

    ``entries(cache_key, created_at, ...)`` holds every write; the last one at or before the request answers it, of several
    at one moment the greatest in the columns ``tie``.  An entry is valid for ``ttl_seconds`` from its write, reading does
    not extend it, and an empty result is still a hit.

    Requests and writes are range-partitioned by key and time, so a key may have any share of them; each part of a key's
    history starts with the last entry of the parts before.
    """
    asked = requests.select("cache_key", F.col("asked_at").alias("_at"), F.lit(True).alias("_asked"), F.struct("*").alias("_request"))
    written = entries.where("cache_key is not null and created_at is not null").select(
        "cache_key",
        F.col("created_at").alias("_at"),
        F.lit(False).alias("_asked"),
        F.struct(*[name for name in entries.columns if name != "cache_key"]).alias("_entry"),
    )
    mixed = asked.unionByName(written, allowMissingColumns=True)
    order = [F.col("_at"), F.col("_asked"), *[F.col(f"_entry.{name}") for name in tie]]
    placed = cut_lineage(mixed.repartitionByRange("cache_key", *order).withColumn("_part", F.spark_partition_id()))
    # Only a key that goes on in the next part has an entry to carry there.
    parts = placed.groupBy("cache_key", "_part").agg(
        F.max_by("_entry", F.when(~F.col("_asked"), F.struct(*order))).alias("_entry")
    )
    before = W.partitionBy("cache_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select(
        "cache_key", "_part", F.last("_entry", ignorenulls=True).over(before).alias("_carried")
    ).where("_carried is not null")
    within = W.partitionBy("cache_key", "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    seen = placed.withColumn("_seen", F.last("_entry", ignorenulls=True).over(within)).where("_asked")
    found = seen.join(carried, ["cache_key", "_part"], "left").select(
        "_request", F.coalesce("_seen", "_carried").alias("_entry")
    )
    expires = F.col("_entry.created_at") + F.make_interval(secs=F.lit(ttl_seconds))
    judged = found.withColumn("hit", F.coalesce(expires > F.col("_request.asked_at"), F.lit(False)))
    answer = [
        F.when(F.col("hit"), F.col(f"_entry.{name}")).alias(name) for name in entries.columns if name != "cache_key"
    ]
    return judged.select("_request.*", *answer, "hit")
