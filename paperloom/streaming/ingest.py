"""Incremental ingest of arriving papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.store import latest_per_key
from paperloom.operators.tables import BUCKET_ROWS, BucketFolders
from paperloom.plans.ingest import ingest_papers, new_markers
from paperloom.schemas import ALREADY_CACHED
from paperloom.session import cut_lineage, fresh_path
from paperloom.streaming.replay import replay

MARKER = "paper_id string, chunk_count bigint, page_count bigint"


def store_markers(markers: DataFrame, layout: BucketFolders, root: str, batch_id: int) -> None:
    """Markers of a batch, in the buckets of its papers; a repeated batch replaces its own."""
    placed = markers.select("paper_id", "chunk_count", "page_count", layout.bucket().alias("bucket"))
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/markers/batch_id={batch_id}")


def stored_markers(papers: DataFrame, layout: BucketFolders, root: str, before_batch: int) -> DataFrame:
    """Markers of ``papers`` that earlier batches wrote, read from the buckets of these papers only.

    The schema is given because a batch may have had no success.
    """
    # Bucket numbers, at most as many as the pages have.
    numbers = [row[0] for row in papers.select(layout.bucket()).distinct().collect()]
    written = papers.sparkSession.read.schema(f"{MARKER}, batch_id bigint, bucket int").parquet(f"{root}/markers")
    return written.where((F.col("batch_id") < before_batch) & F.col("bucket").isin(numbers)).drop("batch_id", "bucket")


def _read(limits: dict) -> list[str]:
    """The columns of papers that an ingest reads, short of the metadata, which the stream does not keep."""
    seq = limits.get("seq", "seq")
    return list(dict.fromkeys(["paper_id", "title", "pdf_url", *([seq] if isinstance(seq, str) else seq)]))


def start_ingest(arrivals: DataFrame, fetches: DataFrame, pages: BucketFolders, root: str, **limits):
    """Run :func:`ingest_papers` on every micro-batch of the stream ``arrivals`` and return the running query.

    ``pages`` are laid out by paper, and markers as they are, so that a batch reads the buckets of its own papers and no
    others. Each batch writes its log, chunks and markers under its own ``batch_id`` folder in overwrite mode, so a batch
    that is repeated after a failure replaces itself.  Papers ingested by an earlier batch, but not by an earlier attempt
    at the same batch, count as done; markers from before the stream are those of batch -1.
    """

    def ingest_batch(batch: DataFrame, batch_id: int) -> None:
        asked = cut_lineage(batch.select(*_read(limits)))
        # Pages of other papers in these buckets are left out by the joins of the ingest.
        own = pages.around(asked.where(F.col("paper_id").isNotNull())).drop("bucket")
        done = stored_markers(asked, pages, root, batch_id)
        result = ingest_papers(asked, fetches, own, done, **limits)
        for name, frame in (("log", result.log), ("chunks", result.chunks)):
            frame.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")
        store_markers(new_markers(asked.sparkSession.read.parquet(f"{root}/log/batch_id={batch_id}")), pages, root, batch_id)

    return (
        arrivals.writeStream.foreachBatch(ingest_batch)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def ingest_log(spark: SparkSession, root: str) -> DataFrame:
    """First outcome per paper that was not a mere repeat, else the repeat."""
    log = spark.read.parquet(f"{root}/log")
    ranked = log.withColumn(
        "_rank", F.struct((F.col("status") != ALREADY_CACHED).alias("fresh"), F.col("batch_id").alias("batch"))
    )
    return latest_per_key(ranked, "paper_id", "_rank").drop("_rank")


def replay_ingest(
    papers: DataFrame, fetches: DataFrame, pages: DataFrame, markers: DataFrame, batches: int = 2, bucket_rows: int = BUCKET_ROWS, **limits
) -> DataFrame:
    """Feed ``papers`` through the stream in ``batches`` parts and return the combined log."""
    spark = papers.sparkSession
    root = fresh_path(spark, "ingest-stream")
    laid_out = BucketFolders.create(pages, f"{root}/pages", ["paper_id"], bucket_rows)
    store_markers(markers, laid_out, root, -1)
    part = F.pmod(F.xxhash64("paper_id"), F.lit(batches))
    parts = [papers.where(part == number).select(*_read(limits)) for number in range(batches)]
    replay(parts, f"{root}/landing", lambda arrivals: start_ingest(arrivals, fetches, laid_out, root, **limits))
    return ingest_log(spark, root)
