"""Streaming forms of the request metrics.

Sinks are folders per micro-batch written in overwrite mode, so a repeated batch replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.metrics import endpoint_counts, rate_limit_audit
from paperloom.operators.store import latest_per_key
from paperloom.schemas import CACHE_TTL_SECONDS, LATENCY_WINDOW
from paperloom.session import fresh_path
from paperloom.streaming.cache import passing_searches
from paperloom.streaming.latency import latency_stream
from paperloom.streaming.replay import replay, time_slices


def _start(result: DataFrame, write, root: str, mode: str):
    return (
        result.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def _folder_writer(root: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    return write


def start_endpoint_counts(requests: DataFrame, root: str):
    """Running totals per endpoint; every batch writes the totals that changed."""
    return _start(endpoint_counts(requests), _folder_writer(root), root, "update")


def start_rate_limit_audit(requests: DataFrame, root: str, limit: Column | None = None, delay: str = "1 hour"):
    """Hourly counts per client and endpoint; hours older than ``delay`` behind the newest request are closed."""
    audit = rate_limit_audit(requests.withWatermark("ts", delay), limit)
    return _start(audit, _folder_writer(root), root, "update")


def latest_output(spark, root: str, keys: list[str]) -> DataFrame:
    """The newest written row per key."""
    written = spark.read.parquet(f"{root}/out")
    return latest_per_key(written.withColumn("_key", F.struct(*keys)), "_key", "batch_id").drop("_key", "batch_id")


def start_ttl_dedupe(searches: DataFrame, root: str, ttl_seconds: int = CACHE_TTL_SECONDS, keep: str | None = None):
    """Pass a search unless the same one passed less than ``ttl_seconds`` before; searches may arrive in any order.

    Every batch writes the answers that changed; see :func:`passing_searches`.
    """
    return _start(passing_searches(searches, ttl_seconds, keep), _folder_writer(root), root, "update")


def replay_counts(requests: DataFrame) -> DataFrame:
    spark = requests.sparkSession
    root = fresh_path(spark, "counts-stream")
    replay(time_slices(requests, "ts"), f"{root}/landing", lambda stream: start_endpoint_counts(stream, root))
    return latest_output(spark, root, ["endpoint"])


def replay_rate_limits(requests: DataFrame, limit: Column | None = None) -> DataFrame:
    spark = requests.sparkSession
    root = fresh_path(spark, "limits-stream")
    replay(time_slices(requests, "ts"), f"{root}/landing", lambda stream: start_rate_limit_audit(stream, root, limit))
    return latest_output(spark, root, ["hour", "client", "endpoint"])


def replay_ttl_dedupe(
    searches: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS, parts: int = 3, keep: str | None = None
) -> DataFrame:
    """The passing searches after a stream took ``searches`` in ``parts`` that have nothing to do with time."""
    spark = searches.sparkSession
    root = fresh_path(spark, "ttl-stream")
    part = F.pmod(F.xxhash64("cache_key", "asked_us"), F.lit(parts))
    slices = [searches.where(part == number) for number in range(parts)]
    replay(slices, f"{root}/landing", lambda stream: start_ttl_dedupe(stream, root, ttl_seconds, keep))
    return latest_output(spark, root, ["cache_key", "asked_us"]).where("passes").select("cache_key", "asked_us")


def start_latency(calls: DataFrame, root: str, window: int = LATENCY_WINDOW):
    """Running means of the last calls; every batch writes a row for each of its calls."""
    return _start(latency_stream(calls, window), _folder_writer(root), root, "append")


def replay_latency(calls: DataFrame, window: int = LATENCY_WINDOW) -> DataFrame:
    spark = calls.sparkSession
    root = fresh_path(spark, "latency-stream")
    replay(time_slices(calls, "ts"), f"{root}/landing", lambda stream: start_latency(stream, root, window))
    return spark.read.parquet(f"{root}/out").drop("batch_id")
