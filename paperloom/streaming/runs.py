"""The run report as an outer join of two streams: who asked, and what happened to the runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import fresh_path
from paperloom.streaming.metrics import _folder_writer, _start
from paperloom.streaming.replay import time_slices

_OUT = ["run_id", "asked_at", "status", "error", "ts", "event_id"]


def run_status_stream(run_events: DataFrame, asked: DataFrame, horizon: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Every question ``asked(run_id, asked_at)`` with each event of its run in the ``horizon`` up to that moment.

    ``run_events(run_id, status, error, ts, event_id)``.  A question without one comes out alone once both streams are
    ``delay`` past it.  State holds questions of that delay and events of the horizon.  Questions without a run or a
    moment are not answered, events without one belong to no question.
    """
    events = run_events.select(F.col("run_id").alias("event_run"), "status", "error", "ts", "event_id").withWatermark("ts", delay)
    questions = asked.where("run_id is not null and asked_at is not null").select("run_id", "asked_at").withWatermark("asked_at", delay)
    near = F.expr(f"run_id = event_run AND ts <= asked_at AND ts > asked_at - INTERVAL {horizon}")
    return questions.join(events, near, "left_outer").select(*_OUT)


def start_run_report(run_events: DataFrame, asked: DataFrame, root: str, horizon: str = "1 day", delay: str = "1 hour"):
    return _start(run_status_stream(run_events, asked, horizon, delay), _folder_writer(root), root, "append")


def reported_runs(spark, root: str) -> DataFrame:
    """``(run_id, asked_at, status, error, updates)`` of the questions answered so far; an unknown run counts as failed.

    A question put twice and an event told twice count once.
    """
    written = spark.read.parquet(f"{root}/out").select(*_OUT).distinct()
    known = F.when(F.col("ts").isNotNull(), F.struct("ts", "event_id"))
    latest = written.groupBy("run_id", "asked_at").agg(
        F.max_by(F.struct("status", "error"), known).alias("last"), F.count("ts").alias("updates")
    )
    found = F.col("updates") > 0
    return latest.select(
        "run_id",
        "asked_at",
        F.when(found, F.col("last.status")).otherwise(F.lit("failed")).alias("status"),
        F.when(found, F.col("last.error")).otherwise(F.lit("Unknown job_id")).alias("error"),
        "updates",
    )


def replay_run_report(run_events: DataFrame, asked: DataFrame, horizon: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """The answers after both streams came in parts of their time; a last event and question, not answered, move time on."""
    spark = run_events.sparkSession
    root = fresh_path(spark, "runs-stream")
    moments = run_events.select("run_id", F.col("ts").alias("at")).union(asked.select("run_id", "asked_at"))
    ahead = F.expr(f"max(at) + INTERVAL {delay} + INTERVAL {delay}")
    end = moments.agg(F.min("run_id").alias("run"), ahead.alias("asked_at"), (ahead + F.expr(f"INTERVAL {delay}")).alias("ts"))

    def closing(rows: DataFrame, moment: str) -> DataFrame:
        given = {"run_id": F.col("run"), moment: F.col(moment)}
        return end.select(*[given.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name) for field in rows.schema])

    parts = zip(
        [*time_slices(run_events, "ts"), closing(run_events, "ts")], [*time_slices(asked, "asked_at"), closing(asked, "asked_at")], strict=True
    )
    for part in parts:
        streams = []
        for name, rows in zip(("events", "asked"), part, strict=True):
            rows.write.mode("append").parquet(f"{root}/{name}")
            streams.append(spark.readStream.schema(rows.schema).parquet(f"{root}/{name}"))
        start_run_report(*streams, root, horizon, delay).awaitTermination()
    return reported_runs(spark, root).join(asked.select("run_id", "asked_at"), ["run_id", "asked_at"], "left_semi")
