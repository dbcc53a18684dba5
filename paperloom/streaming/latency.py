"""The running latency mean of a model over its last calls, as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from paperloom.operators.metrics import cents, mean_to_tenths
from paperloom.schemas import LATENCY_WINDOW
from paperloom.streaming.cache import ROCKSDB


class LastCalls(StatefulProcessor):
    """State of a model: the latencies of its last calls, in hundredths, oldest first."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "cents long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["ts", "request_id"])
        held = [value[0] for value in self.last.get()] if self.last.exists() else []
        every = np.concatenate([np.array(held, np.int64), calls["cents"].to_numpy(np.int64)])
        sums = np.concatenate([[0], np.cumsum(every)])
        ends = np.arange(len(held), len(every)) + 1
        starts = np.maximum(ends - self.window, 0)
        self.last.put([(int(value),) for value in every[-self.window :]])
        yield pd.DataFrame({
            "model": [key[0]] * len(calls), "request_id": calls["request_id"].to_numpy(), "sum": sums[ends] - sums[starts], "calls_tracked": ends - starts,
        })


def latency_stream(calls: DataFrame, window: int = LATENCY_WINDOW) -> DataFrame:
    """``(model, request_id, avg_latency_ms, calls_tracked)`` after every call of the stream, as :func:`latency_last_n`.

    A model's calls must come in batches that follow each other in time; within a batch they may stand in any order.
    Calls without a latency are left out. State is one list of at most ``window`` numbers for each model.
    """
    calls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = {name: calls.schema[name].dataType.simpleString() for name in ("model", "request_id")}
    timed = calls.where("latency_ms is not null").select("model", "ts", "request_id", cents("latency_ms").alias("cents"))
    found = timed.groupBy("model").transformWithStateInPandas(
        LastCalls(window), f"model {kinds['model']}, request_id {kinds['request_id']}, sum long, calls_tracked long", "Append", "None"
    )
    return found.select("model", "request_id", mean_to_tenths(F.col("sum"), F.col("calls_tracked")).alias("avg_latency_ms"), "calls_tracked")
