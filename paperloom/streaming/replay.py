"""Feed a table to a stream, a part at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_slices(rows: DataFrame, order: str, slices: int = 3) -> list[DataFrame]:
    """``rows`` as consecutive ranges of ``order``; rows without an order come with the first.

    A few boundaries are all that reaches the driver.
    """
    numeric = rows.select(F.col(order).cast("double").alias("at"))
    bounds = numeric.approxQuantile("at", [(n + 1) / slices for n in range(slices - 1)], 0.01)
    passed = [F.coalesce(F.col(order).cast("double") > bound, F.lit(False)) for bound in bounds]
    number = reduce(lambda left, right: left + right, [p.cast("int") for p in passed], F.lit(0))
    return [rows.where(number == part) for part in range(slices)]


def replay(parts: Iterable[DataFrame], path: str, start: Callable[[DataFrame], object]) -> None:
    """Land one part after the other at ``path`` and let the stream that ``start`` opens take each of them whole.

    A part may be any number of files; a stream ends with what has landed and goes on from its checkpoint.
    """
    for part in parts:
        part.write.mode("append").parquet(path)
        start(part.sparkSession.readStream.schema(part.schema).parquet(path)).awaitTermination()
