"""What several operators of this folder share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import configure, cut_lineage

#: Rows in an Arrow batch: texts of a few kilobytes make batches of some megabytes.
BATCH_ROWS = 2_000
#: Bytes in a batch where the texts are long: both sides of a task hold a batch several times over.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def by_batch(df: DataFrame, rows_of: Callable[[pa.RecordBatch], dict[str, object]], schema: str) -> DataFrame:
    """Map every Arrow batch to the columns that ``rows_of`` returns for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = rows_of(batch)
                yield pa.RecordBatch.from_arrays([as_array(column) for column in columns.values()], names=list(columns))

    return df.mapInArrow(run, schema)


def kinds_of(df: DataFrame, names: Sequence[str]) -> str:
    """The columns ``names`` as the end of a schema."""
    return "".join(f", {name} {df.schema[name].dataType.simpleString()}" for name in names)


def as_array(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; a null text is empty."""
    return [data or b"" for data in batch.column(name).cast(pa.binary()).to_pylist()]


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive runs of ``values`` as lists."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return values ^ (values >> np.uint64(32))


def give_back() -> None:
    """Return freed memory to the system: a worker's allocators keep it otherwise, and workers outlive a stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc
        trim(0)


class Remembered(dict):
    """Values computed for keys that return, kept from task to task; emptied when it holds ``most`` of them.

    Python workers outlive a stage, so a worker that starts on values of another ``kind`` empties those of all others: it
    holds what its present work needs, not that of every stage it has seen, and gives back the rest.
    """

    _made: ClassVar[list[Remembered]] = []
    _filled: ClassVar[str | None] = None

    def __init__(self, kind: str, compute: Callable, most: int):
        super().__init__()
        self.kind, self.compute, self.most = kind, compute, most
        Remembered._made.append(self)

    def claim(self) -> None:
        """Empty the memories of other kinds."""
        if Remembered._filled != self.kind:
            for other in Remembered._made:
                if other.kind != self.kind:
                    other.clear()
            Remembered._filled = self.kind
            give_back()

    def __missing__(self, key):
        self.claim()
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


#: One memory for all operators that hash words: the values are the same.
_word_hashes = Remembered("word hashes", _word_hash, 100_000)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for every run of ``width`` values."""
    count = len(hashes) - width + 1
    if count <= 0:
        return hashes[:0]
    with np.errstate(over="ignore"):
        total = mix(hashes[:count] + np.uint64(width))
        for place in range(1, width):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[place : place + count])
    return total


def row_key() -> F.Column:
    """Tells the rows of one ``doc_id`` apart by their text; equal rows share it, and every result as well."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node reachable over undirected ``links(a, b)``, for every node in a link.

    Alternates "larger neighbours to the smallest" and "smaller neighbours to the smallest" until a round changes
    nothing, a logarithmic number of rounds in practice. Every round is two aggregates over the remaining links and one
    written table; no neighbour list is ever collected, so a node may hold any share of the links.
    """

    def star(edges: DataFrame, only_smaller: bool) -> DataFrame:
        """Link the neighbours of ``a`` (those above it, or those below it and itself) to its smallest."""
        least = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        kept = edges.where("b < a") if only_smaller else edges.where("b > a")
        moved = kept.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        if only_smaller:
            moved = moved.union(least.select("a", F.col("low").alias("b")))
        return moved.where("a <> b").distinct()

    def both_ways(edges: DataFrame) -> DataFrame:
        return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, before = cut_lineage(down), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        large = star(both_ways(edges), only_smaller=False)
        edges = cut_lineage(star(large, only_smaller=True))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
