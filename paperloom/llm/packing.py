"""Best-fit packing of tokenised documents into sequences of one length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import by_batch
from paperloom.llm.token_ids import default_path, encoder
from paperloom.session import fresh_path

SEQUENCE = 4096
#: Bins that a task holds open.
OPEN_BINS = 128
#: Tasks whose last open bins one task of the next round packs anew.
FAN_IN = 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long, done boolean"


class OpenBins:
    """A fixed number of open bins, found by their free space in a bitset.

    An item goes to the open bin that it fills best. If none has room, a new bin opens, and if all places are taken, the
    fullest closes first. A bin without free space closes at once; an item of full size is one and takes no place.
    """

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.mask, self.count, self.opened = 0, 0, 0
        self.by_free: list[list[tuple[int, list]]] = [[] for _ in range(size + 1)]

    def add(self, length: int, item) -> list[tuple[int, list]]:
        """Place the item; the bins that this closes, as their number and ``(offset, item)`` list."""
        closed = []
        fitting = self.mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number, items = self._take(free)
        else:
            if self.count == self.most and length < self.size:
                closed.append(self._take((self.mask & -self.mask).bit_length() - 1))
            free, number, items = self.size, self.opened, []
            self.opened += 1
        items.append((self.size - free, item))
        if free == length:
            closed.append((number, items))
        else:
            self.by_free[free - length].append((number, items))
            self.mask |= 1 << (free - length)
            self.count += 1
        return closed

    def rest(self) -> list[tuple[int, list]]:
        return [bin_ for bins in self.by_free for bin_ in bins]

    def _take(self, free: int) -> tuple[int, list]:
        bins = self.by_free[free]
        taken = bins.pop()
        if not bins:
            self.mask ^= 1 << free
        self.count -= 1
        return taken


def pieces(docs: DataFrame, size: int = SEQUENCE, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs(doc_id, text)``: only documents of more than ``size`` ids are cut, every ``size`` ids."""
    file = tokenizer or default_path()

    def cut(batch: pa.RecordBatch) -> dict[str, object]:
        names = iter(batch.column("doc_id").to_pylist())
        doc_ids, numbers, starts, lengths, sums, held = [], [], [], [], [], []
        for ids, counts in encoder(file).encode_all(batch.column("text")):
            ids, place = memoryview(ids.view(np.uint8)), 0
            for count in (4 * counts).tolist():
                doc_id, of = next(names), ids[place : place + count]
                place += count
                for number, start in enumerate(range(0, count, 4 * size)):
                    own = of[start : start + 4 * size]
                    doc_ids.append(doc_id)
                    numbers.append(number)
                    starts.append(start // 4)
                    lengths.append(len(own) // 4)
                    sums.append(zlib.crc32(own))
                    held.append(bytes(own) if with_ids else None)
        columns = {
            "doc_id": pa.array(doc_ids, pa.int64()),
            "piece": pa.array(numbers, pa.int32()),
            "start": pa.array(starts, pa.int64()),
            "length": pa.array(lengths, pa.int64()),
            "ids_crc32": pa.array(sums, pa.int64()),
        }
        return columns | ({"ids": pa.array(held, pa.binary())} if with_ids else {})

    return by_batch(docs.select("doc_id", "text"), cut, PIECES + ", ids binary" * with_ids)


def pack_documents(
    docs: DataFrame, size: int = SEQUENCE, open_bins: int = OPEN_BINS, tokenizer: str | None = None, with_ids: bool = False
) -> DataFrame:
    """Give every piece of ``docs(doc_id, text)`` a sequence and a place in it; ``with_ids`` keeps the ids themselves.

    Pieces are dealt out by a hash, so that every task sees a like mix of lengths and none a whole source, and packed in
    that order. Bins still open at a task's end are not closed half empty: their pieces meet those of 15 other tasks in
    the next round, until one task is left. That one holds no more than the open bins of 16 tasks.

    A null or empty text is a piece of one id. Rows that share a ``doc_id`` are packed each on its own, also where they
    are equal; a null ``doc_id`` stays null. Further columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    where = fresh_path(spark, "packed")
    schema = PLACED + ", ids binary" * with_ids
    names = [column.split()[0] for column in schema.split(", ")]
    item_names = [name for name in names if name not in ("sequence_id", "offset", "done")]

    def packed(todo: DataFrame, turn: int, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bins, task = OpenBins(size, open_bins), TaskContext.get().partitionId()

            def rows(closed: list[tuple[int, list]], done: bool) -> pa.RecordBatch:
                flat = [(number, offset, item) for number, items in closed for offset, item in items]
                columns = [pa.array([item[nth] for _, _, item in flat]) for nth in range(len(item_names))]
                columns = dict(zip(item_names, columns, strict=True))
                columns |= {
                    "doc_id": columns["doc_id"].cast(pa.int64()),
                    "piece": columns["piece"].cast(pa.int32()),
                    "sequence_id": pa.array([(turn << 56) + (task << 32) + number for number, _, _ in flat], pa.int64()),
                    "offset": pa.array([offset for _, offset, _ in flat], pa.int64()),
                    "done": pa.array([done] * len(flat), pa.bool_()),
                }
                return pa.RecordBatch.from_arrays([columns[name] for name in names], names=names)

            for batch in batches:
                closed = []
                for item in zip(*(batch.column(name).to_pylist() for name in item_names), strict=True):
                    closed += bins.add(item[3], item)
                if closed:
                    yield rows(closed, True)
            if rest := bins.rest():
                yield rows(rest, last)

        return todo.mapInArrow(run, schema)

    columns = [F.col(name) for name in item_names]
    order = [F.xxhash64("doc_id", "piece", "ids_crc32"), *(F.col(name) for name in item_names if name != "ids")]
    dealt = pieces(docs, size, tokenizer, with_ids).repartition("doc_id", "piece", "ids_crc32")
    packed(dealt.sortWithinPartitions(*order), 0, False).write.parquet(f"{where}/0")
    stored = [spark.read.schema(schema).parquet(f"{where}/0")]
    tasks = stored[0].select(F.shiftright("sequence_id", 32).alias("task")).distinct().count()
    while stored[-1].where("not done").limit(1).count():
        turn, tasks = len(stored), -(-tasks // FAN_IN)
        open_ = stored[-1].where("not done").select(*columns)
        dealt = open_.repartition(1) if tasks == 1 else open_.repartition(tasks, "doc_id", "piece", "ids_crc32")
        packed(dealt.sortWithinPartitions(*order), turn, tasks == 1).write.parquet(f"{where}/{turn}")
        stored.append(spark.read.schema(schema).parquet(f"{where}/{turn}"))
    placed = stored[0].where("done")
    for more in stored[1:]:
        placed = placed.union(more.where("done"))
    return placed.drop("done")
