"""Token-id files: patched frame-of-reference blocks with an index of block starts."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import row_key
from paperloom.llm.token_ids import default_path, encoder

BLOCK = 256
LANES = 8
#: This share of a block's values decides its width; the rest are exceptions.
PERCENTILE = 0.9
#: A segment is closed at the first document end past so many ids.
SEGMENT_IDS = 1 << 17
MAGIC = b"PFR1"
HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("spare", "u1"), ("exceptions", "<u2")])
SEGMENTS = (
    "part int, segment int, first long, n_ids long, "
    "doc_ids array<long>, doc_sizes array<long>, payload binary"
)


def pack(ids: np.ndarray) -> bytes:
    """One segment: magic, number of ids, number of blocks, block starts, blocks.

    A block holds 256 ids: its minimum, the width that fits 90 % of the differences to it, those differences' low bits
    in 32 rows of 8 lanes, then the positions (1 byte) and high bits (4 bytes) of the differences that need more. The
    last block repeats its last id to be full.
    """
    count = len(ids)
    blocks = -(-count // BLOCK)
    head = MAGIC + struct.pack("<II", count, blocks)
    if not count:
        return head + struct.pack("<I", len(head) + 4)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:count], full[count:] = ids, ids[-1]
    values = full.reshape(blocks, BLOCK)
    least = values.min(axis=1)
    values = values - least[:, None]
    bits = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    widths = np.partition(bits, int(BLOCK * PERCENTILE) - 1, axis=1)[:, int(BLOCK * PERCENTILE) - 1]
    odd_block, odd_place = np.nonzero(bits > widths[:, None])
    odd = np.bincount(odd_block, minlength=blocks)
    sizes = HEAD.itemsize + widths.astype(np.int64) * (BLOCK // 8) + 5 * odd
    start = len(head) + 4 * (blocks + 1)
    starts = start + np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(starts[-1], np.uint8)
    out[:start] = np.frombuffer(head + starts.astype("<u4").tobytes(), np.uint8)
    heads = np.zeros(blocks, HEAD)
    heads["least"], heads["width"], heads["exceptions"] = least, widths, odd
    out[starts[:-1, None] + np.arange(HEAD.itemsize)] = heads.view(np.uint8).reshape(blocks, -1)
    for width in np.unique(widths):
        if width:
            of = np.flatnonzero(widths == width)
            low = values[of] & np.uint32((1 << int(width)) - 1)
            packed = _lanes_in(low, int(width)).view(np.uint8).reshape(len(of), -1)
            out[starts[of, None] + HEAD.itemsize + np.arange(packed.shape[1])] = packed
    if len(odd_block):
        nth = np.arange(len(odd_block)) - np.repeat(np.cumsum(odd) - odd, odd)
        base = (starts[:-1] + HEAD.itemsize + widths.astype(np.int64) * (BLOCK // 8))[odd_block]
        out[base + nth] = odd_place
        high = (values[odd_block, odd_place] >> widths[odd_block]).astype("<u4")
        out[(base + odd[odd_block] + 4 * nth)[:, None] + np.arange(4)] = high.view(np.uint8).reshape(-1, 4)
    return out.tobytes()


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (not included) of a segment; only the blocks that hold them are read."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token segment")
    count, blocks = struct.unpack_from("<II", payload, 4)
    last = count if last is None else min(last, count)
    if first >= last:
        return np.empty(0, np.uint32)
    low, high = first // BLOCK, -(-last // BLOCK)
    data = np.frombuffer(payload, np.uint8)
    starts = np.frombuffer(payload, "<u4", high - low, 12 + 4 * low).astype(np.int64)
    heads = data[starts[:, None] + np.arange(HEAD.itemsize)].reshape(-1).view(HEAD)
    values = np.zeros((high - low, BLOCK), np.uint32)
    widths = heads["width"].astype(np.int64)
    for width in np.unique(widths):
        if width:
            of = np.flatnonzero(widths == width)
            packed = data[starts[of, None] + HEAD.itemsize + np.arange(width * (BLOCK // 8))]
            values[of] = _lanes_out(np.ascontiguousarray(packed).view("<u4"), int(width))
    odd = heads["exceptions"].astype(np.int64)
    if odd.any():
        block = np.repeat(np.arange(high - low), odd)
        nth = np.arange(len(block)) - np.repeat(np.cumsum(odd) - odd, odd)
        base = (starts + HEAD.itemsize + widths * (BLOCK // 8))[block]
        above = data[(base + odd[block] + 4 * nth)[:, None] + np.arange(4)].reshape(-1).view("<u4")
        values[block, data[base + nth]] |= above << widths[block].astype(np.uint32)
    values += heads["least"][:, None]
    return values.reshape(-1)[first - low * BLOCK : last - low * BLOCK]


def _lanes_in(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of 8 lanes, each lane its own bit stream of 32-bit words."""
    rows = low.reshape(len(low), BLOCK // LANES, LANES)
    words = np.zeros((len(low), width, LANES), np.uint32)
    for row in range(BLOCK // LANES):
        word, shift = divmod(row * width, 32)
        words[:, word] |= rows[:, row] << np.uint32(shift)
        if shift + width > 32:
            words[:, word + 1] |= rows[:, row] >> np.uint32(32 - shift)
    return words


def _lanes_out(packed: np.ndarray, width: int) -> np.ndarray:
    words = packed.reshape(len(packed), width, LANES)
    rows = np.empty((len(packed), BLOCK // LANES, LANES), np.uint32)
    for row in range(BLOCK // LANES):
        word, shift = divmod(row * width, 32)
        value = words[:, word] >> np.uint32(shift)
        if shift + width > 32:
            value = value | words[:, word + 1] << np.uint32(32 - shift)
        rows[:, row] = value & np.uint32((1 << width) - 1)
    return rows.reshape(len(packed), BLOCK)


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encode ``docs(doc_id, text)`` and write the ids in ascending ``doc_id`` order under ``path``.

    The files are a Parquet table of segments, so that Spark commits them whole, whatever store ``path`` is in: a
    segment is one packed byte string of about 131,072 ids that ends with a document, with the ids and sizes of its
    documents. ``part`` and ``segment`` give the order, ``first`` the ids before it in its part.

    A null or empty text is the end id alone; a null ``doc_id`` sorts first; rows of one ``doc_id`` follow in the order
    of their texts' hashes. Further columns are ignored. A document never spans two segments, however long it is.
    """
    file = tokenizer or default_path()
    keys = ["doc_id", "row_key"]
    ordered = docs.select("doc_id", "text", row_key().alias("row_key"))
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("row_key")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, part = encoder(file).encode_all, TaskContext.get().partitionId()
        held, doc_ids, sizes, total, number, first = [], [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            row = (part, number, first, total, doc_ids, sizes, pack(np.concatenate(held)))
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2, pa.binary())
            names = [column.split()[0] for column in SEGMENTS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            numbers = iter(batch.column("doc_id").to_pylist())
            for ids, counts in encode_all(batch.column("text")):
                place = 0
                for size in counts.tolist():
                    held.append(ids[place : place + size])
                    doc_ids.append(next(numbers))
                    sizes.append(size)
                    total += size
                    place += size
                    if total >= SEGMENT_IDS:
                        yield closed()
                        first, number = first + total, number + 1
                        held, doc_ids, sizes, total = [], [], [], 0
        if held:
            yield closed()

    ordered.mapInArrow(segments, SEGMENTS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Every document of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    With ``with_ids`` also ``ids``, the little-endian 32-bit ids themselves. Only the number of ids of each part, one row
    a file, is summed up in one place.
    """
    stored = spark.read.schema(SEGMENTS).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    offsets = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = unpack(row["payload"]).astype("<u4", copy=False).tobytes()
                sizes = np.array(row["doc_sizes"], np.int64)
                ends = np.cumsum(sizes)
                own = [data[4 * (end - size) : 4 * end] for end, size in zip(ends, sizes, strict=True)]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["offset"] + row["first"] + ends - sizes),
                    pa.array(sizes),
                    pa.array([zlib.crc32(ids) for ids in own], pa.int64()),
                ] + [pa.array(own, pa.binary())] * with_ids
                names = [column.split()[0] for column in schema.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    # One row of 12 bytes a file, as many as the write had tasks.
    needed = stored.join(F.broadcast(offsets), "part").select("offset", "first", "doc_ids", "doc_sizes", "payload")
    return needed.mapInArrow(documents, schema)
