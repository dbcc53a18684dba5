"""Similarity join of documents on word n-grams: PartEnum signatures, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import by_batch, give_back, mix, rolled, smallest_reachable, texts, word_hashes
from paperloom.session import cut_lineage

WORDS = 3
PERCENT = 90
#: Elements of the sets that a worker keeps while it checks pairs.
KEPT_ELEMENTS = 2_000_000
#: Signatures that a task packs at a time, rows of packed ones in an Arrow batch, buckets for each shuffle partition.
HELD_SIGNATURES = 500_000
PACKED_ROWS = 256
BUCKETS = 8
#: Members of a signature that a block holds on average, and pairs that a task compares at a time.
BLOCK_MEMBERS = 1024
PAIRS_AT_A_TIME = 250_000
#: Nearest partners that a member names in the first round of pairs, and how many times more in each further one.
NEAREST = 4
FURTHER = 64
SKETCH_SALT = 0x5851F42D4C957F2D


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word n-grams, ASCII letters in lower case."""
    hashes = word_hashes(text.lower().split())
    return np.unique(rolled(hashes, min(words, len(hashes)))) if len(hashes) else hashes


def set_digest(elements: np.ndarray) -> bytes | None:
    """128 bits that equal sets share; none for the empty set."""
    import xxhash

    return xxhash.xxh3_128_digest(elements.tobytes()) if len(elements) else None


def odd_sketch(elements: np.ndarray) -> bytes:
    """A bit for each of ``2 ** n`` cells, at least two per element and 64 in all: whether it holds an odd number of elements."""
    bits = 64
    while bits < 2 * len(elements):
        bits *= 2
    cell = mix(elements ^ np.uint64(SKETCH_SALT)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(cell.astype(np.int64), minlength=bits) & 1).tobytes()


def least_differences(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """At most the number of elements that only one of two sets has, for every row of sketches of equal sizes: each cell
    with an odd number of such elements differs. The larger sketch is folded to the cells of the smaller."""
    if one.shape[1] > other.shape[1]:
        one, other = other, one
    folded = np.bitwise_xor.reduce(other.reshape(len(one), -1, one.shape[1]), axis=1)
    return np.bitwise_count(one ^ folded).sum(axis=1, dtype=np.int64)


class PartEnum:
    """Signatures such that two sets of Jaccard similarity ``percent`` or more share one.

    Sizes fall into bands whose largest is at most 1 / similarity times the smallest, so such a pair lies in one band or
    in neighbours; a set makes signatures for its own band and for the next. Within a band the sets differ in at most
    ``k`` elements; where that is none, the whole set is the signature. Else the feature domain is split by a hash into
    ``ceil((k + 1) / 2)`` parts, one of which holds at most one of the differences, and each part into cells: leaving out
    one cell in turn, one subset of the others is the same in both sets. Its hash is the signature.

    Subsets of few elements would be shared by strangers. With ``spare`` further parts a similar pair agrees on that many
    more parts, so a set does without subsets of fewer elements than a number of its own, chosen such that at most
    ``spare`` of its parts have one. Of the parts on which a pair agrees, one at least is then whole in the set of the
    larger number; what is the same in both there has as many elements, and so is kept by both.
    """

    LEFT_OUT = 1

    def __init__(self, percent: int):
        self.likeness = Fraction(percent, 100)
        # The looser the threshold, the more and smaller the parts: fewer cells in each keep the signatures few.
        self.split = 3 if percent >= 90 else 2
        self.tops = [1]
        self.subsets = [np.array(own) for own in combinations(range(self.split), self.split - self.LEFT_OUT)]

    def band(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, int((self.tops[-1] + 1) / self.likeness)))
        low, high = 0, len(self.tops) - 1
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.tops[middle] >= size else (middle + 1, high)
        return low

    def parts(self, band: int) -> tuple[int, int]:
        """First-level parts of a band, none where equal sets alone are similar enough, and how many of them are spare."""
        while len(self.tops) <= band:
            self.band(self.tops[-1] + 1)
        differences = int(2 * (1 - self.likeness) / (1 + self.likeness) * self.tops[band])
        if not differences:
            return 0, 0
        parts = -(-(differences + 1) // (self.LEFT_OUT + 1))
        spare = 1 + parts // (40 if self.split == 3 else 3)
        return parts + spare, spare

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        if not len(elements):
            return elements
        own = self.band(len(elements))
        spread = mix(elements)
        return np.concatenate([self._of_band(spread, band) for band in (own, own + 1)])

    def _of_band(self, spread: np.ndarray, band: int) -> np.ndarray:
        parts, spare = self.parts(band)
        start = np.uint64(band << 32)
        with np.errstate(over="ignore"):
            if not parts:
                return mix(spread.sum(keepdims=True) + start)
            cells = parts * self.split
            cell = ((spread >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
            order = np.argsort(cell, kind="stable")
            ends = np.searchsorted(cell[order], np.arange(cells + 1, dtype=np.uint64))
            running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread[order], dtype=np.uint64)))
            held = np.diff(ends).reshape(parts, self.split)
            sums = (running[ends[1:]] - running[ends[:-1]]).reshape(parts, self.split)
            sums = mix(sums + np.arange(1, self.split + 1, dtype=np.uint64))
            label = mix(np.arange(parts, dtype=np.uint64) + start)
            made = [mix(sums[:, own].sum(axis=1) + label + np.uint64(own[0] * 3 + own[-1])) for own in self.subsets]
        elements = [held[:, own].sum(axis=1) for own in self.subsets]
        least = np.sort(np.minimum.reduce(elements))[spare]
        return np.concatenate([own[number >= least] for own, number in zip(made, elements, strict=True)])


def _packed(entries: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[dict[str, object]]:
    """A row per bucket of the ``(signatures, doc_ids)`` of some texts.

    Only the smallest document of a signature goes to the signature's bucket, so that a signature of any share of the
    documents brings there an entry per call. The others already know that they share it: they are dealt evenly.
    """
    values, doc_ids = (np.concatenate(part) for part in zip(*entries, strict=True))
    if not len(values):
        return
    order = np.lexsort((doc_ids, values))
    values, doc_ids = values[order], doc_ids[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc_ids[1:] != doc_ids[:-1])
    values, doc_ids = values[new], doc_ids[new]
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    group = np.cumsum(first) - 1
    leaders = doc_ids[first][group]
    shared = (np.bincount(group) > 1)[group]
    route = np.where(first, values, mix(values ^ mix(doc_ids.astype(np.uint64))))
    bucket = ((route >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((~first, bucket))
    values, doc_ids, leaders, shared, first, bucket = (x[order] for x in (values, doc_ids, leaders, shared, first, bucket))
    base = int(doc_ids.min())
    with np.errstate(over="ignore"):
        above = doc_ids.astype(np.uint64) - np.uint64(base & (1 << 64) - 1)
        leaders = leaders.astype(np.uint64) - np.uint64(base & (1 << 64) - 1)
    narrow = np.min_scalar_type(above.max())
    above, leaders = above.astype(narrow), leaders.astype(narrow)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(bucket)], strict=True):
        middle = start + int(first[start:end].sum())
        yield {
            "bucket": int(bucket[start]), "base": base, "width": narrow.itemsize, "signatures": values[start:end].tobytes(),
            "doc_ids": above[start:end].tobytes(), "shared": np.packbits(shared[start:middle]).tobytes(),
            "leaders": leaders[middle:end].tobytes(),
        }


def _met(rows: pa.Table) -> pa.Table:
    """What ``_members`` returns, of the rows of one bucket."""
    firsts, done = [], []
    for row in rows.to_pylist():
        if row["n_shingles"] is not None:
            continue
        narrow = np.dtype(f"u{row['width']}")
        values = np.frombuffer(row["signatures"], np.uint64)
        with np.errstate(over="ignore"):
            base = np.uint64(row["base"] & (1 << 64) - 1)
            doc_ids = (np.frombuffer(row["doc_ids"], narrow).astype(np.uint64) + base).view(np.int64)
            leaders = (np.frombuffer(row["leaders"], narrow).astype(np.uint64) + base).view(np.int64)
        middle = len(values) - len(leaders)
        shared = np.unpackbits(np.frombuffer(row["shared"], np.uint8), count=middle).astype(bool)
        firsts.append((values[:middle], doc_ids[:middle], shared))
        done.append((values[middle:], doc_ids[middle:], leaders))
    sized = rows.filter(pa.compute.is_valid(rows["n_shingles"]))
    found = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    if firsts:
        values, doc_ids, shared = (np.concatenate(part) for part in zip(*firsts, strict=True))
        order = np.lexsort((doc_ids, values))
        values, doc_ids, shared = values[order], doc_ids[order], shared[order]
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        group = np.cumsum(new) - 1
        kept = shared | (np.bincount(group) > 1)[group] if len(values) else shared
        met = values[kept], doc_ids[kept], doc_ids[new][group][kept]
        found = [np.concatenate(part) for part in zip(met, *done, strict=True)]
    none = len(found[0])
    return pa.table({
        "signature": pa.chunked_array([pa.array(found[0].view(np.int64)), pa.nulls(len(sized), pa.int64())]),
        "doc_id": pa.chunked_array([pa.array(found[1]), *sized["doc_id"].chunks]),
        "leader": pa.chunked_array([pa.array(found[2]), pa.nulls(len(sized), pa.int64())]),
        "n_shingles": pa.chunked_array([pa.nulls(none, pa.int64()), *sized["n_shingles"].chunks]),
        "sketch": pa.chunked_array([pa.nulls(none, pa.binary()), *sized["sketch"].chunks]),
        "digest": pa.chunked_array([pa.nulls(none, pa.binary()), *sized["digest"].chunks]),
    })


def _members(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``(signature, doc_id, leader)`` of every signature that several documents share; the leader is the smallest of them.

    Rows with ``n_shingles``, one for every row of ``docs``, have the size, the sketch and the digest of its set instead. Of
    the equal sets that a task holds at a time, one makes signatures.

    Signatures travel packed, some thousands to a row, in ``BUCKETS`` buckets for each shuffle partition; a task compares
    those of one bucket at a time. More shuffle partitions make smaller buckets.
    """
    spark = docs.sparkSession
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ("bucket", "base", "width", "signatures", "doc_ids", "shared", "leaders", "doc_id", "n_shingles", "sketch", "digest")
    kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.int64(), pa.binary(), pa.binary())
    packed = pa.schema(list(zip(names, kinds, strict=True)))

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = PartEnum(percent)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        signed: set[bytes] = set()
        count = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            rows = list(_packed(held, buckets)) if held else []
            for start in range(0, len(rows), PACKED_ROWS):
                yield pa.RecordBatch.from_pylist(rows[start : start + PACKED_ROWS], packed)

        for batch in batches:
            sizes = []
            for text, doc_id in zip(texts(batch), batch.column("doc_id").to_pylist(), strict=True):
                elements = shingle_set(text, words)
                place = (doc_id or len(sizes)) % buckets
                digest = set_digest(elements)
                sizes.append({
                    "bucket": place, "doc_id": doc_id, "n_shingles": len(elements), "sketch": odd_sketch(elements), "digest": digest
                })
                if doc_id is not None and digest is not None and digest not in signed:
                    signed.add(digest)
                    made = scheme.signatures(elements)
                    held.append((made, np.full(len(made), doc_id)))
                    count += len(made)
                if count > HELD_SIGNATURES:
                    yield from flushed()
                    held, count = [], 0
                    signed.clear()
            yield pa.RecordBatch.from_pylist(sizes, packed)
        yield from flushed()
        held, signed = [], set()
        give_back()

    kind = "bucket int, base long, width int, signatures binary, doc_ids binary, shared binary, leaders binary, doc_id long, n_shingles long, sketch binary, digest binary"
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(signatures, kind)
    return made.groupBy("bucket").applyInArrow(_met, "signature long, doc_id long, leader long, n_shingles long, sketch binary, digest binary")


def _twins(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(a, b)`` for every document ``b`` with a set that a smaller document has too, ``a`` being the smallest of them; and
    those rows of it whose ``b`` has no other set, so that ``a`` can stand for it.

    ``named`` has a row ``(doc_id, digest)`` for every set with elements.
    """
    named = named.select("doc_id", "digest")
    least = named.groupBy("digest").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last")).where("a < last")
    twins = cut_lineage(named.join(least, "digest").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct())
    several = named.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high")
    return twins, twins.join(several.select(F.col("doc_id").alias("b")), "b", "left_anti").select("a", "b")


def _members_of_classes(members: DataFrame, alone: DataFrame) -> DataFrame:
    """``(signature, doc_id, leader)`` with the smallest document of a set in place of the others, ``alone`` of ``_twins``;
    signatures of one set only go."""
    moved = alone.select(F.col("b").alias("doc_id"), "a")
    named = members.join(moved, "doc_id", "left").select("signature", F.coalesce("a", "doc_id").alias("doc_id"))
    spans = named.groupBy("signature").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last"))
    return named.join(spans.where("leader < last").drop("last"), "signature").distinct()


def _matrix(sketches: pa.Array, rows: np.ndarray, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), length)


def _alike(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that sizes and sketches allow to be similar enough; none that is goes."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_a, size_b = (batch.column(name).to_numpy() for name in ("size_a", "size_b"))
            sketch_a, sketch_b = (batch.column(name) for name in ("sketch_a", "sketch_b"))
            least = np.zeros(batch.num_rows, np.int64)
            lengths = np.stack([pa.compute.binary_length(sketch).to_numpy() for sketch in (sketch_a, sketch_b)], axis=1)
            kinds, kind = np.unique(lengths, axis=0, return_inverse=True)
            for number, (length_a, length_b) in enumerate(kinds):
                rows = np.flatnonzero(kind.reshape(-1) == number)
                least[rows] = least_differences(_matrix(sketch_a, rows, length_a), _matrix(sketch_b, rows, length_b))
            kept = least * (100 + percent) <= (100 - percent) * (size_a + size_b)
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    for side in ("b", "a"):
        own = sketches.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        pairs = pairs.join(own, side)
    near = pairs.where(f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)")
    return near.mapInArrow(possible, "a long, b long").distinct()


def _compared(rows: pa.Table, percent: int, nearest: int | None = None) -> pa.Table:
    """The pairs ``(a, b)`` of a bucket's rows that share signature and block pair, lie in different components and are
    possible by size and sketch.

    With ``nearest``, a row names only that many of the partners behind it, those of the nearest sketches; ``more`` tells
    that it has others. So the pairs are at most ``nearest`` times the rows.
    """
    none = np.zeros(0, np.int64)
    signature, i, j, doc_id, component, size = (rows[name].to_numpy() for name in ("signature", "i", "j", "doc_id", "component", "n_shingles"))
    right = rows["own"].to_numpy() != i
    order = np.lexsort((right, j, i, signature))
    signature, i, j, doc_id, component, size, right = (x[order] for x in (signature, i, j, doc_id, component, size, right))
    place = np.arange(len(order))
    new = np.ones(len(order), bool)
    new[1:] = (signature[1:] != signature[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    group = np.cumsum(new) - 1
    end = np.append(np.flatnonzero(new)[1:], len(order))[group]
    # The partners of a row are consecutive: what follows it in its block, or all of the other block.
    start = np.where(i == j, place + 1, end - np.bincount(group, right)[group].astype(np.int64))
    partners = np.where(right, 0, end - start)

    sketches = rows["sketch"].combine_chunks().take(pa.array(order))
    length = pa.compute.binary_length(sketches).to_numpy()
    kinds, kind = np.unique(length, return_inverse=True)
    within = np.zeros(len(order), np.int64)
    tables = []
    for number, bytes_ in enumerate(kinds):
        chosen = np.flatnonzero(kind == number)
        within[chosen] = np.arange(len(chosen))
        tables.append(_matrix(sketches, chosen, bytes_).view(np.uint64))

    def possible(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fit = (component[one] != component[other]) & (
            100 * np.minimum(size[one], size[other]) >= percent * np.maximum(size[one], size[other])
        )
        one, other = one[fit], other[fit]
        least = np.zeros(len(one), np.int64)
        both = kind[one] * len(kinds) + kind[other]
        for code in np.unique(both):
            chosen = np.flatnonzero(both == code)
            left, right_ = tables[code // len(kinds)], tables[code % len(kinds)]
            step = max(PAIRS_AT_A_TIME * 2 // max(left.shape[1], right_.shape[1]), 1)
            for first in range(0, len(chosen), step):
                some = chosen[first : first + step]
                least[some] = least_differences(left[within[one[some]]], right_[within[other[some]]])
        kept = least * (100 + percent) <= (100 - percent) * (size[one] + size[other])
        one, other, least = one[kept], other[kept], least[kept]
        more = np.zeros(len(one), np.int64)
        if nearest is not None:
            order = np.lexsort((other, least, one))
            one, other = one[order], other[order]
            nth = np.arange(len(one)) - np.searchsorted(one, one)
            more = (np.searchsorted(one, one, side="right") - np.searchsorted(one, one) > nearest).astype(np.int64)
            one, other, more = (x[nth < nearest] for x in (one, other, more))
        a, b = doc_id[one], doc_id[other]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), more], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1], pairs[:, 2]

    found = [(none, none, none)]
    before = np.cumsum(partners) - partners
    first = 0
    while first < len(order):
        # At most the stated number of pairs more than those of one row.
        last = int(np.searchsorted(before, before[first] + PAIRS_AT_A_TIME, side="right"))
        one = np.repeat(place[first:last], partners[first:last])
        nth = np.arange(len(one)) - np.repeat(before[first:last] - before[first], partners[first:last])
        if len(one):
            found.append(possible(one, start[one] + nth))
        first = last
    a, b, more = np.unique(np.stack([np.concatenate(part) for part in zip(*found, strict=True)]), axis=1)
    return pa.table({"a": a, "b": b, "more": more > 0})


def _possible_members(open_: DataFrame, sketches: DataFrame, percent: int, nearest: int | None = None) -> DataFrame:
    """The pairs ``(a, b)`` of members of a signature in different components that sizes and sketches allow; with
    ``nearest``, that many of each member in a task, and ``more`` where it has others.

    Of signatures with the same members, one is read. The members of a signature are dealt into blocks, a row for each pair
    of blocks, and the sketches of two blocks are compared in a task: pairs become rows only where they are possible.
    """
    spark = open_.sparkSession
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    open_ = open_.dropDuplicates(["signature", "doc_id"])
    members = [F.bit_xor(F.xxhash64("doc_id")), F.bit_xor(F.xxhash64("doc_id", F.lit(1)))]
    profiles = open_.groupBy("signature").agg(F.count("*").alias("n"), *[hash_.alias(f"h{at}") for at, hash_ in enumerate(members)])
    read = profiles.groupBy("n", "h0", "h1").agg(F.min("signature").alias("signature"))
    blocks = F.ceil(F.col("n") / BLOCK_MEMBERS)
    placed = open_.join(read.select("signature", blocks.alias("blocks")), "signature").join(sketches, "doc_id")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    bucket = F.pmod(F.xxhash64("signature", "i", "j"), F.lit(buckets)).alias("bucket")
    rows = paired.select(bucket, "signature", "i", "j", "own", "doc_id", "component", "n_shingles", "sketch")
    return rows.groupBy("bucket").applyInArrow(lambda table: _compared(table, percent, nearest), "a long, b long, more boolean").groupBy("a", "b").agg(
        F.bool_or("more").alias("more")
    )


def _linked(near: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar enough, counted exactly from their texts."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        held = 0

        def set_of(text: bytes) -> np.ndarray:
            nonlocal held
            if text not in known:
                if held > KEPT_ELEMENTS:
                    known.clear()
                    held = 0
                known[text] = shingle_set(text, words)
                held += len(known[text]) + 100
            return known[text]

        for batch in batches:
            kept = []
            for one, other in zip(texts(batch, "text_a"), texts(batch, "text_b"), strict=True):
                a, b = set_of(one), set_of(other)
                same = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) else 0
                kept.append(bool(same) and 100 * same >= percent * (len(a) + len(b) - same))
            yield batch.select(["a", "b"]).filter(pa.array(kept))
        known = {}
        give_back()

    near = cut_lineage(near)
    ids = near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct()
    wanted = docs.select("doc_id", "text").where("text is not null").join(ids, "doc_id", "left_semi")
    others = near.join(wanted.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = others.join(wanted.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(similar, "a long, b long")


def _pairs(met: DataFrame, one: str, other: str) -> DataFrame:
    return met.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def _open_members(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(signature, doc_id, component)`` of the signatures whose documents ``links`` leave in several components."""
    found = smallest_reachable(links).withColumnRenamed("node", "doc_id")
    labelled = members.join(found, "doc_id", "left").select("signature", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    labelled = cut_lineage(labelled)
    spans = labelled.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return labelled.join(spans.where("low < high").select("signature"), "signature", "left_semi")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``.

    Two documents link when their sets of distinct word n-grams have a Jaccard similarity of ``percent`` or more; a text
    of fewer words is one n-gram, one without words is empty and links with nothing. ``component_id`` is the smallest
    ``doc_id`` that links reach.

    Documents of equal sets, told by digests of 128 bits, link without a check; the smallest stands for all of them from
    there on. Signatures find the other pairs, sketches rule out what differs too much, texts decide the rest. The first
    round checks each member of a signature against its smallest document only, which joins groups of near copies however
    large. The next checks what still lies in other components against the signature's document of most signatures, which
    is the one nearest to the others. Further ones compare all members of a signature in different components by sketch,
    block by block, and check the nearest partners of each, ``FURTHER`` times as many a round until none are left out. So
    no link that would change a component is lost and no group of copies is written out in pairs; pairs that other links
    join already are not checked. ``similar_classes`` gives every link.

    A null text is empty. Rows that share a ``doc_id`` are one document with several texts: a link of any of them is its
    link, and each row keeps its own ``n_shingles``. A null ``doc_id`` links with nothing and has a null component.
    Further columns are ignored.
    """
    made = cut_lineage(_members(docs, words, percent))
    sized = made.where("n_shingles is not null")
    named = sized.where("digest is not null and doc_id is not null")
    twins, alone = _twins(named)
    members = cut_lineage(_members_of_classes(made.where("n_shingles is null").select("signature", "doc_id"), alone))
    popularity = members.groupBy("doc_id").agg(F.count("*").alias("n"))
    sketches = named.select("doc_id", "n_shingles", "sketch")

    def linked(pairs: DataFrame) -> DataFrame:
        return cut_lineage(_linked(_alike(pairs, sketches, percent), docs, words, percent))

    stars = members.where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = linked(stars)
    open_ = cut_lineage(_open_members(members, links).join(popularity, "doc_id"))
    rank = F.struct("n", "doc_id")
    centre = open_.groupBy("signature").agg(F.max_by(F.struct("doc_id", "component"), rank).alias("centre"))
    met = open_.join(centre, "signature").where("component <> centre.component")
    links = links.union(linked(_pairs(met, "centre.doc_id", "doc_id")))

    nearest, checked = NEAREST, links.limit(0)
    open_ = cut_lineage(_open_members(members, links))
    while True:
        possible = cut_lineage(_possible_members(open_, sketches, percent, nearest))
        new = cut_lineage(possible.join(checked, ["a", "b"], "left_anti").select("a", "b"))
        found = cut_lineage(_linked(new, docs, words, percent))
        links = links.union(found)
        if possible.where("more").isEmpty():
            break
        nearest, checked = nearest * FURTHER, checked.union(new)
        if not found.isEmpty():
            open_ = cut_lineage(_open_members(members, links))

    component = smallest_reachable(links.union(twins)).withColumnRenamed("node", "doc_id")
    return sized.join(component, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def similar_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links of ``near_duplicates``: ``(doc_id, class_id)`` for every row of ``docs(doc_id, text)`` that has words, and
    ``(a, b)`` with ``a < b`` for every two classes that link.

    Rows of equal sets are one class, named by a digest of the set, and link with each other. All other pairs that link are
    those of linked classes, whether or not other links join them already. So copies are not written out in pairs, but
    a family of n different texts that all link makes n * (n - 1) / 2 rows.

    A null text is empty; an empty text is in no class. A null ``doc_id`` is kept. Further columns are ignored.
    """

    def described(batch: pa.RecordBatch) -> dict[str, object]:
        import xxhash

        sets = [shingle_set(text, words) for text in texts(batch)]
        digests = [xxhash.xxh3_64_intdigest(own.tobytes()) if len(own) else None for own in sets]
        signed = [digest and digest - (digest >> 63 << 64) for digest in digests]
        return {"doc_id": batch.column("doc_id"), "class_id": pa.array(signed, pa.int64()), "text": batch.column("text")}

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    classed = by_batch(plain, described, "doc_id long, class_id long, text string").where("class_id is not null")
    # Any text of a class has its set.
    chosen = cut_lineage(classed.groupBy(F.col("class_id").alias("doc_id")).agg(F.min("text").alias("text")))
    made = cut_lineage(_members(chosen, words, percent))
    apart = made.where("n_shingles is null").select("signature", "doc_id", F.col("doc_id").alias("component"))
    sketches = made.where("n_shingles is not null").select("doc_id", "n_shingles", "sketch")
    pairs = _linked(_possible_members(apart, sketches, percent).select("a", "b"), chosen, words, percent)
    return classed.select("doc_id", "class_id"), pairs
