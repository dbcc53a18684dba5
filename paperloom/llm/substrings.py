"""Repeated word windows across documents: super-k-mer partitioning and exact counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import by_batch, kinds_of, mix, rolled, row_key, texts, word_hashes
from paperloom.session import cut_lineage

WINDOW = 35
#: Words of a minimiser: long enough that few recur outside repeated passages.
MINIMISER = 9
#: Windows of a minimiser that recurs more often travel one by one, by their content.
HOT = 20_000
KEYS = ["doc_id", "row_key"]


def runs(words: list[bytes], window: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of every super-k-mer: consecutive windows whose smallest hash of
    ``width`` words, the leftmost of equal ones, stands at the same place. No two windows of one are equal."""
    order = mix(rolled(word_hashes(words), width))
    count, inside = len(words) - window + 1, window - width + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    least, place = order, np.arange(len(order))
    reach = 1
    while reach < inside:
        step = min(reach, inside - reach)
        later = least[step:] < least[:-step]
        least = np.where(later, least[step:], least[:-step])
        place = np.where(later, place[step:], place[:-step])
        reach += step
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return first, np.diff(np.append(first, count)), least[first]


def repeated_windows(docs: DataFrame, window: int = WINDOW, width: int = MINIMISER, hot: int = HOT) -> DataFrame:
    """``(doc_id, row_key, starts)``: the windows of ``docs(doc_id, row_key, text)`` whose words start elsewhere too.

    First only the minimisers travel, one per super-k-mer: a window whose minimiser occurs once occurs once. The
    super-k-mers of recurring minimisers then travel as one packed string each to their minimiser's bucket, where the
    windows are sorted and counted by their words. A minimiser that recurs more than ``hot`` times has its windows sent
    one by one, as 128-bit digests counted before the shuffle, so that no bucket grows with the commonest passage.
    """
    # The first of a batch travels by its minimiser, which then need not be said twice.
    spots = "route long, doc_id long, row_key long, minimiser long, n long"

    def minimisers(batch: pa.RecordBatch) -> dict[str, object]:
        own = [runs(text.split(), window, width)[2] for text in texts(batch)]
        sizes = [len(part) for part in own]
        row = np.repeat(np.arange(len(own)), sizes)
        values = np.concatenate(own)
        # A row for each minimiser of a document; the first of a batch has the batch's count, to be met by the others'.
        order = np.lexsort((row, values))
        row, values = row[order], values[order]
        same_value, same_row = np.zeros(len(values), bool), np.zeros(len(values), bool)
        same_value[1:] = values[1:] == values[:-1]
        same_row[1:] = same_value[1:] & (row[1:] == row[:-1])
        group = np.cumsum(~same_value) - 1
        total = np.bincount(group)[group]
        kept = ~same_row
        row, values, total, first = row[kept], values[kept], total[kept], ~same_value[kept]
        keys = mix(batch.column("row_key").to_numpy().view(np.uint64)[row] ^ values)
        return {
            "route": np.where(first, values, keys).view(np.int64),
            "doc_id": batch.column("doc_id").take(pa.array(row)),
            "row_key": batch.column("row_key").take(pa.array(row)),
            "minimiser": pa.array(values.view(np.int64), mask=first),
            "n": np.where(first, total, -total).astype(np.int64),
        }

    at = Window.partitionBy("route")
    met = by_batch(docs, minimisers, spots).withColumn("times", F.sum(F.abs("n")).over(at)).where("times > 1")
    met = cut_lineage(met.select(*KEYS, F.coalesce("minimiser", "route").alias("minimiser"), (F.col("n") > 0).alias("whole"), "times"))
    # Only the row that met those of all batches knows how often the minimiser occurs in all.
    commonest = met.where(F.col("whole") & (F.col("times") > hot)).select("minimiser", F.lit(True).alias("hot")).distinct()
    again = met.join(commonest, "minimiser", "left").groupBy(*KEYS).agg(
        F.collect_set("minimiser").alias("again"), F.collect_set(F.when(F.col("hot"), F.col("minimiser"))).alias("hot")
    )
    sent = docs.join(again, [docs.doc_id.eqNullSafe(again.doc_id), docs.row_key == again.row_key]).select(
        docs.doc_id, docs.row_key, "text", "again", "hot"
    )

    def packed(batch: pa.RecordBatch) -> dict[str, object]:
        """The super-k-mers of recurring minimisers, but for the hot ones."""
        rows, starts, held, of = [], [], [], []
        wanted = zip(batch.column("again").to_pylist(), batch.column("hot").to_pylist(), strict=True)
        for row, (text, (again, hot)) in enumerate(zip(texts(batch), wanted, strict=True)):
            words = text.split()
            again = set(again).difference(hot)
            for first, count, minimiser in _chosen(words, window, width, again):
                rows.append(row)
                starts.append(first)
                held.append(b" ".join(words[first : first + window - 1 + count]))
                of.append(minimiser)
        return _placed(batch, rows, starts) | {"packed": pa.array(held, pa.binary()), "minimiser": pa.array(of, pa.int64())}

    def single(batch: pa.RecordBatch) -> dict[str, object]:
        """A digest for every window of a hot minimiser."""
        rows, starts, held = [], [], []
        for row, (text, hot) in enumerate(zip(texts(batch), batch.column("hot").to_pylist(), strict=True)):
            words = text.split()
            for first, count, _ in _chosen(words, window, width, set(hot)):
                for start in range(first, first + count):
                    rows.append(row)
                    starts.append(start)
                    held.append(hashlib.blake2b(b" ".join(words[start : start + window]), digest_size=16).digest())
        return _placed(batch, rows, starts) | {"content": pa.array(held, pa.binary())}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sort each bucket's windows; buckets arrive one after another, equal strings next to each other."""
        open_, bucket = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["minimiser"] != open_:
                    if bucket:
                        yield _repeats(bucket, window)
                    open_, bucket = row["minimiser"], []
                if not bucket or bucket[-1][0] != row["packed"]:
                    bucket.append((row["packed"], []))
                bucket[-1][1].append((row["doc_id"], row["row_key"], row["start"]))
        if bucket:
            yield _repeats(bucket, window)

    place = "doc_id long, row_key long, start long"
    strings = by_batch(sent, packed, f"{place}, packed binary, minimiser long")
    buckets = strings.repartition("minimiser").sortWithinPartitions("minimiser", "packed")
    several = buckets.mapInArrow(counted, "doc_id long, row_key long, starts array<long>")
    alone = by_batch(sent.where(F.size("hot") > 0), single, f"{place}, content binary")
    twice = alone.groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content")
    found = alone.join(twice, "content").select(*KEYS, F.array("start").alias("starts"))
    return several.union(found).groupBy(*KEYS).agg(F.flatten(F.collect_list("starts")).alias("starts"))


def _chosen(words: list[bytes], window: int, width: int, wanted: set[int]):
    if wanted:
        first, count, minimiser = runs(words, window, width)
        for one in zip(first.tolist(), count.tolist(), minimiser.view(np.int64).tolist(), strict=True):
            if one[2] in wanted:
                yield one


def _placed(batch: pa.RecordBatch, rows: list[int], starts: list[int]) -> dict[str, object]:
    at = pa.array(rows, pa.int64())
    return {"doc_id": batch.column("doc_id").take(at), "row_key": batch.column("row_key").take(at), "start": pa.array(starts, pa.int64())}


def _repeats(bucket: list[tuple[bytes, list[tuple]]], window: int) -> pa.RecordBatch:
    """The places of a bucket's windows that occur more than once in it."""
    words = [packed.split(b" ") for packed, _ in bucket]
    spans = sorted((own[at : at + window], nth, at) for nth, own in enumerate(words) for at in range(len(own) - window + 1))
    repeats: list[list[int]] = [[] for _ in bucket]
    for nth, (span, own, at) in enumerate(spans):
        near = (nth and spans[nth - 1][0] == span) or (nth + 1 < len(spans) and spans[nth + 1][0] == span)
        if near or len(bucket[own][1]) > 1:
            repeats[own].append(at)
    rows = [
        (doc_id, row_key, [start + at for at in own])
        for (_, owners), own in zip(bucket, repeats, strict=True)
        if own
        for doc_id, row_key, start in owners
    ]
    kinds = {"doc_id": pa.int64(), "row_key": pa.int64(), "starts": pa.list_(pa.int64())}
    columns = [pa.array([row[nth] for row in rows], kind) for nth, kind in enumerate(kinds.values())]
    return pa.RecordBatch.from_arrays(columns, names=list(kinds))


def remove_repeats(docs: DataFrame, window: int = WINDOW, width: int = MINIMISER, carry: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept)`` for every row of ``docs(doc_id, text)``, and its columns ``carry``.

    Words are runs without ASCII white space. Every word that lies in a window of ``window`` words whose sequence also
    starts anywhere else, in the same document or another, is removed; ``kept`` is what stays, joined by single spaces.
    Windows are judged on the input. A null text has no words; texts shorter than a window stay whole. Equal rows are
    places of their own, so each other's repeats. A null ``doc_id`` is kept. Further columns are ignored.
    """
    others = [name for name in carry if name != "text"]
    # The same columns in the same order as the windows read, so that both joins share one exchange of the texts.
    keyed = docs.select("doc_id", row_key().alias("row_key"), "text", *others)
    found = repeated_windows(keyed.select(*KEYS, "text"), window, width)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string" + kinds_of(docs, carry)

    def removed(batch: pa.RecordBatch) -> dict[str, object]:
        totals, gone, sums, kept = [], [], [], []
        for text, starts in zip(texts(batch), batch.column("starts").to_pylist(), strict=True):
            words = text.split()
            stay = words
            if starts:
                edges = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.array(starts, np.int64))
                edges[at] += 1
                np.subtract.at(edges, np.minimum(at + window, len(words)), 1)
                stay = [word for word, covered in zip(words, np.cumsum(edges).tolist(), strict=False) if not covered]
            text = b" ".join(stay)
            totals.append(len(words))
            gone.append(len(words) - len(stay))
            sums.append(hashlib.sha256(text).hexdigest())
            kept.append(text.decode())
        return {
            "doc_id": batch.column("doc_id"), "n_words": pa.array(totals, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
            "kept_sha256": pa.array(sums, pa.string()), "kept": pa.array(kept, pa.string()),
        } | {name: batch.column(name) for name in carry}

    joined = keyed.join(found, [keyed.doc_id.eqNullSafe(found.doc_id), keyed.row_key == found.row_key], "left")
    return by_batch(joined.select(keyed.doc_id, "text", "starts", *others), removed, schema)
