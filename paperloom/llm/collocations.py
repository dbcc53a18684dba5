"""Phrases that stand together more often than their parts: exact n-gram counts in counting quotient filters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import lists, texts
from paperloom.llm.quotient import counted, decode, encode, limb_widths, pack_ids, permute, restore, unpack_ids
from paperloom.session import cut_lineage

LEAST = 100
LONGEST = 5
FIRST = 2_000
UNKNOWN = "und"
#: Words of a block, one shard of the counts; entries that a task merges at a time, at most about so many.
BLOCK_WORDS = 1 << 20
MERGED = 1 << 20
#: What ends a piece of text. White space between words is space and tab.
ENDS = b".,;:!?\n\v\f\r"
#: A byte that no UTF-8 text holds stands for them.
STOP = b"\xff"
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + ENDS, bytes(range(97, 123)) + STOP * len(ENDS))


class _Numbers(dict):
    """Words numbered from 1 in the order they come; the end of a piece is 0."""

    def __init__(self):
        super().__init__({STOP: 0})

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


_BLOCK = pa.schema([
    ("lang", pa.string()), ("block", pa.int64()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())),
    ("order", pa.binary()), ("n", pa.int64()), ("width", pa.int32()), ("stream", pa.binary()),
])
_BLOCK_KIND = "lang string, block long, words array<binary>, counts array<long>, order binary, n long, width int, stream binary"


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def word_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(lang, block, words, counts, order, n, width, stream)``: the texts of a task and language as numbers of ``width`` bytes.

    ``words`` are a block's distinct words in the order of their hashes, with their ``counts``, whose sum is ``n``, and their
    numbers ``order``, the commonest word being 1. A 0 in ``stream`` ends a piece. A block is closed behind the document
    that fills its task's share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, _Numbers] = {}
        held: dict[str, list[np.ndarray]] = {}
        count, block = 0, TaskContext.get().partitionId() << 32

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal block
            for lang, parts in held.items():
                stream = np.concatenate(parts)
                words = list(numbers[lang])[1:]
                if not words:
                    continue
                times = np.bincount(stream, minlength=len(words) + 1)[1:]
                number = np.zeros(len(words) + 1, np.uint32)
                number[np.argsort(-times, kind="stable") + 1] = np.arange(1, len(words) + 1)
                hashed = np.argsort(_hashes(words), kind="stable")
                narrow = np.min_scalar_type(len(words))
                row = {
                    "lang": lang, "block": block, "words": [words[at] for at in hashed], "counts": times[hashed].tolist(),
                    "order": number[1:][hashed].astype("<u4").tobytes(), "n": int(times.sum()), "width": narrow.itemsize,
                    "stream": number[stream].astype(narrow).tobytes(),
                }
                block += 1
                yield pa.RecordBatch.from_pylist([row], _BLOCK)

        for batch in batches:
            for text, lang in zip(texts(batch), batch.column("lang").to_pylist(), strict=True):
                words = (text.translate(_PLAIN) + STOP).replace(STOP, b" " + STOP + b" ").split()
                own = numbers.setdefault(lang, _Numbers())
                held.setdefault(lang, []).append(np.fromiter(map(own.__getitem__, words), np.uint32, len(words)))
                count += len(words)
                if count >= block_words:
                    yield from closed()
                    numbers, held, count = {}, {}, 0
        yield from closed()

    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").mapInArrow(run, _BLOCK_KIND)


def _routes(entries: int | None) -> int:
    """Leading bits that deal so many entries into shares of at most about ``MERGED``."""
    return ((entries or 0) // MERGED).bit_length()


def numbered_words(blocks: DataFrame, least: int) -> DataFrame:
    """``(lang, word, n, id)`` of the words that occur ``least`` times or more in their language, ids from 1 and nearly dense
    in each; and ``(block, route, ids)``, the ids of a block's words in the order of their hashes, 0 for the others.

    The words of a block travel together, in one row for each range of hashes.
    """
    leading = _routes(blocks.agg(F.sum(F.size("words"))).first()[0])
    kind = pa.schema([("lang", pa.string()), ("route", pa.int64()), ("block", pa.int64()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes = _hashes(row["words"])
                route = (hashes >> np.uint64(64 - leading)).astype(np.int64) if leading else np.zeros(len(hashes), np.int64)
                edges = np.flatnonzero(np.diff(route, prepend=-1))
                ranges = zip(edges, [*edges[1:], len(route)], strict=True)
                made = [
                    {"lang": row["lang"], "route": int(route[low]), "block": row["block"], "words": row["words"][low:high], "counts": row["counts"][low:high]}
                    for low, high in ranges
                ]
                if made:
                    yield pa.RecordBatch.from_pylist(made, kind)

    def merge(rows: pa.Table) -> pa.Table:
        held = rows["words"].combine_chunks()
        coded = held.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        sums = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(sums, codes, rows["counts"].combine_chunks().flatten().to_numpy())
        often = sums >= least
        ids = np.where(often, (np.cumsum(often) - 1 << leading) + rows["route"][0].as_py() + 1, 0)
        found, given = int(often.sum()), len(rows)
        words = pa.table({
            "lang": pa.array([rows["lang"][0].as_py()] * found, pa.string()), "word": coded.dictionary.filter(pa.array(often)),
            "n": sums[often], "id": ids[often], "block": pa.nulls(found, pa.int64()), "route": pa.nulls(found, pa.int64()),
            "ids": pa.nulls(found, pa.list_(pa.int64())),
        })
        sizes = np.diff(held.offsets.to_numpy())
        own = pa.table({
            "lang": rows["lang"], "word": pa.nulls(given, pa.binary()), "n": pa.nulls(given, pa.int64()), "id": pa.nulls(given, pa.int64()),
            "block": rows["block"], "route": rows["route"], "ids": lists(ids[codes], sizes),
        })
        return pa.concat_tables([words, own])

    shards = blocks.select("lang", "block", "words", "counts").mapInArrow(dealt, "lang string, route long, block long, words array<binary>, counts array<long>")
    return shards.groupBy("lang", "route").applyInArrow(merge, "lang string, word binary, n long, id long, block long, route long, ids array<long>")


def _streams(blocks: DataFrame, numbered: DataFrame) -> DataFrame:
    """``(lang, block, width, stream)``: each word's id, 0 where a piece ends or a word is rare."""
    own = numbered.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("route", "ids")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams, widths = [], []
            for row in batch.to_pylist():
                order = np.frombuffer(row["order"], "<u4")
                table = np.zeros(len(order) + 1, np.uint64)
                table[order] = np.concatenate([part["ids"] for part in sorted(row["ids"], key=lambda part: part["route"])])
                narrow = np.min_scalar_type(table.max())
                streams.append(table[np.frombuffer(row["stream"], f"<u{row['width']}")].astype(narrow).tobytes())
                widths.append(narrow.itemsize)
            arrays = [batch.column("lang"), batch.column("block"), pa.array(widths, pa.int32()), pa.array(streams, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "block", "width", "stream"])

    both = blocks.select("lang", "block", "order", "width", "stream").join(own, "block")
    return both.mapInArrow(run, "lang string, block long, width int, stream binary")


class _Shards:
    """Counts of the n-grams of a block, as one filter for every length and leading bits of the permuted key."""

    def __init__(self, bits: int, routes: int):
        self.bits, self.routes = bits, routes

    def widths(self, length: int) -> list[int]:
        return limb_widths(self.bits * length)

    def leading(self, length: int) -> int:
        return min(self.routes, self.widths(length)[0])

    def keys(self, stream: np.ndarray, starts: np.ndarray, length: int):
        """Distinct permuted keys of the n-grams at ``starts``, their counts, and the place of every start among them."""
        limbs = pack_ids([stream[starts + nth] for nth in range(length)], self.bits)
        return counted(permute(limbs, self.widths(length)), np.ones(len(starts), np.int64))

    def rows(self, lang: str, block: int, stream: np.ndarray, starts: np.ndarray, length: int) -> Iterator[dict[str, object]]:
        if not len(starts):
            return
        limbs, counts, _ = self.keys(stream, starts, length)
        widths, leading = self.widths(length), self.leading(length)
        shift = widths[0] - leading
        route = (limbs[0] >> np.uint64(shift)).astype(np.int64) if leading else np.zeros(len(counts), np.int64)
        edges = np.flatnonzero(np.diff(route, prepend=-1))
        for low, high in zip(edges, [*edges[1:], len(route)], strict=True):
            packed = encode([limb[low:high] for limb in limbs], widths, counts[low:high], leading)
            yield {"lang": lang, "length": length, "route": int(route[low]), "block": block, "filter": packed}


def _starts(usable: np.ndarray, run: int) -> np.ndarray:
    """Where ``run`` places in a row are usable."""
    count = len(usable) - run + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    whole = usable[:count].copy()
    for nth in range(1, run):
        whole &= usable[nth : nth + count]
    return np.flatnonzero(whole)


_SHARD = pa.schema([("lang", pa.string()), ("length", pa.int32()), ("route", pa.int64()), ("block", pa.int64()), ("filter", pa.binary())])
_SHARD_KIND = "lang string, length int, route long, block long, filter binary"


def _shards(streams: DataFrame, shards: _Shards, lengths: Sequence[int]) -> DataFrame:
    """The filters of every block. With a column ``marks``, which pairs of neighbours occur often enough, n-grams are counted
    where all their pairs do: no other can."""
    marked = "marks" in streams.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stream = np.frombuffer(row["stream"], f"<u{row['width']}").astype(np.uint64)
                usable, span = stream > 0, 1
                if marked:
                    pairs = _starts(usable, 2)
                    _, _, place = shards.keys(stream, pairs, 2)
                    often = [np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=m["size"]) for m in sorted(row["marks"], key=lambda m: m["route"])]
                    usable, span = np.zeros(len(stream), bool), 2
                    usable[pairs] = np.concatenate(often)[place].astype(bool)
                for length in lengths:
                    made = list(shards.rows(row["lang"], row["block"], stream, _starts(usable, length - span + 1), length))
                    if made:
                        yield pa.RecordBatch.from_pylist(made, _SHARD)

    return streams.mapInArrow(run, _SHARD_KIND)


_MERGED_KIND = "lang string, block long, route long, size int, bits binary, ids array<long>, n long"


def _merged(filters: DataFrame, shards: _Shards, least: int, mark: bool) -> DataFrame:
    """Merge the filters of all blocks that share language, length and route: ``(lang, ids, n)`` of the n-grams that occur often enough, and
    with ``mark`` also ``(block, route, size, bits)``, which of a block's n-grams those are."""

    def merge(rows: pa.Table) -> pa.Table:
        length, route = rows["length"][0].as_py(), rows["route"][0].as_py()
        widths = shards.widths(length)
        parts = [decode(data, widths, route) for data in rows["filter"].to_pylist()]
        sizes = [len(counts) for _, counts in parts]
        limbs, sums, place = counted(
            [np.concatenate(limb) for limb in zip(*[limbs for limbs, _ in parts], strict=True)],
            np.concatenate([counts for _, counts in parts]),
        )
        often = sums >= least
        ids = unpack_ids(restore([limb[often] for limb in limbs], widths), shards.bits, length)
        found = int(often.sum())
        flat = np.stack(ids, axis=1).reshape(-1).view(np.int64)
        table = pa.table({
            "lang": pa.array([rows["lang"][0].as_py()] * found, pa.string()), "block": pa.nulls(found, pa.int64()), "route": pa.nulls(found, pa.int64()), "size": pa.nulls(found, pa.int32()),
            "bits": pa.nulls(found, pa.binary()), "ids": lists(flat, np.full(found, length)), "n": pa.array(sums[often]),
        })
        if not mark:
            return table
        ends = np.cumsum(sizes)
        bits = [np.packbits(often[place[end - size : end]]).tobytes() for end, size in zip(ends, sizes, strict=True)]
        marks = pa.table({
            "lang": rows["lang"], "block": rows["block"], "route": rows["route"], "size": pa.array(sizes, pa.int32()), "bits": pa.array(bits, pa.binary()),
            "ids": pa.nulls(len(sizes), pa.list_(pa.int64())), "n": pa.nulls(len(sizes), pa.int64()),
        })
        return pa.concat_tables([table, marks])

    return filters.groupBy("lang", "length", "route").applyInArrow(merge, _MERGED_KIND)


def phrase_counts(blocks: DataFrame, numbered: DataFrame, longest: int, least: int) -> DataFrame:
    """``(lang, ids, n)`` of all phrases of 2 to ``longest`` words that occur ``least`` times or more, counted exactly.

    An n-gram's word ids are packed into one integer, which is permuted invertibly; its leading bits are the quotient, the
    rest the remainder, so a filter counts every n-gram by itself. Each block makes its own filters, and a task merges
    the sorted filters of all blocks over one range of the permuted keys. Pairs come first: longer phrases are counted
    only where each of their pairs occurs often enough.
    """
    streams = cut_lineage(_streams(blocks, numbered))
    bits = int(numbered.agg(F.max("id")).first()[0] or 1).bit_length()
    shards = _Shards(bits, _routes(blocks.agg(F.sum("n")).first()[0]))
    longer = list(range(3, longest + 1))
    pairs = cut_lineage(_merged(_shards(streams, shards, [2]), shards, least, mark=bool(longer)))
    phrases = pairs.where("block is null").select("lang", "ids", "n")
    if longer:
        own = pairs.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("route", "size", "bits")).alias("marks"))
        more = _merged(_shards(streams.join(own, "block"), shards, longer), shards, least, mark=False)
        phrases = phrases.union(more.select("lang", "ids", "n"))
    return cut_lineage(phrases)


def _integer(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int | None = FIRST, subsumed: int = 100,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the phrases of ``docs(lang, text)`` whose words belong together.

    Letters A-Z are lower-cased; texts fall into pieces at ``. , ; : ! ?`` and line ends, pieces into words at spaces and
    tabs. Each ``lang`` counts by itself, a null one as ``und``. Candidates are the phrases of 2 to ``longest`` words that
    occur ``least`` times or more, overlaps included. A candidate of ``a`` occurrences, cut in two parts of ``l`` and ``r``
    occurrences, scores ``floor(1000 * a * n / (l * r))``, ``n`` being the language's words; its lowest cut counts, of equal
    ones that of the shortest first part. A candidate goes if a longer one contains it and occurs in ``subsumed`` percent
    or more of its places. The ``first`` of each language by score, occurrences and phrase are returned (None: all).

    A null or empty text has no words; repeated rows count as often as they stand; empty tables give no rows; further
    columns are ignored. Arithmetic is exact. Texts are read once; a task holds one block of ``block_words`` words, or one
    document where that is longer.
    """
    blocks = cut_lineage(word_blocks(docs, block_words))
    numbered = cut_lineage(numbered_words(blocks, least))
    vocabulary = numbered.where("block is null").select("lang", "word", "n", "id")
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    counts = phrase_counts(blocks, numbered, longest, least)
    phrases, size, key = counts.withColumnRenamed("n", "a"), F.size("ids"), ["lang", "ids"]

    # Every longer phrase that holds this one holds it with one word more, and occurs no more often than that one does.
    inner = F.array(F.slice("ids", 1, size - 1), F.slice("ids", 2, size - 1))
    around = phrases.where(size > 2).select("lang", F.explode(inner).alias("ids"), "a").groupBy(key).agg(F.max("a").alias("around"))
    kept = phrases.join(around, key, "left").where(F.coalesce(100 * F.col("around") < subsumed * F.col("a"), F.lit(True)))

    known = counts.union(vocabulary.select("lang", F.array("id"), "n"))
    cuts = kept.select("lang", "ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, size)})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("ids").alias(side), F.col("n").alias(name)), ["lang", side])
    cuts = cuts.join(totals, "lang")
    product = (1000 * _integer("a")).cast("decimal(38,0)") * _integer("n")
    cuts = cuts.withColumns({"product": product, "parts": _integer("l") * _integer("r")})
    scored = cuts.select("lang", "ids", "a", "n", F.struct(F.expr("product div parts").alias("score"), "k", "l", "r").alias("cut"))
    best = scored.groupBy("lang", "ids", "a", "n").agg(F.min("cut").alias("cut"))

    each = best.select("*", F.posexplode("ids").alias("nth", "id")).join(vocabulary.select("lang", "id", "word"), ["lang", "id"])
    spelt = each.groupBy("lang", "ids", "a", "n", "cut").agg(F.sort_array(F.collect_list(F.struct("nth", "word"))).alias("w"))
    phrase = F.array_join(F.transform("w", lambda w: w["word"].cast("string")), " ")
    rows = spelt.select("lang", phrase.alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long"))
    if first is not None:
        ranked = ranked.where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
