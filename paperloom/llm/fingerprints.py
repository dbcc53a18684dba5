"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, by expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import compute_once, cut_lineage

#: A sketch has three tables of eight cells; a paragraph stands in one cell of each.
TABLES, CELLS = 3, 8
#: A paragraph is a line, or up to four of its sentences where it has more.
PARAGRAPH = r"(?:[^.!?\n]*+[.!?]++[ \t]*+){1,4}+|[^.!?\n]++"
#: Digests have 63 bits. A sketch that cannot be read is made anew in two halves, by one more of them.
DIGEST_BITS = 63
#: The place of a null id, before all others.
NULL_PLACE = str(-(1 << 63) - 1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs, without white space around them; a null text has none."""
    paragraphs = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0)), lambda p: F.trim(p))
    kept = F.filter(paragraphs, lambda p: p != "")
    return F.array_distinct(F.transform(kept, lambda p: F.xxhash64(p).bitwiseAND(F.lit((1 << DIGEST_BITS) - 1))))


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), key.alias("key"), check.alias("check"))


def _placed(key: Column, n: Column, level: Column) -> Column:
    """A paragraph with its cell in every table; each level deals anew."""
    spots = F.xxhash64(key, level)
    at = [F.shiftright(spots, 3 * table).bitwiseAND(F.lit(CELLS - 1)).cast("int").alias(f"at{table}") for table in range(TABLES)]
    return F.struct(key.alias("key"), n.alias("n"), F.xxhash64(key).alias("check"), *at)


def _added(cells: Column, entries: Column, sign: int) -> Column:
    """The cells with all ``entries`` added to them, or taken out of them."""

    def table(number: int) -> Column:
        own = F.slice(cells, number * CELLS + 1, CELLS)
        return F.transform(own, lambda cell, at: F.aggregate(entries, cell, lambda x, e: F.when(
            e[f"at{number}"] == at, _cell(x["n"] + sign * e["n"], x["key"].bitwiseXOR(e["key"]), x["check"].bitwiseXOR(e["check"]))
        ).otherwise(x)))

    return F.concat(*[table(number) for number in range(TABLES)])


def sketch(keys: Column, level: Column) -> Column:
    """The cells of a set of digests: how many stand in a cell, and the exclusive or of these and of their checks."""
    zero = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    entries = F.transform(keys, lambda key: _placed(key, F.lit(1), level))
    return _let(entries, lambda made: _added(F.array_repeat(zero, TABLES * CELLS), made, 1))


def _subtracted(one: Column, other: Column) -> Column:
    return F.zip_with(one, other, lambda x, y: _cell(x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]), x["check"].bitwiseXOR(y["check"])))


def _peeled(cells: Column, level: Column) -> Column:
    """``(ok, plus, minus)``: what only the first of two subtracted sketches holds, and only the second, if all can be read.

    A cell that holds one paragraph shows its digest; taking that out of its other cells may leave one in these.
    """
    none = F.array().cast("array<long>")
    start = F.struct(cells.alias("cells"), none.alias("plus"), none.alias("minus"), F.lit(False).alias("stuck"))

    def keys(found: Column, n: int) -> Column:
        return F.transform(F.filter(found, lambda e: e["n"] == n), lambda e: e["key"])

    def step(state: Column, _: Column) -> Column:
        single = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (F.xxhash64(c["key"]) == c["check"]))
        found = F.transform(F.array_distinct(F.transform(single, lambda c: F.struct(c["key"].alias("key"), c["n"].alias("n")))),
                            lambda e: _placed(e["key"], e["n"], level))

        def without(seen: Column) -> Column:
            return F.struct(
                F.when(F.size(seen) == 0, state["cells"]).otherwise(_added(state["cells"], seen, -1)).alias("cells"),
                F.concat(state["plus"], keys(seen, 1)).alias("plus"),
                F.concat(state["minus"], keys(seen, -1)).alias("minus"),
                (F.size(seen) == 0).alias("stuck"),
            )

        return F.when(state["stuck"], state).otherwise(_let(found, without))

    def judged(end: Column) -> Column:
        read = F.forall(end["cells"], lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0))
        return F.struct(read.alias("ok"), end["plus"].alias("plus"), end["minus"].alias("minus"))

    return _let(F.aggregate(F.sequence(F.lit(1), F.lit(TABLES * CELLS)), start, step), judged)


def differences(one: Column, other: Column, one_sketch: Column, other_sketch: Column) -> Column:
    """``(plus, minus)``: the digests that only ``one`` holds, and those that only ``other`` does.

    First the fingerprints, which are sketches of a fixed size, are subtracted and peeled. Where that fails there is too much
    in them: the digests are dealt by one bit into two halves, each with a sketch of its own, and those that fail again
    into two more, so the sketches together grow until all is read.
    """
    none = F.array().cast("array<long>")

    def halves(pair: Column, level: Column) -> Column:
        def half(bit: int) -> Column:
            def own(keys: Column) -> Column:
                return F.filter(keys, lambda key: F.call_function("shiftright", key, DIGEST_BITS - level).bitwiseAND(F.lit(1)) == bit)

            return F.struct(own(pair["a"]).alias("a"), own(pair["b"]).alias("b"))

        return F.array(half(0), half(1))

    def step(state: Column, level: Column) -> Column:
        def tried(pair: Column) -> Column:
            found = _peeled(_subtracted(sketch(pair["a"], level), sketch(pair["b"], level)), level)
            return F.struct(pair["a"].alias("a"), pair["b"].alias("b"), found.alias("found"))

        def split(results: Column) -> Column:
            read = F.filter(results, lambda r: r["found"]["ok"])
            rest = F.filter(results, lambda r: ~r["found"]["ok"])
            return F.struct(
                F.flatten(F.transform(rest, lambda r: halves(r, level + 1))).alias("waiting"),
                F.concat(state["plus"], F.flatten(F.transform(read, lambda r: r["found"]["plus"]))).alias("plus"),
                F.concat(state["minus"], F.flatten(F.transform(read, lambda r: r["found"]["minus"]))).alias("minus"),
            )

        return F.when(F.size(state["waiting"]) == 0, state).otherwise(_let(F.transform(state["waiting"], tried), split))

    def begun(first: Column) -> Column:
        whole = F.struct(one.alias("a"), other.alias("b"))
        waiting = F.when(first["ok"], F.array().cast("array<struct<a:array<bigint>,b:array<bigint>>>")).otherwise(halves(whole, F.lit(1)))
        plus, minus = (F.when(first["ok"], first[side]).otherwise(none).alias(side) for side in ("plus", "minus"))
        return F.struct(waiting.alias("waiting"), plus, minus)

    start = _let(_peeled(_subtracted(one_sketch, other_sketch), F.lit(0)), begun)
    end = F.aggregate(F.sequence(F.lit(1), F.lit(DIGEST_BITS - 1)), start, step)
    return _let(end, lambda e: F.struct(e["plus"].alias("plus"), e["minus"].alias("minus")))


def fingerprint(keys: Column, cells: Column) -> Column:
    """A sketch as text, with the number of its digests."""
    shown = F.transform(cells, lambda c: F.concat_ws(".", c["n"].cast("string"), F.hex(c["key"]), F.hex(c["check"])))
    return F.concat_ws(":", F.size(keys).cast("string"), F.array_join(shown, ","))


def likeness(one: Column, other: Column, plus: Column) -> Column:
    """The shared digests' part of the larger set, ``plus`` being those that only ``one`` holds; 1 for two empty sets."""
    larger = F.greatest(F.size(one), F.size(other))
    return F.when(larger == 0, F.lit(1.0)).otherwise((F.size(one) - F.size(plus)) / larger)


def _following(docs: DataFrame) -> DataFrame:
    """``(place, next_place, next_key, need)`` of every id of ``docs(place, text)``: the id after it, after the last the
    first, with the text key of the row that stands for it, and how much of its text is wanted at most."""
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    ids = docs.groupBy("place").agg(F.max(quarter).alias("need"), F.min(F.xxhash64("text")).alias("key"))
    placed = cut_lineage(ids.repartitionByRange("place").withColumn("part", F.spark_partition_id()))
    here = F.struct("place", "key")
    # A row for each partition.
    heads = placed.groupBy("part").agg(F.min(here).alias("head"))
    parts = Window.orderBy("part")
    after = heads.select("part", F.coalesce(F.lead("head").over(parts), F.min("head").over(Window.partitionBy())).alias("after"))
    within = Window.partitionBy("part").orderBy("place")
    found = placed.withColumn("next", F.lead(here).over(within)).join(after, "part")
    found = found.withColumn("next", F.coalesce("next", "after"))
    return found.select("place", F.col("next.place").alias("next_place"), F.col("next.key").alias("next_key"), "need")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs, n_lost, n_added)``
    for every row of ``docs(doc_id, text)``.

    The edited text has the last quarter of a text's code points, rounded down, replaced by the first as many (or all) of the
    next document by ``doc_id``, the first one's after the last. A fingerprint is a fixed number of cells over the digests
    of a text's paragraphs; two are subtracted and peeled, in larger sketches where they differ by more than these can
    tell, and so give the digests that differ. ``near_edited`` and ``near_next`` are the share of equal digests in the
    larger set; ``n_lost`` and ``n_added`` count those the edit took and brought.

    A null text is empty and has no paragraphs; two such texts are alike, and the same holds for any texts of equal paragraph
    sets, in whatever order. A null ``doc_id`` stands before all others. Rows that share a ``doc_id`` have the same next
    document and stand for their id by the text of the smallest hash; equal rows give equal rows. Further columns are
    ignored; an empty table gives no rows.
    """
    place = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(NULL_PLACE).cast("decimal(20,0)"))
    plain = docs.select(place.alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    following = cut_lineage(_following(plain))
    wanted = following.select(F.col("place").alias("before"), F.col("next_place").alias("place"), "next_key", "need")
    # Both joins read the texts by their place alone, so these are exchanged once; a plain equality of hashes would become
    # a key of the first join.
    met = plain.join(wanted, "place").where(F.xxhash64("text").bitwiseXOR(F.col("next_key")) == 0)
    starts = met.select("place", "before", F.substr("text", F.lit(1), F.col("need")).alias("start"), digests(F.col("text")).alias("next"))
    starts = starts.groupBy("place", "before").agg(F.min(F.struct("start", "next")).alias("following"))
    rows = plain.join(starts.select(F.col("before").alias("place"), "following"), "place")

    count = F.char_length("text")
    cut = F.floor(count / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), count - cut), F.substr("following.start", F.lit(1), cut))
    texts = compute_once(rows, edited=edited).select(
        F.when(F.col("place") != F.lit(NULL_PLACE).cast("decimal(20,0)"), F.col("place").cast("long")).alias("doc_id"),
        count.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("new"), F.col("following.next").alias("next"),
    )
    names = ("own", "new", "next")
    sketched = compute_once(texts, **{f"{name}_cells": sketch(F.col(name), F.lit(0)) for name in names})
    own, own_cells = F.col("own"), F.col("own_cells")
    changes = {f"to_{name}": differences(own, F.col(name), own_cells, F.col(f"{name}_cells")) for name in names[1:]}
    found = compute_once(sketched, **changes)
    return found.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(own, own_cells).alias("fingerprint"), fingerprint(F.col("new"), F.col("new_cells")).alias("edited_fingerprint"),
        likeness(own, F.col("new"), F.col("to_new.plus")).alias("near_edited"),
        likeness(own, F.col("next"), F.col("to_next.plus")).alias("near_next"),
        F.size(own).cast("long").alias("n_paragraphs"), F.size("to_new.plus").cast("long").alias("n_lost"),
        F.size("to_new.minus").cast("long").alias("n_added"),
    )
