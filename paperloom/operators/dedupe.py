"""First-wins removal of papers that share a DOI or a title with an earlier kept paper."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions.text import doi_key, title_key
from paperloom.session import cut_lineage

# Rounds that look at direct neighbours only; every later one follows chains as well.
PLAIN_ROUNDS = 4


def merge_order(source_pos: str = "source_pos", source_rank: str = "source_rank") -> Column:
    """Source position and rank within the source as one sortable number."""
    return F.shiftleft(F.col(source_pos).cast("bigint"), 40) + F.col(source_rank).cast("bigint")


def _round_winners(undecided: DataFrame) -> DataFrame:
    """Rows that come first under every key they carry.

    Each key names its first row; a row wins when all of its keys name it.  Both steps aggregate, so copies of a hot key
    are combined before the shuffle and no row has to be joined back to its key group.  The order travels with whether the
    row needs one vote or two.
    """

    def firsts(key: str, other: str) -> DataFrame:
        tagged = F.struct("ord", F.col(other).isNull().alias("alone"))
        first = undecided.where(F.col(key).isNotNull()).groupBy("scope", key).agg(F.min(tagged).alias("first"))
        return first.select(
            "scope", F.col("first.ord").alias("ord"), F.col("first.alone").alias("alone"), F.col(key), F.lit(None).cast("string").alias(other)
        )

    votes = firsts("doi_key", "title_key").unionByName(firsts("title_key", "doi_key"))
    counted = votes.groupBy("scope", "ord", "alone").agg(
        F.max("doi_key").alias("doi_key"), F.max("title_key").alias("title_key"), F.count("*").alias("votes")
    )
    needed = F.when(F.col("alone"), 1).otherwise(2)
    return counted.where(F.col("votes") == needed).select("scope", "ord", "doi_key", "title_key")


def _without_taken(undecided: DataFrame, winners: DataFrame, key: str) -> DataFrame:
    """Drop rows sharing ``key`` with a winner; rows without the key skip the join, where they would pile up."""
    has_key = F.col(key).isNotNull()
    taken = winners.where(has_key).select("scope", key)
    return undecided.where(has_key).join(taken, ["scope", key], "left_anti").unionByName(undecided.where(~has_key))


def _settled_chains(undecided: DataFrame) -> DataFrame:
    """Rows kept because a chain of single earlier neighbours decides them.

    A row with exactly one undecided earlier neighbour is kept if and only if that one is not.  Such rows point to their
    neighbour; doubling the pointers, with the parity of the steps, leads to the end of every chain in logarithmically
    many joins.  Chains that end at a row without an earlier neighbour are decided, the others wait.
    """
    rows = undecided
    for key, side in (("doi_key", "doi"), ("title_key", "title")):
        first = undecided.where(F.col(key).isNotNull()).groupBy("scope", key).agg(F.min("ord").alias(f"{side}_first"))
        behind = undecided.join(first, ["scope", key]).where(F.col("ord") > F.col(f"{side}_first"))
        second = behind.groupBy("scope", key).agg(F.min("ord").alias(f"{side}_second"))
        rows = rows.join(first, ["scope", key], "left").join(second, ["scope", key], "left")
        earlier = F.when(F.col(key).isNull() | (F.col("ord") == F.col(f"{side}_first")), 0)
        rows = rows.withColumn(f"{side}_earlier", earlier.when(F.col("ord") == F.col(f"{side}_second"), 1).otherwise(2))
    earlier = F.col("doi_earlier") + F.col("title_earlier")
    target = F.when(earlier == 1, F.when(F.col("doi_earlier") == 1, F.col("doi_first")).otherwise(F.col("title_first")))
    placed = cut_lineage(rows.where(earlier < 2).select("scope", "ord", "doi_key", "title_key", target.alias("to")))
    ends = placed.where(F.col("to").isNull()).select("scope", F.col("ord").alias("to"))
    pointers = placed.where(F.col("to").isNotNull()).select("scope", "ord", "to", F.lit(True).alias("odd"))
    open_ = cut_lineage(pointers)
    done = []
    while True:
        done.append(open_.join(ends, ["scope", "to"], "left_semi").select("scope", "ord", "odd"))
        onward = open_.select("scope", F.col("ord").alias("to"), F.col("to").alias("next"), F.col("odd").alias("step"))
        moved = open_.join(onward, ["scope", "to"]).select(
            "scope", "ord", F.col("next").alias("to"), (F.col("odd") != F.col("step")).alias("odd")
        )
        open_ = cut_lineage(moved)
        if open_.isEmpty():
            break
    decided = reduce(DataFrame.unionByName, done).where(~F.col("odd"))
    return placed.join(decided.select("scope", "ord"), ["scope", "ord"], "left_semi").drop("to")


def first_wins(keyed: DataFrame) -> DataFrame:
    """``(scope, ord)`` of the kept rows of ``keyed(scope, ord, doi_key, title_key)``; ``ord`` is unique within scope.

    A row is dropped if an earlier *kept* row of its scope has the same DOI key or the same title key; null keys match
    nothing.  Rows with equal key pairs can only be represented by their first one, so those groups collapse before the
    rounds start.  Every round keeps the rows that come first under all their keys and drops what shares a key with them;
    most data ends within a few.  What is left then are chains, which later rounds settle along their whole length.
    """
    keyless = F.col("doi_key").isNull() & F.col("title_key").isNull()
    always_kept = keyed.where(keyless).select("scope", "ord")
    undecided = cut_lineage(
        keyed.where(~keyless).groupBy("scope", "doi_key", "title_key").agg(F.min("ord").alias("ord"))
    )
    kept = [always_kept]
    rounds = 0
    while not undecided.isEmpty():
        winners = _round_winners(undecided)
        if rounds >= PLAIN_ROUNDS:
            winners = winners.unionByName(_settled_chains(undecided))
        winners = cut_lineage(winners)
        undecided = cut_lineage(_without_taken(_without_taken(undecided, winners, "doi_key"), winners, "title_key"))
        kept.append(winners.select("scope", "ord"))
        rounds += 1
    return reduce(DataFrame.unionByName, kept)


def dedupe_papers(papers: DataFrame, scope: str | None = None) -> DataFrame:
    """Keep the papers a walk in ``(source_pos, source_rank)`` order keeps, separately for each value of ``scope``.

    Papers of one position follow in the order of their external ids, then of a hash of all their columns; of rows equal in
    all of them and with a key, one stays.  Only the order and the two keys take part in the rounds; the full rows are
    touched once, by the final join.
    """
    position = F.struct(
        merge_order().alias("at"), F.coalesce("external_id", F.lit("")).alias("id"), F.xxhash64(F.to_json(F.struct("*"))).alias("tie")
    )
    tagged = papers.withColumn("_ord", position).withColumn(
        "_scope", F.coalesce(F.col(scope).cast("string"), F.lit("\0")) if scope else F.lit("")
    )
    keyed = tagged.select(
        F.col("_scope").alias("scope"),
        F.col("_ord").alias("ord"),
        doi_key(F.col("doi")).alias("doi_key"),
        title_key(F.col("title")).alias("title_key"),
    )
    kept = first_wins(keyed).select(F.col("scope").alias("_scope"), F.col("ord").alias("_ord")).distinct()
    same = F.row_number().over(W.partitionBy("_scope", "_ord").orderBy("_scope"))
    found = tagged.join(kept, ["_scope", "_ord"], "left_semi").withColumn("_same", same)
    keyless = doi_key(F.col("doi")).isNull() & title_key(F.col("title")).isNull()
    return found.where((F.col("_same") == 1) | keyless).drop("_scope", "_ord", "_same")
