"""The most related papers of every paper: ranked short lists over shared methods and datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.functions.text import present
from paperloom.operators.graph import _copied, _salted
from paperloom.schemas import EVALUATED_ON, USES_METHOD
from paperloom.session import compute_once, cut_lineage, task_count

#: A shared entity of n papers adds WEIGHT_UNIT div n to the score: whole numbers, so sums are exact.
WEIGHT_UNIT = 10**12
#: Sets of entities that at most so many papers hold are read whole, others by their first papers and their supersets.
LIST_BOUND = 256


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda total, number: total + number)


def _weights(papers: str) -> Column:
    return F.transform(papers, lambda n: F.floor(F.lit(WEIGHT_UNIT) / n))


def _shared(used: DataFrame) -> DataFrame:
    """``(rel, name, papers, entity)`` of what several papers use, numbered from 0 by ``papers``, the rarest first."""
    degree = used.groupBy("rel", "name", "_salt").agg(F.count("*").alias("papers"))
    degree = degree.groupBy("rel", "name").agg(F.sum("papers").alias("papers")).where("papers > 1")
    # A stored table: numbers that depend on partitions must not be given twice.
    ordered = cut_lineage(degree.orderBy("papers", "rel", "name").withColumn("nth", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("part", F.shiftright("nth", 33))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row for each task of the sort.
    starts = ordered.groupBy("part").agg(F.count("*").alias("size")).select(
        "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")
    )
    number = F.col("start") + F.col("nth").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(F.broadcast(starts), "part").select("rel", "name", "papers", number.alias("entity"))


def entity_lists(edges: DataFrame) -> DataFrame:
    """``(paper_id, own, papers)``: numbers of the methods and datasets a paper shares with any other, the rarest first,
    and how many papers share them."""
    used = edges.where(F.col("rel").isin(USES_METHOD, EVALUATED_ON) & present(F.col("name")))
    used = _salted(used.select("paper_id", (F.col("rel") == USES_METHOD).alias("rel"), "name"))
    used = used.repartition("rel", "name", "_salt").distinct()
    shared = _shared(used)
    most = shared.agg(F.greatest(F.max("papers"), F.max("entity"))).first()[0] or 0
    kind = "int" if most < 1 << 31 else "bigint"
    named = _copied(shared.select("rel", "name", F.col("entity").cast(kind), F.col("papers").cast(kind)))
    pairs = F.sort_array(F.collect_list(F.struct("entity", "papers")))
    # Never broadcast: the planner takes the copies for as large as the file they come from, a few bytes a row.
    found = used.join(named.hint("merge"), ["rel", "name", "_salt"]).select("paper_id", "entity", "papers")
    lists = found.repartition("paper_id").groupBy("paper_id").agg(pairs.alias("pairs"))
    return lists.select("paper_id", F.col("pairs.entity").alias("own"), F.col("pairs.papers").alias("papers"))


def _least_scores(lists: DataFrame, k: int) -> DataFrame:
    """``(paper_id, least)``, a score that k others reach: more than k begin or end with the same entities behind ``cold``."""
    size, hot = F.size("own"), F.col("cold")

    def part(first: Column, length: Column) -> Column:
        return F.struct(F.slice("own", first, length).alias("held"), _sum(F.slice("weights", first, length)).alias("worth"))

    begins = F.transform(F.sequence(F.lit(1), size - hot), lambda n: part(hot + 1, n))
    ends = F.when(size - hot > 1, F.transform(F.sequence(hot + 2, F.greatest(size, hot + 2)), lambda n: part(n, size)))
    parts = lists.select("paper_id", F.inline(F.concat(begins, F.coalesce(ends, F.slice(begins, 1, 0)))))
    common = parts.groupBy("held").agg(F.count("*").alias("holders")).where(F.col("holders") > k)
    # A semi join, as the planner may broadcast its right side only: ``parts`` have many rows for each of the lists it knows.
    return parts.join(common, "held", "left_semi").groupBy("paper_id").agg(F.max("worth").alias("least"))


def _raised(lists: DataFrame, known: DataFrame) -> DataFrame:
    """``lists`` where ``least`` is at least that of ``known(paper_id, least)``."""
    known = known.select("paper_id", F.col("least").alias("seen"))
    return lists.join(known, "paper_id", "left").withColumn("least", F.greatest("least", "seen")).drop("seen")


def related_top_k(edges: DataFrame, k: int = 10, list_bound: int = LIST_BOUND) -> DataFrame:
    """``(paper_id, rank, related_id, score)``: for every paper the ``k`` others that share most, all if fewer share any.

    The score of two papers is the sum over their shared methods and datasets of 10**12 div papers using it, ties go to
    the smaller id.  Repeated edges count once; authors, empty names and null papers take no part.

    Two papers meet at the rarest entity they share.  An entity that at most ``list_bound`` papers share brings all of
    them together, once.  Others are hot: see ``_hot_pairs``.  A paper asks at no entity that, with all it has beyond,
    stays below a score that ``k`` others are known to reach, and pairs below that score are dropped before they move.
    """
    if k < 1 or list_bound <= k:
        raise ValueError("k must be positive and below list_bound")
    lists = entity_lists(edges.where("paper_id is not null"))
    # The rarest entity with more than k papers.
    least = F.get(_weights(F.filter("papers", lambda n: n > k)), F.lit(0))
    cold = F.size(F.filter("papers", lambda n: n <= list_bound))
    lists = cut_lineage(lists.select("*", F.coalesce(least, F.lit(0)).cast("bigint").alias("least"), cold.alias("cold")))
    full = lists.withColumn("weights", _weights("papers"))
    hot = full.where((F.size("own") > F.col("cold")) & (_sum(F.expr("slice(weights, cold + 1, size(own))")) >= F.col("least")))
    asking = cut_lineage(hot.drop("papers"))
    found = None
    if not asking.isEmpty():
        known, found = _hot_pairs(full.drop("papers"), asking, k, list_bound)
        lists = _raised(lists, known)
    pairs = _cold_pairs(lists)
    found = pairs if found is None else found.unionByName(pairs)
    rank = F.row_number().over(W.partitionBy("paper_id").orderBy(F.col("score").desc(), "related_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("paper_id", "rank", "related_id", "score")


def _cold_pairs(lists: DataFrame) -> DataFrame:
    """``(paper_id, related_id, score)`` of papers whose rarest shared entity is among the first ``cold`` of their lists.

    Every list goes once to each of its cold entities, where at most ``list_bound`` papers are compared.
    """
    rows = lists.agg(F.sum("cold")).first()[0] or 0
    member = lists.withColumn("weights", _weights("papers")).select(
        "paper_id", "own", "papers", "least", "weights", F.posexplode(F.expr("slice(own, 1, cold)")).alias("before", "entity")
    ).withColumn("at", F.col("before") + 1).withColumn("worth", F.get("weights", F.col("before")))
    asks = _reachable()
    member = member.select(
        "entity", "paper_id", "own", F.when(asks, F.col("papers")).alias("papers"), F.when(asks, F.col("least")).alias("least")
    )
    # Short rows that become many: tasks of bounded rows, whatever their bytes.
    dealt = member.repartition(task_count(lists.sparkSession, rows), "entity")
    met = dealt.groupBy("entity").agg(F.collect_list(F.struct("paper_id", "own", "papers", "least")).alias("members"))
    met = met.withColumn("ask", F.explode(F.filter("members", lambda one: one["least"].isNotNull())))
    met = met.select(
        "entity", "ask.*", F.inline(F.transform("members", lambda one: F.struct(one["paper_id"].alias("related_id"), one["own"].alias("other"))))
    ).where(F.col("paper_id") != F.col("related_id"))
    both = compute_once(met, both=F.array_intersect("own", "other")).where(F.get("both", F.lit(0)) == F.col("entity"))
    return _scored(both.withColumn("weights", _weights("papers")))


def _scored(both: DataFrame) -> DataFrame:
    """``(paper_id, related_id, score)`` of pairs that share the entities ``both``, without scores below ``least``."""
    shared = F.zip_with("own", "weights", lambda entity, weight: F.when(F.array_contains("both", entity), weight).otherwise(0))
    scored = compute_once(both.select("paper_id", "related_id", "least", "own", "weights", "both"), score=_sum(shared))
    return scored.where("score >= least").select("paper_id", "related_id", "score")


def _hot_pairs(lists: DataFrame, asking: DataFrame, k: int, list_bound: int) -> tuple[DataFrame, DataFrame]:
    """``(paper_id, least)``, scores that k others are known to reach, and ``(paper_id, related_id, score)`` of papers that
    share only hot entities.

    Sets of entities grow by one entity a round, the rarest first, as a sorted list.  A set held by few papers gives all
    of them as candidates.  For a set held by many, its first ``k + 1`` papers stand for those who share just this set,
    and its supersets for the others.  No set is followed whose entities, with all that a paper has beyond them, stay
    below a score that ``k`` others are known to reach, and only sets that some paper follows are kept.  So one hot
    entity costs a paper ``k + 1`` rows, whatever its number of papers, and each pair is met in one set only.
    """
    asking = cut_lineage(_raised(asking, _least_scores(asking, k)))

    def entities(of: DataFrame) -> DataFrame:
        places = of.select("*", F.posexplode(F.expr("slice(own, cold + 1, size(own))")).alias("before", "last"))
        places = places.withColumn("at", F.col("before") + F.col("cold") + 1).drop("before")
        return places.withColumn("worth", F.element_at("weights", F.col("at")))

    wanted = cut_lineage(entities(asking).where(_reachable()).select("last").distinct())
    level = cut_lineage(entities(lists).join(wanted, "last", "left_semi").withColumn("held", F.array("last")).drop("last"))
    lists = cut_lineage(_raised(level.select(*lists.columns).dropDuplicates(["paper_id"]), asking.select("paper_id", "least")))
    level = _raised(level, asking.select("paper_id", "least"))
    asked, listed = [], []
    while True:
        level = cut_lineage(level.withColumn("reachable", _reachable()))
        holders = level.groupBy("held").agg(F.count("*").alias("holders"), F.max("reachable").alias("wanted")).where("wanted")
        sized = cut_lineage(level.join(holders.drop("wanted"), "held"))
        nth = F.row_number().over(W.partitionBy("held").orderBy("paper_id"))
        few = sized.where(F.col("holders") <= list_bound)
        many = sized.where(F.col("holders") > list_bound)
        first = many.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
        listed.append(few.unionByName(first).select("held", "holders", F.col("paper_id").alias("related_id"), F.col("own").alias("other")))
        asked.append(sized.where("reachable").drop("reachable", "holders", "least"))
        reached = sized.where((F.col("holders") > k) & F.col("reachable")).groupBy("paper_id").agg(F.max("worth").alias("least"))
        lists = cut_lineage(_raised(lists, reached))
        onward = many.where(F.col("at") < F.size("own")).select("paper_id", F.col("at").alias("from"), "held", "worth")
        if onward.isEmpty():
            break
        places = F.sequence(F.col("from") + 1, F.size("own"))
        level = onward.join(lists, "paper_id").withColumn("at", F.explode(places)).select(
            *lists.columns, "at", F.concat("held", F.array(F.element_at("own", F.col("at")))).alias("held"),
            (F.col("worth") + F.element_at("weights", F.col("at"))).alias("worth"),
        )
    found, tasks = None, int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for asks, others in zip(asked, listed, strict=True):
        # Short rows that become many: spread over all tasks whatever their bytes.
        asks = asks.join(lists.select("paper_id", "least"), "paper_id").where(_reachable()).repartition(tasks, "paper_id")
        met = asks.select("paper_id", "own", "weights", "least", "held").join(others, "held")
        both = compute_once(met.where(F.col("paper_id") != F.col("related_id")), both=F.array_intersect("own", "other"))
        same = F.when(F.col("holders") > list_bound, F.col("both") == F.col("held")).otherwise(
            F.slice("both", 1, F.size("held")) == F.col("held")
        )
        pairs = _scored(both.where(same))
        found = pairs if found is None else found.unionByName(pairs)
    return lists.select("paper_id", "least"), found


def _reachable() -> Column:
    """Whether a paper can still get from ``held`` to its ``least`` score with its entities behind ``at``."""
    return F.col("worth") + _sum(F.slice("weights", F.col("at") + 1, F.size("own"))) >= F.col("least")
