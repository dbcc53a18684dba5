"""First-wins dedupe kept up to date: insertions change only what their keys reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.dedupe import first_wins
from paperloom.operators.tables import BUCKET_ROWS, BucketFolders
from paperloom.session import cut_lineage

ROW = ["scope", "ord"]
KEY = ["scope", "side", "key"]


def _entries(rows: DataFrame) -> DataFrame:
    """A row for each key of ``rows(scope, ord, doi_key, title_key, ...)``."""
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{side}_key").alias("key")) for side in ("doi", "title")])
    return rows.select("*", F.inline(F.filter(sides, lambda side: side["key"].isNotNull())))


def create_kept(keyed: DataFrame, path: str, bucket_entries: int = BUCKET_ROWS) -> None:
    """Decide ``keyed(scope, ord, doi_key, title_key)`` and lay the decisions out by key at ``path``.

    ``ord`` is unique within its scope. Rows without a key share nothing with others, are always kept, and have no place in
    the table.
    """
    kept = first_wins(keyed).withColumn("kept", F.lit(True))
    rows = keyed.join(kept, ROW, "left").select(*ROW, "doi_key", "title_key", F.coalesce("kept", F.lit(False)).alias("kept"))
    BucketFolders.create(cut_lineage(_entries(rows)), path, KEY, bucket_entries)


def kept_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(scope, ord)`` of all kept rows that have a key."""
    return BucketFolders(spark, path).all().where("kept").select(*ROW).distinct()


def insert_kept(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """Add ``new(scope, ord, doi_key, title_key)`` anywhere in the order, store what follows, and return it:
    ``(scope, ord, doi_key, title_key, was, kept)`` of the new rows (``was`` is null) and of the stored ones looked at.

    A row that becomes kept can only drop the one row that was kept for a key of its and comes later; one that is dropped
    can only let in later rows of its keys. So the rows looked at start with the new ones and grow from those whose
    decision changes, until none does; all others stand, and those kept among them hold back later rows as before. New
    rows that repeat a stored ``ord`` are not added again.
    """
    table = BucketFolders(spark, path)
    keyed = new.where(F.col("doi_key").isNotNull() | F.col("title_key").isNotNull()).select(*ROW, "doi_key", "title_key")
    known = table.of(_entries(keyed)).select(*ROW).distinct()
    looked_at = cut_lineage(keyed.join(known, ROW, "left_anti").dropDuplicates(ROW).withColumn("was", F.lit(None).cast("boolean")))
    while True:
        keys = _entries(looked_at)
        near = cut_lineage(table.of(keys).join(looked_at.select(*ROW), ROW, "left_anti"))
        # A key has one kept row at most.
        holders = near.where("kept").select(*KEY, F.col("ord").alias("holder"))
        held = keys.join(holders, KEY).where(F.col("holder") < F.col("ord")).select(*ROW).distinct()
        free = looked_at.join(held, ROW, "left_anti").select(*ROW, "doi_key", "title_key")
        kept = first_wins(free).withColumn("kept", F.lit(True))
        decided = cut_lineage(looked_at.join(kept, ROW, "left").withColumn("kept", F.coalesce("kept", F.lit(False))))
        changed = _entries(decided.where(F.col("kept") != F.coalesce("was", F.lit(False))))
        turns = changed.groupBy(*KEY).agg(
            F.min(F.when(F.col("kept"), F.col("ord"))).alias("entered"), F.min(F.when(~F.col("kept"), F.col("ord"))).alias("left")
        )
        after = F.when(F.col("kept"), F.col("entered")).otherwise(F.col("left"))
        reached = near.join(turns, KEY).where(F.col("ord") > after)
        more = cut_lineage(reached.select(*ROW, "doi_key", "title_key", F.col("kept").alias("was")).distinct())
        if more.isEmpty():
            break
        looked_at = cut_lineage(looked_at.unionByName(more))
    new = cut_lineage(_entries(decided.where(F.col("was").isNull() | (F.col("was") != F.col("kept"))).drop("was")))
    table.replace(new, [*KEY, "ord"], new)
    return decided
