"""Stored tables laid out by key: bucketed tables that joins read without a shuffle, and folders read by bucket."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.session import cut_lineage

#: Rows of a bucket, about, when a table is laid out.
BUCKET_ROWS = 1_000_000
GENERATION = "generation"


def _buckets(rows: DataFrame, bucket_rows: int) -> int:
    return max(1, -(-rows.count() // bucket_rows))


class KeyedTable:
    """Rows by key, as a Spark bucketed table under ``path``: a write replaces all rows of the keys it brings.

    Writes append a generation each, into the buckets of its keys; reading takes the newest generation of every key.
    Buckets hold all generations of a key, so neither that nor a join by key shuffles the table. The number of buckets
    follows from the rows at creation and is stored with them; ``compact`` lays a grown table out anew. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        layout = spark.read.parquet(f"{path}/layout").first()
        self.key, self.buckets = layout.key, layout.buckets
        self.name = f"keyed_{hashlib.md5(path.encode()).hexdigest()}"
        if not spark.catalog.tableExists(self.name):
            kind = spark.read.parquet(f"{path}/kind").schema
            columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in kind)
            place = f"{path}/rows".replace("'", "\\'")
            spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{place}'")

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, bucket_rows: int = BUCKET_ROWS) -> KeyedTable:
        """Write the first generation; ``rows`` must not have a column of that name."""
        spark = rows.sparkSession
        stored = cut_lineage(rows)
        stored.limit(0).withColumn(GENERATION, F.lit(0).cast("long")).write.parquet(f"{path}/kind")
        spark.createDataFrame([(key, _buckets(stored, bucket_rows))], "key string, buckets int").write.parquet(f"{path}/layout")
        table = cls(spark, path)
        table.write(stored)
        return table

    def write(self, rows: DataFrame) -> None:
        """Replace the rows of every key in ``rows``; other keys stay. A null key is a key like any other."""
        newest = self.spark.table(self.name).agg(F.max(GENERATION)).first()[0]
        number = F.lit(0 if newest is None else newest + 1).cast("long").alias(GENERATION)
        columns = [F.col(name) for name in self.spark.table(self.name).columns if name != GENERATION]
        rows.select(*columns, number).repartition(self.buckets, self.key).write.insertInto(self.name)

    def read(self) -> DataFrame:
        newest = F.max(GENERATION).over(W.partitionBy(self.key))
        rows = self.spark.table(self.name).withColumn("_newest", newest)
        return rows.where(F.col(GENERATION) == F.col("_newest")).drop(GENERATION, "_newest")

    def compact(self, path: str, bucket_rows: int = BUCKET_ROWS) -> KeyedTable:
        """The current rows as one generation at a new path, with a number of buckets that fits them."""
        return KeyedTable.create(self.read(), path, self.key, bucket_rows)


class BucketFolders:
    """Rows under ``path``, in a folder for each bucket of some key columns: a few keys read their folders and no others."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        layout = spark.read.parquet(f"{path}/layout").first()
        self.keys, self.buckets = list(layout["keys"]), layout.buckets
        self.kind = spark.read.parquet(f"{path}/kind").schema.add("bucket", T.IntegerType())

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> BucketFolders:
        """Lay out ``rows``, which are read twice: once to be counted."""
        spark = rows.sparkSession
        spark.createDataFrame([(list(keys), _buckets(rows, bucket_rows))], "keys array<string>, buckets int").write.parquet(f"{path}/layout")
        # The rows of an empty table have no folder that could tell their columns.
        spark.createDataFrame([], rows.schema).write.parquet(f"{path}/kind")
        folders = cls(spark, path)
        folders._placed(rows).write.partitionBy("bucket").parquet(f"{path}/rows")
        return folders

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _placed(self, rows: DataFrame) -> DataFrame:
        bucketed = rows.withColumn("bucket", self.bucket())
        # A bucket is some files, however many of its rows one key has.
        return bucketed.repartition("bucket", F.pmod(F.xxhash64(F.struct(*rows.columns)), F.lit(8)))

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.kind).parquet(f"{self.path}/rows").drop("bucket")

    def around(self, keys: DataFrame) -> DataFrame:
        """All rows, with their ``bucket``, of the buckets that ``keys`` fall into."""
        # Bucket numbers, at most as many as there are.
        numbers = [row[0] for row in keys.select(self.bucket()).distinct().collect()]
        return self.spark.read.schema(self.kind).parquet(f"{self.path}/rows").where(F.col("bucket").isin(numbers))

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys``."""
        return self.around(keys).join(keys.select(*self.keys).distinct(), self.keys, "left_semi").drop("bucket")

    def append(self, rows: DataFrame) -> None:
        self._placed(rows).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/rows")

    def rewrite(self, keys: DataFrame, rows: DataFrame) -> None:
        """Make ``rows``, which are stored elsewhere, all there is in the buckets of ``keys``."""
        emptied = keys.select(self.bucket().alias("bucket")).distinct().join(rows.select(self.bucket().alias("bucket")).distinct(), "bucket", "left_anti")
        self._placed(rows).write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/rows")
        # A bucket without rows has nothing to be overwritten with; its files become one that is empty.
        nothing = self.spark.createDataFrame([], self.kind).drop("bucket")
        for row in emptied.collect():
            nothing.write.mode("overwrite").parquet(f"{self.path}/rows/bucket={row.bucket}")

    def replace(self, gone: DataFrame, same: Sequence[str], new: DataFrame) -> None:
        """Put ``new`` in the place of the rows that equal one of ``gone`` in the columns ``same``, which hold the keys; only
        buckets of ``new`` are rewritten, so ``new`` must have the keys of ``gone``."""
        old = self.around(new).join(gone.select(*same), list(same), "left_anti").drop("bucket")
        merged = cut_lineage(old.unionByName(new))
        target = self._placed(merged).write.partitionBy("bucket").mode("overwrite")
        target.option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/rows")
