"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even when the stage above would have reused the partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

#: Rows of a task, about, where a shuffle is cut by rows: left to itself it ends up in a few tasks, one per core, whose
#: sorts and hash tables grow with the input.
TASK_ROWS = 250_000


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on; safe to call repeatedly."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master, where every task sees the same disk, falls back to a fresh temporary folder.
    """
    context = spark.sparkContext
    active = context.getCheckpointDir()
    if active:
        return active
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="paperloom-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, as a table in the shared folder.

    Lost executors cost nothing behind this point, and the table's real size lets Spark choose join strategies.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are expensive to compute and read by several later expressions.

    A plain projection would be merged into its readers and evaluated once for each of them, filters included; a
    generator is not.
    """
    return df.select("*", F.inline(F.array(F.struct(*[column.alias(name) for name, column in columns.items()]))))


def task_count(spark: SparkSession, rows: int) -> int:
    """Tasks of about TASK_ROWS rows, no fewer than a shuffle has."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a scan with fewer partitions than there are cores to all of them; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
