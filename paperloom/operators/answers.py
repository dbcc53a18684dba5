"""Model answers addressed by the digest of their prompt: equal prompts are asked once, within a run and across runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.model import BATCH_SIZE, ModelFn, call_model
from paperloom.operators.tables import BUCKET_ROWS, BucketFolders
from paperloom.session import cut_lineage

ANSWER = "digest string, raw_response string"


def create_answers(spark: SparkSession, path: str, answers: DataFrame | None = None, bucket_rows: int = BUCKET_ROWS) -> BucketFolders:
    """A table of answers by digest at ``path``; ``answers(digest, raw_response)`` start it and set its number of buckets."""
    first = spark.createDataFrame([], ANSWER) if answers is None else answers.select("digest", "raw_response").dropDuplicates(["digest"])
    return BucketFolders.create(first, path, ["digest"], bucket_rows)


def answer_prompts(
    prompts: DataFrame, fn: ModelFn, keys: Sequence[str], path: str, prompt_col: str = "prompt", calls: int | None = None,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """``keys``, ``raw_response``, ``error`` and ``reused`` for every row of ``prompts``.

    Prompts whose digest the table at ``path`` holds are answered from it (``reused``), reading only their buckets. Of the
    others each distinct one goes to ``fn`` once; its answer is added to the table and given to all rows that ask it. A
    prompt that fails is not stored, so the next run asks it again. A null prompt is never asked and is an error.
    """
    spark = prompts.sparkSession
    answers = BucketFolders(spark, path)
    hashed = prompts.select(*keys, F.sha2(prompt_col, 256).alias("digest"), F.col(prompt_col).alias("prompt"))
    # Copies of a prompt combine before the shuffle.
    distinct = hashed.where("digest is not null").groupBy("digest").agg(F.first("prompt").alias("prompt"))
    distinct = cut_lineage(distinct)
    known = cut_lineage(answers.of(distinct).withColumn("reused", F.lit(True)))
    asked = call_model(distinct.join(known, "digest", "left_anti"), fn, ["digest"], calls=calls, batch_size=batch_size)
    answers.append(asked.where("error is null").select("digest", "raw_response"))
    every = known.select("digest", "raw_response", F.lit(None).cast("string").alias("error"), "reused").union(
        asked.select("digest", "raw_response", "error", F.lit(False))
    )
    unasked = F.when(F.col("digest").isNull(), F.lit("no prompt"))
    return hashed.drop("prompt").join(every, "digest", "left").select(
        *keys, "raw_response", F.coalesce("error", unasked).alias("error"), F.coalesce("reused", F.lit(False)).alias("reused")
    )
