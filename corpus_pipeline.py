"""Stages that turn raw documents into packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from paperloom.llm.common import bound_batches, row_key, table
from paperloom.llm.decontamination import find_leaks
from paperloom.llm.jaccard import near_duplicates
from paperloom.llm.language import predictions, train, training_sample
from paperloom.llm.packing import pack_documents
from paperloom.llm.substrings import remove_repeats
from paperloom.session import fresh_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language, null and letterless texts, go; a missing ``lang`` is filled in.

    It is filled with the predicted one, which is ``und`` where no document that training may see has a language.
    """
    network = train(training_sample(docs))
    plain = _plain(docs)
    found = predictions(plain, network, [name for name in plain.columns if name != "doc_id"]).where("lettered")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*plain.columns).toDF(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join over five words at a similarity of 0.8: the document of the smallest id of each group stays.

    Rows equal in id and text become one, of several the one with the smallest other columns. Different texts of one id
    are one document and stay or go together; a null id links with nothing, so its different texts stay.
    """
    plain = _plain(docs)
    found = near_duplicates(plain, words=5, percent=80)
    kept = _without(plain, found.where("component_id <> doc_id").select("doc_id"))
    others = [field for field in plain.schema if field.name not in ("doc_id", "text")]
    # Maps have no order, their sorted entries do.
    order = [
        F.sort_array(F.map_entries(field.name)) if isinstance(field.dataType, MapType) else F.col(field.name) for field in others
    ]
    once = kept.groupBy("doc_id", "text").agg(
        F.min_by(F.struct(*[field.name for field in others]), F.struct(*order)).alias("others")
    )
    return once.select("doc_id", "text", "others.*").select(*plain.columns).toDF(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: words of repeated windows of 35 go; texts without one stay as they are.

    So do null, empty and short texts; ``n_chars`` is counted anew, all other columns stay. Repeated rows lose each other's
    words. An empty table gives no rows.
    """
    plain = _plain(docs)
    found = remove_repeats(plain, carry=[name for name in plain.columns if name not in ("doc_id", "n_chars")])
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    new = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return found.select(*[new.get(name, F.col(name)) for name in plain.columns]).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go.

    Null and empty texts hold none, very long ones are searched whole. Rows are judged by id and text, so repeated rows go or
    stay together and a null id is an id of its own. An empty table gives no rows.
    """
    plain = _plain(docs)
    keyed = plain.withColumn("row_key", row_key())
    found = find_leaks(keyed, table(spark, sf_dir, "benchmark"), carry=["row_key"])
    return _without(keyed, found.select("doc_id", "row_key")).select(*plain.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: a row per piece with its sequence and its place there.

    A null text is empty, repeated rows are packed each, very long texts in several pieces. Further columns are ignored, an
    empty table gives no rows.
    """
    bound_batches(spark)
    return pack_documents(docs)


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with columns besides those of documents named by their place, so that no name clashes or needs quotes."""
    bound_batches(docs.sparkSession)
    own = ("doc_id", "text", "lang", "source", "n_chars")
    return docs.toDF(*[name if name in own else f"carried_{place}" for place, name in enumerate(docs.columns)])


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are equal to no rejected row in all of its columns; nulls are equal."""
    rejected = rejected.distinct()
    gone = rejected.select(*[F.col(name).alias(f"rejected_{name}") for name in rejected.columns])
    same = [F.col(name).eqNullSafe(F.col(f"rejected_{name}")) for name in rejected.columns]
    return docs.join(gone, same, "left_anti")


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicate),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: Learnt languages, tokenizers and edit distances are not SQL; the stages are tested one by one against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        kept = stage(spark, docs, sf_dir)
        path = fresh_path(spark, "stage")
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return docs
