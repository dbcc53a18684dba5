"""Records at rest as VARIANT: any JSON, read by path without parsing text again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_variants(records: DataFrame, body: str = "body") -> DataFrame:
    """``records`` with the JSON text ``body`` as VARIANT ``record`` and ``readable``.

    Text that is no JSON, an object that names a key twice, and a null text have a null ``record`` and are not readable;
    the JSON value null is.
    """
    parsed = records.withColumn("record", F.try_parse_json(body)).drop(body)
    return parsed.withColumn("readable", F.col("record").isNotNull())


def store_records(records: DataFrame, path: str, body: str = "body") -> None:
    as_variants(records, body).write.mode("append").parquet(path)


def read_records(stored: DataFrame, **fields: tuple[str, str]) -> DataFrame:
    """Columns ``name=(path, type)`` of stored records; absent, null and unfit values are null."""
    read = [F.try_variant_get("record", path, kind).alias(name) for name, (path, kind) in fields.items()]
    return stored.select(*[column for column in stored.columns if column != "record"], *read)
