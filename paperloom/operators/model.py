"""Prompts, batched model calls, response validation, summary cards, embeddings."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.citation import apa_citation, bibtex_citation
from paperloom.functions.text import clean_names, present
from paperloom.schemas import SUMMARY_FIELDS
from paperloom.session import cut_lineage

ModelFn = Callable[[list[str]], list[str]]

#: Prompts that a model function gets at a time.
BATCH_SIZE = 256

SUMMARY_INSTRUCTIONS = (
    "Explain the paper below to a reader who will not open it. State only what the passages support. "
    "Answer with one JSON object whose values are plain strings under the keys " + ", ".join(SUMMARY_FIELDS) + "."
)
ENTITY_INSTRUCTIONS = (
    "List the methods and the datasets that the passage names. Leave out anything it does not name. "
    "Answer with one JSON object holding the string arrays methods and datasets."
)
GAP_INSTRUCTIONS = (
    "Each method and dataset below is used by a single paper of the reviewed set. For each, write one sentence that "
    "suggests comparing it with other work. Use no other names. "
    "Answer with one JSON object holding the string arrays method_gaps and dataset_gaps."
)
DRAFT_INSTRUCTIONS = (
    "Write one related-work paragraph from the notes below, citing each as (Author, Year). Add no other findings. "
    "Answer with one JSON object holding the string paragraph."
)


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(part) if isinstance(part, str) else part for part in parts])


def summary_prompt(title: Column, chunks: Column) -> Column:
    return _lines(SUMMARY_INSTRUCTIONS, F.concat(F.lit("Title: "), title), "Passages:", F.array_join(chunks, "\n\n"))


def entity_prompt(title: Column, chunks: Column) -> Column:
    return _lines(ENTITY_INSTRUCTIONS, F.concat(F.lit("Title: "), title), "Passage:", F.array_join(chunks, "\n\n"))


def gap_prompt(methods: Column, datasets: Column) -> Column:
    def listed(names: Column) -> Column:
        return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(F.lit("(none)"))

    return _lines(
        GAP_INSTRUCTIONS,
        F.concat(F.lit("Methods: "), listed(methods)),
        F.concat(F.lit("Datasets: "), listed(datasets)),
    )


def draft_prompt(notes: Column) -> Column:
    return _lines(DRAFT_INSTRUCTIONS, "Notes:", notes)


def call_model(
    prompts: DataFrame,
    fn: ModelFn,
    keys: Sequence[str],
    prompt_col: str = "prompt",
    calls: int | None = None,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """``keys``, ``raw_response``, ``error`` and ``latency_ms`` for every prompt.

    ``fn`` maps a list of at most ``batch_size`` prompts to a list of responses.  When it fails on a list the halves are
    tried apart, so a failure stays with its prompt and costs two calls for each halving.  ``calls`` sets how many batches may run at the same time, by
    default as many as there are cores.  The answers are stored before they are used: a plan that reads them twice does not call the model twice.
    """
    schema = T.StructType(
        [T.StructField(key, prompts.schema[key].dataType) for key in keys]
        + [
            T.StructField("raw_response", T.StringType()),
            T.StructField("error", T.StringType()),
            T.StructField("latency_ms", T.DoubleType()),
        ]
    )
    columns = schema.fieldNames()

    def ask(texts: list[str]) -> list[tuple[str | None, str | None, float]]:
        started = time.perf_counter()
        try:
            answers = fn(texts)
            if len(answers) != len(texts):
                raise ValueError(f"{len(answers)} responses for {len(texts)} prompts")
        except Exception as error:
            if len(texts) == 1:
                return [(None, str(error) or type(error).__name__, (time.perf_counter() - started) * 1000)]
            middle = len(texts) // 2
            return ask(texts[:middle]) + ask(texts[middle:])
        each = (time.perf_counter() - started) * 1000 / max(len(texts), 1)
        return [(answer, None, each) for answer in answers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of a batch, only the prompts of one call become Python texts at a time.
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                raw, errors, latencies = zip(*ask(part.column(prompt_col).to_pylist()), strict=True)
                answers = [pa.array(raw, pa.string()), pa.array(errors, pa.string()), pa.array(latencies, pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(key) for key in keys), *answers], names=columns)

    asked = prompts.select(*keys, prompt_col).repartition(calls or prompts.sparkSession.sparkContext.defaultParallelism)
    return cut_lineage(asked.mapInArrow(run, schema))


def _field(document: Column, name: str) -> Column:
    return F.try_variant_get(document, f"$.{name}", "variant")


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def parse_responses(responses: DataFrame, fields: Sequence[str] = SUMMARY_FIELDS) -> DataFrame:
    """Validated text fields of ``responses(..., raw_response, error)``.

    Adds one column per field, ``ok`` and ``message``.  A response must be a JSON object and every field a non-empty
    text; the message names a failed call, an unreadable response, or the missing fields in order.
    """
    keep = [name for name in responses.columns if name not in ("raw_response", "error", "latency_ms")]
    opened = responses.withColumn("_document", F.try_parse_json("raw_response"))
    read = opened.select(
        *keep,
        "error",
        _is(F.col("_document"), "OBJECT").alias("_object"),
        *[
            F.when(_is(_field(F.col("_document"), name), "STRING"), F.try_variant_get("_document", f"$.{name}", "string"))
            .alias(name)
            for name in fields
        ],
    )
    missing = F.filter(
        F.array(*[F.when(~present(F.col(name)), F.lit(name)) for name in fields]), lambda name: name.isNotNull()
    )
    message = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.col("_object"), F.lit("response is not a JSON object"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", ")))
    )
    checked = read.withColumn("message", message).drop("error", "_object")
    return checked.withColumn("ok", F.col("message").isNull())


def _texts(document: Column, name: str) -> Column:
    """The text items of an array field; null when the field is no array."""
    items = F.filter(
        F.try_variant_get(document, f"$.{name}", "array<variant>"), lambda item: _is(item, "STRING")
    )
    return F.transform(items, lambda item: F.try_variant_get(item, "$", "string"))


def parse_lists(responses: DataFrame, fields: Sequence[str], clean: bool = False) -> DataFrame:
    """Text lists from responses; a failed call or anything that is no array gives an empty list."""
    keep = [name for name in responses.columns if name not in ("raw_response", "error", "latency_ms")]
    opened = responses.withColumn("_document", F.try_parse_json("raw_response"))
    empty = F.array().cast("array<string>")
    lists = [
        (clean_names(_texts(F.col("_document"), name)) if clean else F.coalesce(_texts(F.col("_document"), name), empty))
        .alias(name)
        for name in fields
    ]
    return opened.select(*keep, *lists)


def parse_entities(responses: DataFrame) -> DataFrame:
    return parse_lists(responses, ("methods", "datasets"), clean=True)


def summary_cards(parsed: DataFrame, papers: DataFrame) -> DataFrame:
    """Validated fields joined with the two citations of the paper."""
    paper = ("title", "authors", "published_date", "doi", "url")
    citations = papers.select(
        "paper_id",
        apa_citation(*[F.col(name) for name in paper]).alias("citation_apa"),
        bibtex_citation(*[F.col(name) for name in paper]).alias("citation_bibtex"),
    )
    return parsed.where("ok").select("paper_id", *SUMMARY_FIELDS).join(citations, "paper_id")


def embed_chunks(
    chunks: DataFrame, fn: Callable[[list[str]], list[list[float]]] | None = None, dimensions: int = 64
) -> DataFrame:
    """Adds ``embedding`` to chunks: from ``fn`` in batches, else unit-length counts of words by their md5."""
    if fn is not None:

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def embed(texts: pd.Series) -> pd.Series:
            return pd.Series(list(fn(texts.tolist())))

        return chunks.withColumn("embedding", embed("text"))

    from pyspark.ml.feature import CountVectorizerModel, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = F.array_remove(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), "")
    hashed = F.transform(words, lambda word: (F.conv(F.left(F.md5(word), F.lit(8)), 16, 10).cast("bigint") % dimensions).cast("string"))
    tokens = chunks.withColumn("_tokens", F.coalesce(hashed, F.array().cast("array<string>")))
    numbers = [str(number) for number in range(dimensions)]
    counted = CountVectorizerModel.from_vocabulary(numbers, inputCol="_tokens", outputCol="_counts").transform(tokens)
    scaled = Normalizer(inputCol="_counts", outputCol="_scaled").transform(counted)
    return scaled.withColumn("embedding", vector_to_array("_scaled")).drop("_tokens", "_counts", "_scaled")
