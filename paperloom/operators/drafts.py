"""Related-work drafts for many paper sets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.citation import first_author_last_name
from paperloom.functions.text import id_list
from paperloom.operators.model import ModelFn, call_model, draft_prompt, parse_lists
from paperloom.session import cut_lineage


def asked_ids(requests: DataFrame, key: str = "set_id", ids_col: str = "paper_ids") -> DataFrame:
    """``(key, pos, paper_id)`` from comma-separated id lists, repeats kept."""
    return requests.select(key, F.posexplode(id_list(F.col(ids_col))).alias("pos", "paper_id"))


def draft_members(asked: DataFrame, summaries: DataFrame, papers: DataFrame) -> DataFrame:
    """Every asked id with ``included`` and, where included, its note line and reference.

    An id counts as included when both its summary and its metadata are stored.
    """
    meta = papers.select(
        "paper_id",
        F.lit(True).alias("_known"),
        F.concat(
            F.lit("("),
            first_author_last_name(F.col("authors")),
            F.lit(", "),
            F.coalesce(F.year("published_date").cast("string"), F.lit("n.d.")),
            F.lit(") "),
            "title",
            F.lit(": "),
        ).alias("_lead"),
    )
    cards = summaries.select("paper_id", F.lit(True).alias("_summarised"), "tldr", "citation_bibtex")
    joined = asked.join(cards, "paper_id", "left").join(meta, "paper_id", "left")
    included = F.col("_known").isNotNull() & F.col("_summarised").isNotNull()
    return joined.select(
        "set_id",
        "pos",
        "paper_id",
        included.alias("included"),
        F.when(included, F.concat("_lead", "tldr")).alias("note"),
        F.when(included, F.col("citation_bibtex")).alias("reference"),
    )


def draft_included(members: DataFrame) -> DataFrame:
    return members.where("included").select("set_id", "pos", "paper_id", "note", "reference")


def draft_skipped(members: DataFrame) -> DataFrame:
    return members.where(~F.col("included")).select("set_id", "pos", "paper_id")


def _in_order(when: Column, value: str) -> Column:
    ordered = F.sort_array(F.collect_list(F.when(when, F.struct("pos", value))))
    return F.transform(ordered, lambda item: item[value])


def draft_inputs(members: DataFrame) -> DataFrame:
    """Per set, in asked order: the note text, the references and the skipped ids."""
    included = F.col("included")
    return members.groupBy("set_id").agg(
        F.array_join(_in_order(included, "note"), "\n").alias("notes"),
        _in_order(included, "reference").alias("bibtex_references"),
        _in_order(~included, "paper_id").alias("skipped_paper_ids"),
    )


def related_work_draft(members: DataFrame, fn: ModelFn, **asking) -> DataFrame:
    """``(set_id, paragraph, bibtex_references, skipped_paper_ids)``.

    Sets without an included paper are not sent to the model; a failed call or an answer whose paragraph is no text leaves
    an empty paragraph and keeps the references. ``asking`` is for :func:`call_model`.
    """
    # Read by the prompts and by the result.
    inputs = cut_lineage(draft_inputs(members))
    prompts = inputs.where(F.size("bibtex_references") > 0).select("set_id", draft_prompt(F.col("notes")).alias("prompt"))
    answers = call_model(prompts, fn, ["set_id"], **asking)
    document = F.try_parse_json("raw_response")
    is_text = F.schema_of_variant(F.try_variant_get(document, "$.paragraph", "variant")) == "STRING"
    text = F.when(is_text, F.try_variant_get(document, "$.paragraph", "string"))
    paragraphs = answers.select("set_id", text.alias("paragraph"))
    return inputs.join(paragraphs, "set_id", "left").select(
        "set_id",
        F.coalesce("paragraph", F.lit("")).alias("paragraph"),
        "bibtex_references",
        "skipped_paper_ids",
    )


def gap_sentences(responses: DataFrame) -> DataFrame:
    """``method_gaps`` and ``dataset_gaps`` from gap responses."""
    return parse_lists(responses, ("method_gaps", "dataset_gaps"))
