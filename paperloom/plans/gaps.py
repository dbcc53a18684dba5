"""Gap reports for many paper sets in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.drafts import gap_sentences
from paperloom.operators.graph import isolated_items, isolated_lists
from paperloom.operators.model import ModelFn, call_model, gap_prompt
from paperloom.session import cut_lineage


def gap_report(members: DataFrame, edges: DataFrame, fn: ModelFn, tasks: int | None = None, **asking) -> DataFrame:
    """Isolated methods and datasets of every set, and the model's sentences about them.

    Sets with nothing isolated make no call; a failed call keeps the facts and leaves the sentences empty. ``tasks`` is
    for :func:`isolated_items`, ``asking`` for :func:`call_model`.
    """
    # Read by the prompts and by the result.
    facts = cut_lineage(isolated_lists(members, isolated_items(members, edges, tasks)))
    something = (F.size("isolated_methods") > 0) | (F.size("isolated_datasets") > 0)
    prompts = facts.where(something).select(
        "set_id", gap_prompt(F.col("isolated_methods"), F.col("isolated_datasets")).alias("prompt")
    )
    sentences = gap_sentences(call_model(prompts, fn, ["set_id"], **asking))
    empty = F.array().cast("array<string>")
    return facts.join(sentences, "set_id", "left").select(
        "set_id",
        "isolated_methods",
        "isolated_datasets",
        F.coalesce("method_gaps", empty).alias("method_gaps"),
        F.coalesce("dataset_gaps", empty).alias("dataset_gaps"),
        F.concat(F.coalesce("method_gaps", empty), F.coalesce("dataset_gaps", empty)).alias("gap_sentences"),
    )
