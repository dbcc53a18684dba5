"""Papers, authors, methods and datasets as node and edge tables, and the questions asked of them.

Edges are ``(paper_id, rel, name)``.  Every question is one hop, so each is a join or an aggregate on this table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import present
from paperloom.operators.store import latest_per_key
from paperloom.schemas import AUTHORED, EVALUATED_ON, NODE_LABELS, USES_METHOD

# Copies made of the small side of a join whose other side may pile up on one key.
SALTS = 16


def paper_nodes(writes: DataFrame, seq: str | Sequence[str]) -> DataFrame:
    """One node per paper; the last write sets title, year and source, nulls included."""
    latest = latest_per_key(writes, "paper_id", seq)
    return latest.select("paper_id", "title", F.year("published_date").alias("year"), "source")


def edges_from_papers(papers: DataFrame) -> DataFrame:
    """Distinct edges of ``papers(paper_id, authors, methods, datasets)``, whose partitioning by paper they keep."""

    def named(rel: str, column: str) -> Column:
        edges = F.transform(column, lambda name: F.struct(F.lit(rel).alias("rel"), name.cast("string").alias("name")))
        return F.coalesce(edges, F.array().cast("array<struct<rel:string,name:string>>"))

    lists = F.concat(named(AUTHORED, "authors"), named(USES_METHOD, "methods"), named(EVALUATED_ON, "datasets"))
    return papers.select("paper_id", F.inline(lists)).distinct()


def new_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The distinct edges of ``new`` that the distinct ``stored`` ones lack: what a run has to append.

    The stored edges are first cut down to those that ``new`` repeats, so a small addition never shuffles them.
    """
    columns = ["paper_id", "rel", "name"]
    offered = new.select(columns).distinct()
    repeated = stored.select(columns).join(offered, columns, "left_semi")
    return offered.join(repeated, columns, "left_anti")


def merge_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Edges only accumulate; each one exists once."""
    return stored.select("paper_id", "rel", "name").unionByName(new_edges(stored, new))


def entity_nodes(edges: DataFrame) -> DataFrame:
    """One node per label and exact name."""
    labels = F.create_map(*[F.lit(item) for pair in NODE_LABELS.items() for item in pair])
    return edges.select(F.try_element_at(labels, F.col("rel")).alias("label"), "name").distinct()


def index_counts(papers: DataFrame) -> DataFrame:
    """Number of authors, methods and datasets handed over per paper."""
    return papers.select("paper_id", *[F.size(name).alias(f"n_{name}") for name in ("authors", "methods", "datasets")])


def graph_degree(edges: DataFrame) -> DataFrame:
    """Papers per entity; edges are distinct, so rows are papers."""
    return edges.groupBy("rel", "name").agg(F.count("*").alias("papers"))


def asked_papers(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes among the asked ids; repeated ids do not repeat rows, unknown ids vanish."""
    return nodes.join(ids.select("paper_id").distinct(), "paper_id", "left_semi")


def _names(rel: str) -> Column:
    return F.sort_array(F.collect_set(F.when((F.col("rel") == rel) & present(F.col("name")), F.col("name"))))


def comparison_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(paper_id, title, year, methods, datasets)``, lists sorted, empty where a paper has none.

    Both lists come from one pass over the edges, so methods and datasets are never multiplied with each other.
    """
    used = edges.where(F.col("rel").isin(USES_METHOD, EVALUATED_ON))
    lists = used.groupBy("paper_id").agg(_names(USES_METHOD).alias("methods"), _names(EVALUATED_ON).alias("datasets"))
    empty = F.array().cast("array<string>")
    return nodes.join(lists, "paper_id", "left").select(
        "paper_id",
        "title",
        "year",
        F.coalesce("methods", empty).alias("methods"),
        F.coalesce("datasets", empty).alias("datasets"),
    )


def comparison_flat(table: DataFrame) -> DataFrame:
    """Display form: lists joined by a comma, '-' for whatever is missing."""

    def shown(text: Column) -> Column:
        return F.when(present(text), text).otherwise(F.lit("-"))

    return table.select(
        "paper_id",
        "title",
        F.coalesce(F.nullif(F.col("year"), F.lit(0)).cast("string"), F.lit("-")).alias("year"),
        shown(F.array_join("methods", ", ")).alias("methods"),
        shown(F.array_join("datasets", ", ")).alias("datasets"),
    )


def _salted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("_salt", F.pmod(F.xxhash64("paper_id"), F.lit(SALTS)).cast("int"))


def _copied(requests: DataFrame) -> DataFrame:
    return requests.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def related_papers(requests: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Papers connected to each asked entity.

    ``requests(entity_type, entity_name, exclude_paper_id)``: any type but ``method`` asks for datasets, and a null
    exclusion excludes nothing.  The edges of one entity are spread over SALTS join partitions.
    """
    rel = F.when(F.col("entity_type") == "method", F.lit(USES_METHOD)).otherwise(F.lit(EVALUATED_ON))
    asked = _copied(requests.withColumn("rel", rel).withColumnRenamed("entity_name", "name"))
    found = asked.join(_salted(edges), ["rel", "name", "_salt"]).where(
        F.col("exclude_paper_id").isNull() | (F.col("paper_id") != F.col("exclude_paper_id"))
    )
    return found.join(nodes, "paper_id").select(
        "entity_type", F.col("name").alias("entity_name"), "exclude_paper_id", "paper_id", "title", "year"
    )


def related_paper_counts(edges: DataFrame) -> DataFrame:
    """For every paper and each method or dataset it uses, how many other papers share it.

    The corpus-wide answer to "what else used this": one row per edge, never one per pair of papers.
    """
    used = edges.where(F.col("rel").isin(USES_METHOD, EVALUATED_ON))
    degree = _copied(graph_degree(used))
    return _salted(used).join(degree, ["rel", "name", "_salt"]).select(
        "paper_id", "rel", "name", (F.col("papers") - 1).alias("other_papers")
    )


def isolated_items(members: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """``(set_id, rel, name)`` of the methods and datasets that exactly one paper of a set uses.

    ``members(set_id, paper_id)`` may repeat papers; ``edges`` are distinct.  ``tasks`` says in how many parts the items
    are counted, by default as many as Spark makes.
    """
    used = edges.where(F.col("rel").isin(USES_METHOD, EVALUATED_ON) & present(F.col("name")))
    in_sets = members.select("set_id", "paper_id").distinct().join(used, "paper_id")
    if tasks is not None:
        in_sets = in_sets.select("set_id", "rel", "name").repartition(tasks, "set_id", "rel", "name")
    counts = in_sets.groupBy("set_id", "rel", "name").agg(F.count("*").alias("papers"))
    return counts.where(F.col("papers") == 1).drop("papers")


def isolated_lists(members: DataFrame, isolated: DataFrame) -> DataFrame:
    """``(set_id, isolated_methods, isolated_datasets)`` for every set, sorted, empty where nothing is isolated."""
    lists = isolated.groupBy("set_id").agg(
        _names(USES_METHOD).alias("isolated_methods"), _names(EVALUATED_ON).alias("isolated_datasets")
    )
    empty = F.array().cast("array<string>")
    return members.select("set_id").distinct().join(lists, "set_id", "left").select(
        "set_id",
        F.coalesce("isolated_methods", empty).alias("isolated_methods"),
        F.coalesce("isolated_datasets", empty).alias("isolated_datasets"),
    )
