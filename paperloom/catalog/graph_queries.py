"""Graph tables and graph questions, gap reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.catalog.fixtures import (
    EDGE_VIEW,
    METADATA_WRITES,
    PAPER_VIEW,
    edge_mentions,
    edge_tasks,
    edge_view,
    joined,
    member_view,
    metadata_writes,
    node_view,
    paper_view,
    table,
)
from paperloom.catalog.registry import query
from paperloom.catalog.stubs import gap_stub
from paperloom.operators.graph import (
    asked_papers,
    comparison_flat,
    comparison_table,
    edges_from_papers,
    entity_nodes,
    graph_degree,
    index_counts,
    isolated_items,
    merge_edges,
    paper_nodes,
    related_paper_counts,
    related_papers,
)
from paperloom.operators.graph_store import EdgeStore
from paperloom.operators.model import GAP_INSTRUCTIONS
from paperloom.operators.related import related_top_k
from paperloom.plans.gaps import gap_report
from paperloom.session import cut_lineage, fresh_path


@query(
    "graph_paper_nodes",
    f"""WITH {METADATA_WRITES}, ranked AS (
        SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY seq DESC) AS n FROM metadata_writes)
    SELECT paper_id, title, CAST(year(published_date) AS BIGINT) AS year, source FROM ranked WHERE n = 1""",
)
def _graph_paper_nodes(spark, sf_dir):
    nodes = paper_nodes(metadata_writes(spark, sf_dir), "seq")
    return nodes.withColumn("year", F.col("year").cast("bigint"))


def extracted(spark, sf_dir):
    """Orders as papers with the methods and datasets of their lines, repeats included, and the priority as author."""
    lists = edge_mentions(spark, sf_dir).groupBy("paper_id").agg(
        F.collect_list("method").alias("methods"), F.collect_list("dataset").alias("datasets")
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("paper_id"), F.array("o_orderpriority").alias("authors")
    )
    return orders.join(lists, "paper_id")


EXTRACTED_EDGES = f"""{EDGE_VIEW}, all_edges AS (
    SELECT * FROM edge_view
    UNION ALL SELECT o_orderkey, 'AUTHORED', o_orderpriority FROM orders
    WHERE o_orderkey IN (SELECT paper_id FROM mentions))"""


@query("graph_edges", f"WITH {EXTRACTED_EDGES} SELECT paper_id, rel, name FROM all_edges")
def _graph_edges(spark, sf_dir):
    """Indexing the same papers twice adds nothing."""
    edges = edges_from_papers(extracted(spark, sf_dir))
    return merge_edges(edge_view(spark, sf_dir), edges)


@query(
    "graph_entity_nodes",
    f"""WITH {PAPER_VIEW}, {EDGE_VIEW}
    SELECT DISTINCT CASE rel WHEN 'USES_METHOD' THEN 'Method' ELSE 'Dataset' END AS label, name FROM edge_view
    UNION ALL SELECT DISTINCT 'Author', unnest(authors) FROM paper_view""",
)
def _graph_entity_nodes(spark, sf_dir):
    authored = edges_from_papers(
        paper_view(spark, sf_dir).select(
            "paper_id",
            "authors",
            F.array().cast("array<string>").alias("methods"),
            F.array().cast("array<string>").alias("datasets"),
        )
    )
    edges = edge_view(spark, sf_dir).withColumn("paper_id", F.col("paper_id").cast("string"))
    return entity_nodes(authored.unionByName(edges))


@query(
    "index_counts",
    f"""WITH {EDGE_VIEW} SELECT paper_id, CAST(1 AS BIGINT) AS n_authors, count(*) AS n_methods, count(*) AS n_datasets
    FROM mentions GROUP BY paper_id""",
)
def _index_counts(spark, sf_dir):
    counts = index_counts(extracted(spark, sf_dir))
    return counts.select("paper_id", *[F.col(name).cast("bigint").alias(name) for name in counts.columns[1:]])


@query("graph_degree", f"WITH {EDGE_VIEW} SELECT rel, name, count(*) AS papers FROM edge_view GROUP BY rel, name")
def _graph_degree(spark, sf_dir):
    return graph_degree(edge_view(spark, sf_dir))


_LISTS = """lists AS (
    SELECT n.paper_id, n.title, n.year,
           string_agg(name, '{0}' ORDER BY name) FILTER (WHERE rel = 'USES_METHOD') AS methods,
           string_agg(name, '{0}' ORDER BY name) FILTER (WHERE rel = 'EVALUATED_ON') AS datasets
    FROM node_view n LEFT JOIN edge_view e ON e.paper_id = n.paper_id GROUP BY ALL)"""


def _shown(comparison):
    return comparison.select(
        "paper_id", "title", F.col("year").cast("bigint").alias("year"),
        joined("methods").alias("methods"), joined("datasets").alias("datasets"),
    )


_SHOWN_SQL = """SELECT paper_id, title, CAST(year AS BIGINT) AS year, coalesce(methods, '') AS methods,
    coalesce(datasets, '') AS datasets FROM lists"""


@query("comparison_table", f"WITH {EDGE_VIEW}, {_LISTS.format('|')} {_SHOWN_SQL}")
def _comparison_table(spark, sf_dir):
    return _shown(comparison_table(node_view(spark, sf_dir), edge_view(spark, sf_dir)))


@query(
    "comparison_flat",
    f"""WITH {EDGE_VIEW}, {_LISTS.format(', ')} SELECT paper_id, title, coalesce(CAST(year AS VARCHAR), '-') AS year,
    coalesce(methods, '-') AS methods, coalesce(datasets, '-') AS datasets FROM lists""",
)
def _comparison_flat(spark, sf_dir):
    return comparison_flat(comparison_table(node_view(spark, sf_dir), edge_view(spark, sf_dir)))


@query(
    "compare_semi",
    f"""WITH {EDGE_VIEW}, {_LISTS.format('|')} {_SHOWN_SQL}
    WHERE paper_id IN (SELECT l_partkey * 11 FROM lineitem)""",
)
def _compare_semi(spark, sf_dir):
    """Asked ids repeat and partly do not exist."""
    ids = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 11).alias("paper_id"))
    nodes = asked_papers(node_view(spark, sf_dir), ids)
    return _shown(comparison_table(nodes, edge_view(spark, sf_dir)))


@query(
    "related_papers",
    f"""WITH {EDGE_VIEW}, asked AS (
        SELECT rel, name, min(paper_id) AS exclude_paper_id FROM edge_view GROUP BY rel, name)
    SELECT CASE rel WHEN 'USES_METHOD' THEN 'method' ELSE 'dataset' END AS entity_type, name AS entity_name,
           exclude_paper_id, n.paper_id, n.title, CAST(n.year AS BIGINT) AS year
    FROM asked JOIN edge_view e USING (rel, name) JOIN node_view n ON n.paper_id = e.paper_id
    WHERE e.paper_id <> exclude_paper_id""",
)
def _related_papers(spark, sf_dir):
    """What else used each entity that its first paper used."""
    edges = edge_view(spark, sf_dir)
    kind = F.when(F.col("rel") == "USES_METHOD", F.lit("method")).otherwise(F.lit("dataset"))
    asked = edges.groupBy("rel", "name").agg(F.min("paper_id").alias("exclude_paper_id")).select(
        kind.alias("entity_type"), F.col("name").alias("entity_name"), "exclude_paper_id"
    )
    found = related_papers(asked, edges, node_view(spark, sf_dir))
    return found.withColumn("year", F.col("year").cast("bigint"))


@query(
    "related_paper_counts",
    f"""WITH {EDGE_VIEW} SELECT paper_id, rel, name, count(*) OVER (PARTITION BY rel, name) - 1 AS other_papers
    FROM edge_view""",
)
def _related_paper_counts(spark, sf_dir):
    return related_paper_counts(edge_view(spark, sf_dir))


@query(
    "related_top_k",
    """WITH used AS (
        SELECT DISTINCT l_orderkey AS paper_id, 'm' AS rel, l_suppkey AS name FROM lineitem
        UNION ALL SELECT DISTINCT l_orderkey, 'd', l_partkey FROM lineitem),
    weighed AS (SELECT *, 1000000000000 // count(*) OVER (PARTITION BY rel, name) AS weight FROM used),
    pairs AS (
        SELECT a.paper_id, b.paper_id AS related_id, CAST(sum(a.weight) AS BIGINT) AS score
        FROM weighed a JOIN weighed b ON a.rel = b.rel AND a.name = b.name AND a.paper_id <> b.paper_id
        GROUP BY a.paper_id, b.paper_id),
    ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, related_id) AS INTEGER) AS rank FROM pairs)
    SELECT paper_id, rank, related_id, score FROM ranked WHERE rank <= 10""",
)
def _related_top_k(spark, sf_dir):
    """Orders as papers, their suppliers as methods and their parts as datasets."""
    lines = table(spark, sf_dir, "lineitem")
    used = lines.select(F.col("l_orderkey").alias("paper_id"), F.lit("USES_METHOD").alias("rel"), F.col("l_suppkey").cast("string").alias("name"))
    parts = lines.select(F.col("l_orderkey").alias("paper_id"), F.lit("EVALUATED_ON").alias("rel"), F.col("l_partkey").cast("string").alias("name"))
    return related_top_k(used.unionByName(parts))


ISOLATED_SQL = f"""{EDGE_VIEW}, isolated AS (
    SELECT set_id, rel, name FROM member_view JOIN edge_view USING (paper_id)
    GROUP BY set_id, rel, name HAVING count(*) = 1)"""


@query("isolated_items", f"WITH {ISOLATED_SQL} SELECT set_id, rel, name FROM isolated")
def _isolated_items(spark, sf_dir):
    return isolated_items(member_view(spark, sf_dir), edge_view(spark, sf_dir), edge_tasks(spark, sf_dir))


def _grown(spark, sf_dir):
    """The edges in a store, five eighths at first, the others in three additions that repeat some of what is there; a part
    is taken out on the way and put back."""
    edges = cut_lineage(edge_view(spark, sf_dir))
    part = F.pmod(F.xxhash64("paper_id", "rel", "name"), F.lit(8))
    store = EdgeStore.create(edges.where(part < 5), member_view(spark, sf_dir), fresh_path(spark, "edges"))
    store.add(edges.where(part.isin(4, 5)))
    store.remove(edges.where(part.isin(0, 7)))
    store.add(edges.where(part.isin(0, 6)))
    store.add(edges.where(part == 7))
    return store


@query("degree_delta", f"WITH {EDGE_VIEW} SELECT rel, name, count(*) AS papers FROM edge_view GROUP BY rel, name")
def _degree_delta(spark, sf_dir):
    return _grown(spark, sf_dir).degrees()


@query("isolated_delta", f"WITH {ISOLATED_SQL} SELECT set_id, rel, name FROM isolated")
def _isolated_delta(spark, sf_dir):
    return _grown(spark, sf_dir).isolated()


@query(
    "gap_report",
    f"""WITH {ISOLATED_SQL}, facts AS (
        SELECT set_id, coalesce(string_agg(name, ', ' ORDER BY name) FILTER (WHERE rel = 'USES_METHOD'), '') AS methods,
               coalesce(string_agg(name, ', ' ORDER BY name) FILTER (WHERE rel = 'EVALUATED_ON'), '') AS datasets
        FROM (SELECT DISTINCT set_id FROM member_view) LEFT JOIN isolated USING (set_id) GROUP BY set_id),
    prompts AS (
        SELECT *, '{GAP_INSTRUCTIONS}' || chr(10) || 'Methods: ' || coalesce(nullif(methods, ''), '(none)') || chr(10)
            || 'Datasets: ' || coalesce(nullif(datasets, ''), '(none)') AS prompt
        FROM facts),
    answered AS (
        SELECT *, (methods <> '' OR datasets <> '') AND length(prompt) % 11 <> 0 AND length(prompt) % 7 <> 0
                  AND length(prompt) % 5 <> 0 AS good
        FROM prompts)
    SELECT set_id, methods AS isolated_methods, datasets AS isolated_datasets,
           CASE WHEN good THEN 'm ' || md5(prompt) || '|m' ELSE '' END AS method_gaps,
           CASE WHEN good THEN 'd ' || length(prompt) ELSE '' END AS dataset_gaps,
           CASE WHEN good THEN 'm ' || md5(prompt) || '|m|d ' || length(prompt) ELSE '' END AS gap_sentences
    FROM answered""",
)
def _gap_report(spark, sf_dir):
    report = gap_report(member_view(spark, sf_dir), edge_view(spark, sf_dir), gap_stub, edge_tasks(spark, sf_dir))
    return report.select(
        "set_id",
        joined("isolated_methods", ", ").alias("isolated_methods"),
        joined("isolated_datasets", ", ").alias("isolated_datasets"),
        *[joined(name).alias(name) for name in ("method_gaps", "dataset_gaps", "gap_sentences")],
    )
