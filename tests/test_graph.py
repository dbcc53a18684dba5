from datetime import date

from paperloom.operators.graph import (
    asked_papers,
    comparison_flat,
    comparison_table,
    edges_from_papers,
    entity_nodes,
    graph_degree,
    index_counts,
    isolated_items,
    isolated_lists,
    merge_edges,
    paper_nodes,
    related_paper_counts,
    related_papers,
)
from paperloom.plans.gaps import gap_report

EDGE = "paper_id string, rel string, name string"
M, D = "USES_METHOD", "EVALUATED_ON"


def edges(spark, *rows):
    return spark.createDataFrame(rows, EDGE)


def nodes(spark, *ids):
    return spark.createDataFrame([(key, f"T{key}", 2020) for key in ids], "paper_id string, title string, year int")


def members(spark, *rows):
    return spark.createDataFrame(rows, "set_id int, paper_id string")


def test_indexing_a_paper(spark):
    paper = spark.createDataFrame(
        [("p", ["A", "B"], ["m", "m"], ["d"])],
        "paper_id string, authors array<string>, methods array<string>, datasets array<string>",
    )
    found = edges_from_papers(paper)
    assert found.count() == 4 and merge_edges(found, found).count() == 4
    assert {tuple(row) for row in entity_nodes(found).collect()} == {("Author", "A"), ("Author", "B"), ("Method", "m"), ("Dataset", "d")}
    assert tuple(index_counts(paper).first()) == ("p", 2, 2, 1)
    grown = merge_edges(found, edges(spark, ("p", M, "new")))
    assert grown.count() == 5
    assert grown.groupBy("paper_id", "rel", "name").count().where("count > 1").isEmpty()


def test_paper_nodes_take_the_last_write(spark):
    writes = spark.createDataFrame(
        [("p", "old", date(2001, 1, 1), "arxiv", 1), ("p", "new", None, "pubmed", 2)],
        "paper_id string, title string, published_date date, source string, seq int",
    )
    assert [tuple(row) for row in paper_nodes(writes, "seq").collect()] == [("p", "new", None, "pubmed")]


def test_comparison_drops_empty_names(spark):
    table = comparison_table(nodes(spark, "a", "b"), edges(spark, ("a", M, None), ("a", D, "ImageNet"), ("a", D, "")))
    rows = {row.paper_id: row for row in table.collect()}
    assert (rows["a"].methods, rows["a"].datasets) == ([], ["ImageNet"])
    assert (rows["b"].methods, rows["b"].datasets) == ([], [])
    flat = {row.paper_id: row for row in comparison_flat(table).collect()}
    assert (flat["a"].methods, flat["a"].datasets, flat["a"].year) == ("-", "ImageNet", "2020")


def test_comparison_never_multiplies_lists(spark):
    plan = comparison_table(nodes(spark, "a"), edges(spark, ("a", M, "m")))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_unknown_and_repeated_ids(spark):
    ids = spark.createDataFrame([("a",), ("a",), ("zzz",)], "paper_id string")
    assert [row.paper_id for row in asked_papers(nodes(spark, "a", "b"), ids).collect()] == ["a"]


def test_related_papers(spark):
    graph = edges(spark, ("a", M, "x"), ("b", M, "x"), ("c", D, "x"), ("b", D, "y"))
    asked = spark.createDataFrame(
        [("method", "x", "a"), ("method", "x", None), ("dataset", "x", None), ("method", "none", None)],
        "entity_type string, entity_name string, exclude_paper_id string",
    )
    found = related_papers(asked, graph, nodes(spark, "a", "b", "c")).collect()
    assert sorted((row.entity_type, str(row.exclude_paper_id), row.paper_id) for row in found) == [
        ("dataset", "None", "c"), ("method", "None", "a"), ("method", "None", "b"), ("method", "a", "b"),
    ]
    counts = {(row.paper_id, row.rel, row.name): row.other_papers for row in related_paper_counts(graph).collect()}
    assert counts == {("a", M, "x"): 1, ("b", M, "x"): 1, ("c", D, "x"): 0, ("b", D, "y"): 0}


def test_a_hot_entity_is_whole(spark):
    """One method used by a third of all edges, asked for with an exclusion."""
    rows = [(f"p{n}", M, "hot" if n % 3 == 0 else f"m{n}") for n in range(3000)]
    graph = edges(spark, *rows)
    asked = spark.createDataFrame([("method", "hot", "p0")], "entity_type string, entity_name string, exclude_paper_id string")
    found = {row.paper_id for row in related_papers(asked, graph, nodes(spark, *[row[0] for row in rows])).collect()}
    assert found == {f"p{n}" for n in range(3, 3000, 3)}
    assert {row.papers for row in graph_degree(graph).where("name = 'hot'").collect()} == {1000}


def isolated(spark, graph, member_rows):
    group = members(spark, *member_rows)
    lists = isolated_lists(group, isolated_items(group, graph)).collect()
    return {row.set_id: (row.isolated_methods, row.isolated_datasets) for row in lists}


def test_isolated_items(spark):
    graph = edges(spark, ("p", M, "A"), ("p", M, "B"), ("q", M, "B"), ("q", M, "C"), ("r", M, "A"), ("r", M, "B"))
    sets = [(1, "p"), (1, "q"), (1, "q"), (2, "p"), (2, "r"), (3, "none")]
    assert isolated(spark, graph, sets) == {1: (["A", "C"], []), 2: ([], []), 3: ([], [])}


def test_gap_report_keeps_facts_when_the_model_fails(spark):
    calls = []

    def broken(prompts):
        raise RuntimeError("down")

    graph = edges(spark, ("p", M, "A"), ("q", D, "Z"))
    report = gap_report(members(spark, (1, "p"), (1, "q"), (2, "none")), graph, broken)
    rows = {row.set_id: row for row in report.collect()}
    assert (rows[1].isolated_methods, rows[1].isolated_datasets, rows[1].method_gaps) == (["A"], ["Z"], [])
    assert rows[2].isolated_methods == [] and not calls
