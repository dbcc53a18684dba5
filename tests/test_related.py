import random
from collections import defaultdict

import pytest

from paperloom.operators import related
from paperloom.operators.related import WEIGHT_UNIT, related_top_k
from paperloom.session import cut_lineage

EDGE = "paper_id long, rel string, name string"
M, D = "USES_METHOD", "EVALUATED_ON"


def brute(rows, k):
    users = defaultdict(set)
    for paper, rel, name in rows:
        if paper is not None and rel in (M, D) and name and name.strip():
            users[rel, name].add(paper)
    scores = defaultdict(lambda: defaultdict(int))
    for papers in users.values():
        for one in papers:
            for other in papers - {one}:
                scores[one][other] += WEIGHT_UNIT // len(papers)
    return {
        (one, rank + 1, other, score)
        for one, others in scores.items()
        for rank, (other, score) in enumerate(sorted(others.items(), key=lambda pair: (-pair[1], pair[0]))[:k])
    }


def found(spark, rows, k, bound):
    return {tuple(row) for row in related_top_k(spark.createDataFrame(rows, EDGE), k, bound).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    """Hot entities that share papers with each other, rare ones, ties, repeats and rows that take no part."""
    dice = random.Random(seed)
    rows = [(None, M, "hot"), (1, M, None), (1, M, "  "), (1, "AUTHORED", "hot"), (999, D, "alone")]
    for paper in range(150):
        rows += [(paper, M, f"m{dice.randrange(4)}") for _ in range(dice.randrange(4))]
        rows += [(paper, D, f"d{int(dice.paretovariate(0.8)) % 40}") for _ in range(dice.randrange(4))]
        if paper % 3 == 0:
            rows += [(paper, M, "hot"), (paper, M, "hot")]
    assert found(spark, rows, 3, 8) == brute(rows, 3)


def test_papers_that_are_nearly_the_same(spark):
    """Every subset of their entities is held by all, of which only the full set is followed."""
    rows = [(paper, D, f"d{n}") for paper in range(40) for n in range(5)] + [(paper, M, f"own{paper // 2}") for paper in range(40)]
    assert found(spark, rows, 2, 5) == brute(rows, 2)


def test_hot_entity_gives_no_quadratic_rows(spark):
    papers = 30_000
    edges = spark.range(papers).selectExpr("id AS paper_id", f"'{M}' AS rel", "'hot' AS name")
    edges = edges.unionByName(spark.range(papers).selectExpr("id AS paper_id", f"'{D}' AS rel", "concat('d', id) AS name"))
    rows = related_top_k(edges, 2, 4).where("paper_id in (0, 1, 29999)").collect()
    assert {(row.paper_id, row["rank"], row.related_id) for row in rows} == {
        (0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (29999, 1, 0), (29999, 2, 1)
    }


@pytest.mark.parametrize("k, bound", [(1, 2), (3, 4), (2, 30), (4, 60)])
def test_equals_all_pairs_whatever_is_hot(spark, k, bound):
    dice = random.Random(bound)
    rows = [(paper, dice.choice((M, D)), f"n{int(dice.paretovariate(0.5)) % 25}") for paper in range(60) for _ in range(5)]
    rows += [(paper, M, "all") for paper in range(0, 60, 2)] + [(paper, D, f"pair{paper // 2}") for paper in range(20)]
    assert found(spark, rows, k, bound) == brute(rows, k)


def test_hot_entities_cost_nothing_beside_rarer_ones(spark, monkeypatch):
    """Each use of an entity was a row with both lists of its paper, written and dealt out several times."""
    rows = [(paper, D, f"d{paper // 6}") for paper in range(60)] + [(paper, M, f"hot{n}") for paper in range(60) for n in range(3)]
    written = []

    def counted(df):
        stored = cut_lineage(df)
        written.append(stored.count())
        return stored

    monkeypatch.setattr(related, "cut_lineage", counted)
    assert found(spark, rows, 3, 8) == brute(rows, 3)
    assert sum(written) <= 60 + 13


def test_rows_of_lists_are_never_broadcast(spark):
    """The planner takes rows made of a small file's rows for as small as the file: 16 copies of every entity went to the driver."""

    def plan(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    rows = [(paper, D, f"d{n}") for paper in range(40) for n in range(paper % 3, 5)]
    copies = plan(related.entity_lists(spark.createDataFrame(rows, EDGE)))
    assert "SortMergeJoin [rel" in copies and "BroadcastHashJoin [rel" not in copies
    lists = [(paper, list(range(n)), [5] * n, 1, 0) for paper in range(40) for n in (2 + paper % 3,)]
    lists = cut_lineage(spark.createDataFrame(lists, "paper_id long, own array<int>, weights array<long>, least long, cold int"))
    scores = related._least_scores(lists, 3)
    assert "LeftSemi" in plan(scores) and "BuildLeft" not in plan(scores)
    assert {(row.paper_id, row.least) for row in scores.collect()} == {(paper, 5 * (2 + paper % 3)) for paper in range(40)}


def test_nothing_shared(spark):
    assert found(spark, [(1, M, "a"), (2, M, "b")], 2, 4) == set()
    assert related_top_k(spark.createDataFrame([], EDGE)).count() == 0
    with pytest.raises(ValueError):
        related_top_k(spark.createDataFrame([], EDGE), 5, 5)
