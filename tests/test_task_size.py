"""Work is cut by rows where a task's share would otherwise grow with the input."""

import pytest
from pyspark.sql import functions as F

from paperloom import session
from paperloom.catalog.fixtures import edge_tasks, edge_view, member_view
from paperloom.operators.graph import edges_from_papers, isolated_items

LINES = 300


@pytest.fixture
def tables(spark, tmp_path):
    lines = spark.range(LINES).select((F.col("id") % 90).alias("l_orderkey"), (F.col("id") % 7).alias("l_partkey"))
    orders = spark.range(90).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 5).alias("o_custkey"), F.lit("2001-01-01").cast("date").alias("o_orderdate")
    )
    parts = spark.range(7).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("b"), F.col("id") % 3).alias("p_brand"), F.concat(F.lit("t"), "id").alias("p_type")
    )
    for name, rows in (("lineitem", lines), ("orders", orders), ("part", parts)):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_edges_come_in_tasks_of_bounded_rows(spark, tables, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    edges = edge_view(spark, tables)
    assert edges.rdd.getNumPartitions() == LINES // 20
    items = isolated_items(member_view(spark, tables), edges, edge_tasks(spark, tables))
    assert items.rdd.getNumPartitions() == LINES // 20
    plain = isolated_items(member_view(spark, tables), edges)
    assert sorted(map(tuple, items.collect())) == sorted(map(tuple, plain.collect()))


def test_edges_of_papers_stay_where_the_papers_are(spark):
    kind = "paper_id int, authors array<string>, methods array<string>, datasets array<string>"
    rows = [(n, ["A", None], None if n % 2 else ["m", "m"], [f"d{n}"]) for n in range(40)]
    found = edges_from_papers(spark.createDataFrame(rows, kind).repartition(9, "paper_id"))
    assert found.rdd.getNumPartitions() == 9
    wanted = {(n, "AUTHORED", name) for n in range(40) for name in ("A", None)} | {(n, "EVALUATED_ON", f"d{n}") for n in range(40)}
    wanted |= {(n, "USES_METHOD", "m") for n in range(0, 40, 2)}
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))
