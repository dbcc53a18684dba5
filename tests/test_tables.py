from pathlib import Path

from pyspark.sql import functions as F

from paperloom.operators.tables import BucketFolders, KeyedTable
from paperloom.streaming.ingest import store_markers, stored_markers

KIND = "paper_id string, chunk_index int, text string"


def contents(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def break_files(folder):
    for file in [*folder.glob("*.parquet")]:
        (folder / f".{file.name}.crc").unlink(missing_ok=True)
        file.write_bytes(b"not a table")


def test_a_write_replaces_the_rows_of_its_keys(spark, tmp_path):
    rows = [(f"p{n % 40}", n // 40, "old") for n in range(100)]
    table = KeyedTable.create(spark.createDataFrame(rows, KIND), str(tmp_path / "a"), "paper_id", bucket_rows=30)
    assert table.buckets == 4
    new = [("p7", 0, "new"), ("q", 0, "new"), (None, 0, "new"), ("q", 1, None)]
    table.write(spark.createDataFrame(new, KIND))
    rows = [row for row in rows if row[0] != "p7"] + new
    assert contents(table) == sorted(rows, key=str)
    table.write(spark.createDataFrame([], KIND))
    last = [("q", 5, "newest"), (None, 1, "newest")]
    table.write(spark.createDataFrame([(text, at, key) for key, at, text in last], "text string, chunk_index int, paper_id string"))
    rows = [row for row in rows if row[0] not in ("q", None)] + last
    assert contents(table) == sorted(rows, key=str)
    assert contents(table.compact(str(tmp_path / "b"), bucket_rows=10)) == sorted(rows, key=str)


def test_another_session_finds_the_layout(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable.create(spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], KIND), path, "paper_id", bucket_rows=1)
    spark.sql(f"DROP TABLE {table.name}")
    again = KeyedTable(spark, path)
    again.write(spark.createDataFrame([("b", 3, "z")], KIND))
    assert contents(again) == [("a", 1, "x"), ("b", 3, "z")]


def test_an_empty_table_takes_rows(spark, tmp_path):
    table = KeyedTable.create(spark.createDataFrame([], KIND), str(tmp_path / "t"), "paper_id")
    assert contents(table) == []
    table.write(spark.createDataFrame([("a", 1, "x")], KIND))
    assert contents(table) == [("a", 1, "x")]


def test_joins_and_reads_do_not_shuffle_the_table(spark, tmp_path):
    rows = spark.range(3_000).select(F.concat(F.lit("p"), F.col("id") % 300).alias("paper_id"), (F.col("id") / 300).cast("int").alias("chunk_index"), F.lit("t").alias("text"))
    table = KeyedTable.create(rows, str(tmp_path / "t"), "paper_id", bucket_rows=500)
    table.write(rows.where("paper_id < 'p2'").withColumn("text", F.lit("u")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        papers = spark.range(50).select(F.concat(F.lit("p"), F.col("id")).alias("paper_id"))
        plan = table.read().join(papers, "paper_id")._jdf.queryExecution().executedPlan().toString()
        counts = table.read().groupBy("paper_id").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(paper_id" in plan.split("Range")[0][-400:]
    assert counts.count("Exchange") == 0


def test_folders_are_read_by_bucket(spark, tmp_path):
    path = str(tmp_path / "f")
    rows = [(f"p{n}", n, "t") for n in range(400)]
    folders = BucketFolders.create(spark.createDataFrame(rows, KIND), path, ["paper_id"], bucket_rows=20)
    asked = spark.createDataFrame([("p3", 1), ("p77", 1), ("p3", 2), ("none", 2)], "paper_id string, x int")
    used = {f"bucket={row[0]}" for row in asked.select(folders.bucket()).collect()}
    store_markers(spark.createDataFrame([(f"p{n}", n, 1) for n in range(400)], "paper_id string, chunk_count long, page_count long"), folders, path, -1)
    store_markers(spark.createDataFrame([("p3", 9, 9)], "paper_id string, chunk_count long, page_count long"), folders, path, 4)
    for root in (Path(path, "rows"), Path(path, "markers", "batch_id=-1")):
        others = [folder for folder in root.iterdir() if folder.name.startswith("bucket=") and folder.name not in used]
        assert len(others) > 10
        for folder in others:
            break_files(folder)
    assert sorted(map(tuple, folders.of(asked).collect())) == [("p3", 3, "t"), ("p77", 77, "t")]
    assert {("p3", 3), ("p77", 77)} <= {(row.paper_id, row.chunk_count) for row in stored_markers(asked, folders, path, 4).collect()}
    assert ("p3", 9) in {(row.paper_id, row.chunk_count) for row in stored_markers(asked, folders, path, 5).collect()}


def test_an_ingest_batch_reads_its_own_buckets(spark, tmp_path):
    from paperloom.streaming.ingest import ingest_log, start_ingest
    from paperloom.streaming.replay import replay

    root = str(tmp_path)
    pages = spark.createDataFrame([(f"p{n}", 0, f"text {n} " * 40) for n in range(300)], "paper_id string, page_no int, text string")
    folders = BucketFolders.create(pages, f"{root}/pages", ["paper_id"], bucket_rows=20)
    store_markers(spark.createDataFrame([("p2", 3, 1)], "paper_id string, chunk_count long, page_count long"), folders, root, -1)
    papers = spark.createDataFrame([(f"p{n}", "t", "u", n) for n in (1, 2, 3)], "paper_id string, title string, pdf_url string, seq int")
    used = {f"bucket={row[0]}" for row in papers.select(folders.bucket()).collect()}
    for folder in Path(root, "pages", "rows").iterdir():
        if folder.name.startswith("bucket=") and folder.name not in used:
            break_files(folder)
    fetches = spark.createDataFrame([(f"p{n}", True, None) for n in range(5)], "paper_id string, fetched boolean, extract_error string")
    replay([papers.where("seq < 3"), papers], f"{root}/landing", lambda stream: start_ingest(stream, fetches, folders, root))
    log = {row.paper_id: (row.status, row.chunk_count) for row in ingest_log(spark, root).collect()}
    assert {key: status for key, (status, _) in log.items()} == {"p1": "success", "p2": "already_cached", "p3": "success"}
    assert log["p2"][1] == 3
