"""Texts and stored tables are moved no more often than needed."""

from pyspark.sql import functions as F

from paperloom.operators.graph_store import Counts
from paperloom.operators.model import call_model
from paperloom.operators.pages import block_spans, page_lengths
from paperloom.operators.tables import BucketFolders
from paperloom.plans.ingest import readable_pages
from paperloom.streaming.ingest import replay_ingest


def test_prompts_become_texts_a_call_at_a_time(spark, monkeypatch):
    import pandas as pd

    frames = []
    prompts = spark.createDataFrame([(n, None if n == 3 else f"p{n}") for n in range(25)], "id int, prompt string")
    monkeypatch.setattr(type(prompts), "mapInPandas", lambda *args, **kwargs: frames.append(pd.DataFrame()))
    sizes = spark.sparkContext.accumulator(0)

    def answer(texts):
        sizes.add(10_000 if len(texts) > 4 else 1)
        return [f"{text}!" for text in texts]

    found = call_model(prompts, answer, ["id"], calls=1, batch_size=4)
    assert {row.id: (row.raw_response, row.error) for row in found.collect()} == {
        n: ("None!" if n == 3 else f"p{n}!", None) for n in range(25)
    }
    assert not frames and sizes.value == 7


def test_folders_store_their_rows_once(spark, tmp_path, monkeypatch):
    from paperloom.operators import tables

    monkeypatch.setattr(tables, "cut_lineage", lambda rows: 1 / 0)
    rows = spark.createDataFrame([(f"p{n}", n) for n in range(30)], "paper_id string, x int")
    folders = BucketFolders.create(rows, str(tmp_path / "f"), ["paper_id"], bucket_rows=10)
    assert folders.buckets == 3 and sorted(map(tuple, folders.all().collect())) == sorted(map(tuple, rows.collect()))


def test_counts_change_without_looking_keys_up(spark, tmp_path, monkeypatch):
    kind = "name string, paper int"
    rows = spark.createDataFrame([(f"e{n % 7}", n) for n in range(40)], kind)
    counts = Counts.create(rows, str(tmp_path / "c"), ["name"], bucket_rows=2)
    monkeypatch.setattr(BucketFolders, "of", lambda *args: 1 / 0)
    counts.change(rows.where("paper < 3"), -1)
    counts.change(spark.createDataFrame([("new", 1), ("e0", 99)], kind), 1)
    left = {f"e{n}": 6 - (n > 4) - (n < 3) + (n == 0) for n in range(7)} | {"new": 1}
    assert {row.name: row.n for row in counts.read().collect()} == left
    for _ in range(2):
        counts.change(spark.createDataFrame([(None, 1), (None, 2)], kind), 1)
    assert sorted(row.n for row in counts.read().where("name is null").collect()) == [2, 2]


def test_an_ingest_stream_lands_what_it_reads(spark, monkeypatch):
    from paperloom.streaming import ingest

    landed, plain = [], ingest.replay

    def replay(parts, path, start):
        landed.extend(parts[0].columns)
        plain(parts, path, start)

    monkeypatch.setattr(ingest, "replay", replay)
    papers = spark.createDataFrame([(f"p{n}", "t", "u", n, "long " * 50) for n in range(6)], "paper_id string, title string, pdf_url string, seq int, abstract string")
    fetches = papers.select("paper_id", F.lit(True).alias("fetched"), F.lit(None).cast("string").alias("extract_error"))
    pages = papers.select("paper_id", F.lit(0).alias("page_no"), F.col("abstract").alias("text"))
    markers = spark.createDataFrame([("p1", 7, 2)], "paper_id string, chunk_count long, page_count long")
    log = {row.paper_id: (row.status, row.chunk_count) for row in replay_ingest(papers, fetches, pages, markers).collect()}
    assert landed == ["paper_id", "title", "pdf_url", "seq"]
    assert log == {f"p{n}": ("already_cached", 7) if n == 1 else ("success", 1) for n in range(6)}


def test_block_spans_move_no_texts(spark):
    known = spark.createDataFrame([(f"p{n}", False, "u", True, None) for n in range(3)], "paper_id string, done boolean, pdf_url string, fetched boolean, extract_error string")
    pages = spark.range(6).select(F.concat(F.lit("p"), F.col("id") % 4).alias("paper_id"), F.col("id").cast("int").alias("page_no"), F.concat(F.lit(" t"), "id", F.lit("ext ")).alias("text"))
    spans = block_spans(readable_pages(page_lengths(pages), known))
    assert {row.paper_id: row.n_chars for row in spans.collect()} == {"p0": 12, "p1": 12, "p2": 5}
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert "length" in plan.split("Join LeftSemi")[1]
