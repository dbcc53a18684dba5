"""Landed payloads are built and parsed once, within their rows."""

from pyspark.sql import functions as F

from paperloom.catalog import search_queries
from paperloom.plans import search
from paperloom.schemas import PAPER_COLUMNS


def write_documents(spark, path):
    texts = [(1, "b a\nb  c b", "en"), (2, "", "en"), (3, None, None), (4, " x\n", "de"), (None, "y z", "de"), (5, "é a é", "en")]
    rows = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    rows.withColumn("n_chars", F.length("text")).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_the_word_index_needs_no_shuffle(spark, tmp_path):
    documents = spark.read.parquet(f"{write_documents(spark, tmp_path)}/documents.parquet")
    indexed = search_queries.with_word_index(documents, "text")
    found = {row.doc_id: row.word_index for row in indexed.collect()}
    assert found == {
        1: {"a": [1], "b": [0, 2, 4], "c": [3]}, 2: None, 3: None, 4: {"x": [0]}, None: None, 5: {"a": [1], "é": [0, 2]}
    }
    assert "Exchange" not in indexed._jdf.queryExecution().executedPlan().toString()


def test_abstracts_come_back_from_their_index(spark, tmp_path):
    found = search_queries._inverted_abstract(spark, write_documents(spark, tmp_path))
    assert {row.doc_id: row.abstract for row in found.collect()} == {1: "b a b c b", 2: None, 3: None, 4: "x", None: None, 5: "é a é"}


def test_a_search_reads_its_hits_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(rows):
        for batch in rows:
            read.add(batch.num_rows)
            yield batch

    columns = {name: F.lit(None).cast("string") for name in PAPER_COLUMNS} | {
        "title": F.concat(F.lit("title "), F.col("id") % 20), "source": F.lit("arxiv"), "published_date": F.to_date(F.lit("2001-01-01")),
        "external_id": F.col("id").cast("string"), "source_rank": F.col("id"), "topic": F.lit("t"),
    }
    hits = spark.range(40).select(*[column.alias(name) for name, column in columns.items()])
    found = search.search_papers(hits.mapInArrow(counted, hits.schema), max_results=30)
    assert found.count() == 20 and found.collect()[0].external_id == "0"
    assert read.value == 40
