import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions.chunking import chunk_documents
from paperloom.operators.pages import chunk_pages, document_status, page_spans
from paperloom.operators.store import (
    cache_key,
    cache_lookup,
    chunk_rows,
    first_chunks,
    latest_per_key,
    split_done,
    upsert_chunks,
)
from paperloom.plans.ingest import ingest_papers, new_markers
from paperloom.sources.extract import extract_text, html_pages


def model_chunks(text, size, overlap):
    """Windows at the multiples of the step; each but the first has something that the one before it did not reach."""
    text, step = text.strip(), size - overlap
    reached = [0, *range(size, len(text), step)]
    windows = [text[number * step :][:size].strip() for number in range(len(reached))]
    return [window for window in windows if window]


def chunked(spark, texts, **shape):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    result = {n: [] for n in range(len(texts))}
    for row in chunk_documents(frame, **shape).orderBy("id", "chunk_index").collect():
        assert row.chunk_index == len(result[row.id])
        result[row.id].append(row.text)
    return [result[n] for n in range(len(texts))]


def test_chunk_examples(spark):
    assert chunked(spark, ["", "   "]) == [[], []]
    assert [len(piece) for piece in chunked(spark, ["z" * 77], size=20, overlap=4)[0]] == [20, 20, 20, 20, 13]
    assert chunked(spark, ["abcdefghijkl"], size=5, overlap=2)[0] == ["abcde", "defgh", "ghijk", "jkl"]
    with pytest.raises(ValueError):
        chunked(spark, ["short"], size=8, overlap=9)


@pytest.mark.parametrize("size,overlap", [(7, 2), (7, 6), (5, 0), (1, 0), (12, 9)])
def test_chunks_equal_their_definition(spark, size, overlap):
    draw = random.Random(size * 31 + overlap)
    alphabet = ["a", "é", "\U0001f600", " ", "\n", " "]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(300)]
    assert chunked(spark, texts, size=size, overlap=overlap) == [model_chunks(text, size, overlap) for text in texts]


def test_long_mixed_text_is_cut_whole(spark):
    text = "a\U0001f600" * 100_000
    assert chunked(spark, [text])[0] == model_chunks(text, 1500, 200)


def random_documents(seed):
    draw = random.Random(seed)
    documents = {}
    for n in range(60):
        pages = ["".join(draw.choice("ab \n") for _ in range(draw.choice([0, 1, 3, 20, 70]))) for _ in range(draw.randint(1, 9))]
        documents[f"p{n}"] = pages
    # One document holds most pages and spans several blocks.
    documents["huge"] = ["".join(draw.choice("ab ") for _ in range(draw.choice([0, 2, 9]))) for _ in range(3000)]
    documents["blank"] = ["  ", "\n", ""]
    return documents


def page_frame(spark, documents):
    rows = [(key, number, text) for key, pages in documents.items() for number, text in enumerate(pages)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "paper_id string, page_no int, text string")


def test_assembly_and_gate(spark):
    documents = random_documents(1)
    frame = page_frame(spark, documents)
    full = {key: "\n\n".join(page.strip() for page in pages) for key, pages in documents.items()}
    for row in page_spans(frame, 12).collect():
        page = documents[row.paper_id][row.page_no].strip()
        text = full[row.paper_id]
        assert text[row.char_start : row.char_start + len(page)] == page == row.text
        assert (row.n_chars, row.page_count) == (len(text), len(documents[row.paper_id]))
        assert row.status == ("scanned_pdf" if len(text) / len(documents[row.paper_id]) < 12 else "success")
    spans = page_spans(frame, 12).select("paper_id", "page_count", "n_chars", "status").distinct()
    assert sorted(spans.collect()) == sorted(document_status(frame, 12).collect())


@pytest.mark.parametrize("size,overlap", [(10, 3), (10, 9), (25, 0), (200, 40)])
def test_chunks_across_pages_equal_chunks_of_the_text(spark, size, overlap):
    documents = random_documents(size + overlap)
    found = {key: [] for key in documents}
    chunks = chunk_pages(page_spans(page_frame(spark, documents)), size, overlap)
    for row in chunks.orderBy("paper_id", "chunk_index").collect():
        assert row.chunk_index == len(found[row.paper_id])
        found[row.paper_id].append(row.text)
    for key, pages in documents.items():
        assert found[key] == model_chunks("\n\n".join(page.strip() for page in pages), size, overlap), key


def test_extraction_keeps_failures_apart(spark):
    frame = spark.createDataFrame(
        [(1, "<p>One &amp; two</p><script>no</script><p>three</p>"), (2, "not a document")], "paper_id int, payload string"
    )
    rows = {row.paper_id: row for row in extract_text(frame).collect()}
    assert (rows[1].text, rows[1].status) == ("One & two\nthree", "success")
    assert (rows[2].text, rows[2].status) == (None, "extraction_failed")


def chunk_frame(spark, rows):
    return spark.createDataFrame(rows, "paper_id string, chunk_index int, text string")


def test_hidden_and_unfinished_markup(spark):
    pages = [
        "<style>p{}</style>a<SCRIPT x='1'>var t='</p>';</script >b<!-- <p>c</p> -->d",
        "a &lt;b&gt; &amp;amp; 1 < 2<br/>  c\n\n<p> </p>d",
        "kept<script>never closed",
        "<>",
        "",
        None,
    ]
    frame = spark.createDataFrame(list(enumerate(pages)), "paper_id int, payload string")
    rows = {row.paper_id: row for row in extract_text(frame).collect()}
    assert [rows[n].text for n in range(6)] == ["a\nb\nd", "a <b> &amp; 1 < 2\nc\nd", "kept", "<>", None, None]
    assert [rows[n].status for n in (3, 4, 5)] == ["success", "extraction_failed", "extraction_failed"]
    own = {row.paper_id: row.text for row in extract_text(frame, html_pages).collect()}
    assert own[0] == "a\nb\nd"


def test_upsert_replaces_only_papers_with_new_chunks(spark):
    current = chunk_frame(spark, [("a", 0, "old"), ("a", 1, "old"), ("b", 0, "keep")])
    merged = upsert_chunks(current, chunk_frame(spark, [("a", 0, "new")]))
    assert sorted(tuple(row) for row in merged.collect()) == [("a", 0, "new"), ("b", 0, "keep")]
    assert upsert_chunks(current, current.where("false")).count() == 3


def test_first_chunks(spark):
    chunks = chunk_frame(spark, [("a", 2, "c"), ("a", 0, "a"), ("a", 1, "b")])
    assert first_chunks(chunks, 2).first().chunks == ["a", "b"]
    assert first_chunks(chunks, 0).count() == 0
    assert chunk_rows(chunks).count() == 3


def test_latest_write_wins_with_its_nulls(spark):
    writes = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "paper_id string, seq int, title string")
    assert {row.paper_id: row.title for row in latest_per_key(writes, "paper_id", "seq").collect()} == {"a": None, "b": "y"}


def test_split_done(spark):
    papers = spark.createDataFrame([("a",), ("b",), ("c",)], "paper_id string")
    done = spark.createDataFrame([("a", None), ("b", "{broken")], "paper_id string, _corrupt string")
    todo, reused = split_done(papers, done)
    assert sorted(row.paper_id for row in todo.collect()) == ["b", "c"]
    assert [row.paper_id for row in reused.collect()] == ["a"]
    assert split_done(papers, done, force=True)[0].count() == 3


def test_cache_key_classes(spark):
    def key(topic, sources, year=None):
        column = cache_key(F.lit(topic), F.array(*map(F.lit, sources)), F.lit(10), F.lit(year), F.lit(None))
        return spark.range(1).select(column.alias("key")).first().key

    assert key(" Transformers", ["a", "b"]) == key("transformers", ["b", "a"])
    assert len({key("t", ["a"]), key("t", ["b"]), key("t", ["a"], 2020)}) == 3


def test_cache_expires_after_its_time(spark):
    entries = spark.sql("select 'k' cache_key, timestamp'2024-01-01 00:00:00' created_at, 0 results")
    asked = spark.sql(
        """select * from values ('k', timestamp'2024-01-01 00:59:59'), ('k', timestamp'2024-01-01 01:00:00'),
        ('other', timestamp'2024-01-01 00:10:00') as t(cache_key, asked_at)"""
    )
    assert sorted((str(row.asked_at), row.hit) for row in cache_lookup(asked, entries).collect()) == [
        ("2024-01-01 00:10:00", False),
        ("2024-01-01 00:59:59", True),
        ("2024-01-01 01:00:00", False),
    ]


def test_the_last_write_before_a_request_answers_it(spark):
    """One key has nearly all requests and writes; some share their moment."""
    draw = random.Random(11)
    writes = [("hot" if draw.random() < 0.9 else None, draw.randrange(400), n) for n in range(150)]
    asks = [(draw.choice(["hot", "hot", "hot", "cold", None]), draw.choice([None, draw.randrange(400)]), n) for n in range(300)]
    entries = spark.createDataFrame(writes, "cache_key string, at long, entry long").selectExpr(
        "cache_key", "timestamp_seconds(at) created_at", "entry"
    )
    asked = spark.createDataFrame(asks, "cache_key string, at long, id long").selectExpr("cache_key", "timestamp_seconds(at) asked_at", "id")
    found = {row.id: row for row in cache_lookup(asked.repartition(5), entries.repartition(5), 5, tie=["entry"]).collect()}
    assert len(found) == len(asks)
    for key, at, number in asks:
        able = [(made, entry) for other, made, entry in writes if key and other == key and at is not None and made <= at < made + 5]
        assert found[number].hit == bool(able) and found[number].entry == (max(able)[1] if able else None)


def test_ingest_ladder(spark):
    text = "word " * 40
    papers = spark.createDataFrame(
        [
            ("cached", "T", "u", 1),
            ("nopdf", "T", "", 1),
            ("failed", "T", "u", 1),
            ("broken", "T", "u", 1),
            ("scanned", "T", "u", 1),
            ("empty", "T", "u", 1),
            ("good", "Old title", "u", 1),
            ("good", "New title", "u", 2),
        ],
        "paper_id string, title string, pdf_url string, seq int",
    )
    fetches = spark.createDataFrame(
        [("failed", False, None), ("broken", True, "bad file"), ("scanned", True, None), ("empty", True, None), ("good", True, None)],
        "paper_id string, fetched boolean, extract_error string",
    )
    pages = spark.createDataFrame(
        [("scanned", 0, "x"), ("good", 0, text), ("good", 1, text), ("nopdf", 0, text)], "paper_id string, page_no int, text string"
    )
    done = spark.createDataFrame([("cached", 7, 3)], "paper_id string, chunk_count bigint, page_count bigint")
    result = ingest_papers(papers, fetches, pages, done)
    assert {row.paper_id: (row.status, row.chunk_count, row.page_count) for row in result.log.collect()} == {
        "cached": ("already_cached", 7, 3),
        "nopdf": ("no_pdf_available", 0, None),
        "failed": ("download_failed", 0, None),
        "broken": ("extraction_failed", 0, None),
        "scanned": ("scanned_pdf", 0, None),
        "empty": ("scanned_pdf", 0, None),
        "good": ("success", 1, 2),
    }
    assert result.metadata.count() == 7
    assert [row.title for row in result.chunks.collect()] == ["New title"]
    assert [tuple(row) for row in new_markers(result.log).collect()] == [("good", 1, 2)]
    again = ingest_papers(papers, fetches, pages, done.unionByName(new_markers(result.log)))
    assert {row.status for row in again.log.where("paper_id = 'good'").collect()} == {"already_cached"}
    forced = ingest_papers(papers, fetches, pages, new_markers(result.log), force=True)
    assert {row.status for row in forced.log.where("paper_id = 'good'").collect()} == {"success"}
