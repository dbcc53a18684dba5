"""Chunks, pages, keyed stores and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.catalog.fixtures import (
    CONVERSATION_PAGES,
    DOCUMENT_LINES,
    METADATA_WRITES,
    PAPER_VIEW,
    conversation_pages,
    day,
    document_lines,
    metadata_writes,
    paper_view,
    request_log,
    sql_chunks,
    sql_full_text,
    sql_strip,
    table,
)
from paperloom.catalog.registry import query
from paperloom.functions.chunking import chunk_documents
from paperloom.operators.model import embed_chunks
from paperloom.operators.pages import chunk_pages, document_status, page_spans
from paperloom.operators.store import (
    cache_lookup,
    chunk_count,
    first_chunks,
    latest_per_key,
    split_done,
    upsert_chunks,
    with_chunk_ids,
)
from paperloom.operators.tables import KeyedTable
from paperloom.plans.ingest import ingest_flags, ingest_papers, ingest_status, new_markers, summarizable
from paperloom.schemas import CHUNK_OVERLAP, CHUNK_SIZE
from paperloom.session import fresh_path
from paperloom.sources.extract import HTML_REFERENCES, extract_text
from paperloom.streaming.ingest import replay_ingest

# The gate threshold that splits the given conversations into both outcomes.
CONVERSATION_THRESHOLD = 300

DOC_CHUNKS = (
    PAPER_VIEW
    + ", paper_text AS (SELECT paper_id, abstract AS text FROM paper_view), "
    + sql_chunks("paper_text", "paper_id", CHUNK_SIZE, CHUNK_OVERLAP)
)


def paper_chunks(spark, sf_dir):
    """Chunks of every paper's text."""
    papers = paper_view(spark, sf_dir).select("paper_id", F.col("abstract").alias("text"))
    return chunk_documents(papers)


@query(
    "chunk_documents",
    f"""WITH {DOC_CHUNKS} SELECT paper_id, paper_id || '::chunk_' || chunk_index AS chunk_id, chunk_index, text FROM chunks""",
)
def _chunk_documents(spark, sf_dir):
    return with_chunk_ids(paper_chunks(spark, sf_dir)).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query("chunk_count", f"WITH {DOC_CHUNKS} SELECT paper_id, count(*) AS chunk_count FROM chunks GROUP BY paper_id")
def _chunk_count(spark, sf_dir):
    return chunk_count(paper_chunks(spark, sf_dir))


@query(
    "first_chunks",
    f"""WITH {DOC_CHUNKS} SELECT paper_id, string_agg(text, '|' ORDER BY chunk_index) AS chunks FROM chunks
    WHERE chunk_index < 3 GROUP BY paper_id""",
)
def _first_chunks(spark, sf_dir):
    return first_chunks(paper_chunks(spark, sf_dir), 3).withColumn("chunks", F.array_join("chunks", "|"))


@query(
    "upsert_chunks",
    f"""WITH {DOC_CHUNKS}, relabelled AS (
        SELECT paper_id, abstract AS text FROM paper_view JOIN labels USING (doc_id) WHERE quality = 1),
    {sql_chunks("relabelled", "paper_id", 400, 40, "fresh")}
    SELECT paper_id, chunk_index, text FROM chunks WHERE paper_id NOT IN (SELECT paper_id FROM fresh)
    UNION ALL SELECT paper_id, chunk_index, text FROM fresh""",
)
def _upsert_chunks(spark, sf_dir):
    labelled = table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")
    again = paper_view(spark, sf_dir).join(labelled, "doc_id").select("paper_id", F.col("abstract").alias("text"))
    merged = upsert_chunks(paper_chunks(spark, sf_dir), chunk_documents(again, size=400, overlap=40))
    return merged.withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


_AGAIN = """{0}_papers AS (SELECT paper_id, abstract AS text FROM paper_view JOIN labels USING (doc_id) WHERE {1})"""


@query(
    "chunk_table_update",
    f"""WITH {DOC_CHUNKS}, {_AGAIN.format("good", "quality = 1")}, {sql_chunks("good_papers", "paper_id", 400, 40, "good")},
    {_AGAIN.format("toxic", "toxic = 1")}, {sql_chunks("toxic_papers", "paper_id", 300, 30, "toxic")}
    SELECT paper_id, chunk_index, text FROM toxic
    UNION ALL SELECT paper_id, chunk_index, text FROM good WHERE paper_id NOT IN (SELECT paper_id FROM toxic)
    UNION ALL SELECT paper_id, chunk_index, text FROM chunks
        WHERE paper_id NOT IN (SELECT paper_id FROM toxic UNION SELECT paper_id FROM good)""",
)
def _chunk_table_update(spark, sf_dir):
    """A stored chunk table after two updates, whose papers overlap."""
    stored = KeyedTable.create(paper_chunks(spark, sf_dir), fresh_path(spark, "chunk-table"), "paper_id", bucket_rows=100_000)
    labels, papers = table(spark, sf_dir, "labels"), paper_view(spark, sf_dir)
    for label, size, overlap in (("quality", 400, 40), ("toxic", 300, 30)):
        again = papers.join(labels.where(F.col(label) == 1).select("doc_id"), "doc_id").select("paper_id", F.col("abstract").alias("text"))
        stored.write(chunk_documents(again, size=size, overlap=overlap))
    return stored.read().withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


@query(
    "metadata_table",
    f"""WITH {METADATA_WRITES} SELECT paper_id, max_by(title, seq) AS title, max_by(source, seq) AS source, max(seq) AS seq
    FROM metadata_writes GROUP BY paper_id""",
)
def _metadata_table(spark, sf_dir):
    """Metadata written in two runs, one after the other; each run writes a paper once, its last form."""
    writes = metadata_writes(spark, sf_dir).select("paper_id", "title", "source", "seq")
    middle = writes.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY seq)")).first()[0]
    earlier = latest_per_key(writes.where(F.col("seq") <= middle), "paper_id", "seq")
    stored = KeyedTable.create(earlier, fresh_path(spark, "metadata-table"), "paper_id", bucket_rows=100_000)
    stored.write(latest_per_key(writes.where(F.col("seq") > middle), "paper_id", "seq"))
    return stored.read()


@query(
    "embed_chunks",
    f"""WITH {DOC_CHUNKS}, words AS (
        SELECT paper_id, chunk_index, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM chunks),
    counts AS (
        SELECT paper_id, chunk_index, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 64 AS dimension, count(*) AS n
        FROM words WHERE word <> '' GROUP BY ALL)
    SELECT paper_id, chunk_index, dimension,
           round(n / sqrt(sum(n * n) OVER (PARTITION BY paper_id, chunk_index)), 6) AS weight
    FROM counts""",
)
def _embed_chunks(spark, sf_dir):
    """The components that are not zero, a row each."""
    embedded = embed_chunks(paper_chunks(spark, sf_dir))
    parts = embedded.select(
        "paper_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.posexplode("embedding").alias("dimension", "value")
    )
    return parts.where("value <> 0").select(
        "paper_id", "chunk_index", F.col("dimension").cast("bigint").alias("dimension"), F.round("value", 6).alias("weight")
    )


_GATE = "CASE WHEN length(f.text) / f.page_count < {} THEN 'scanned_pdf' ELSE 'success' END"


@query(
    "assemble_pages",
    f"""WITH {CONVERSATION_PAGES}, {sql_full_text("conversation_pages")}
    SELECT paper_id, page_no, {sql_strip("p.text")} AS text, f.page_count, length(f.text) AS n_chars,
           CAST(coalesce(sum(length({sql_strip("p.text")}) + 2) OVER (PARTITION BY paper_id ORDER BY page_no
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start,
           {_GATE.format(CONVERSATION_THRESHOLD)} AS status
    FROM conversation_pages p JOIN full_text f USING (paper_id)""",
)
def _assemble_pages(spark, sf_dir):
    spans = page_spans(conversation_pages(spark, sf_dir), CONVERSATION_THRESHOLD)
    return spans.select("paper_id", "page_no", "text", "page_count", "n_chars", "char_start", "status")


@query(
    "document_status",
    f"""WITH {PAPER_VIEW}, {DOCUMENT_LINES}, {sql_full_text("document_lines")}
    SELECT paper_id, page_count, length(text) AS n_chars, {_GATE.format(50)} AS status FROM full_text f""",
)
def _document_status(spark, sf_dir):
    return document_status(document_lines(spark, sf_dir))


@query(
    "chunk_pages",
    f"""WITH {CONVERSATION_PAGES}, {sql_full_text("conversation_pages")},
    {sql_chunks("full_text", "paper_id", 500, 100)} SELECT paper_id, chunk_index, text FROM chunks""",
)
def _chunk_pages(spark, sf_dir):
    chunks = chunk_pages(page_spans(conversation_pages(spark, sf_dir)), 500, 100)
    return chunks.withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


def _visible_sql(html: str) -> str:
    """Hidden blocks, then comments and tags, then references, then blank space around line ends."""
    text = html
    for tag in ("script", "style", "template", "noscript"):
        text = f"regexp_replace({text}, '(?is)<{tag}\\b[^>]*>.*?(?:</{tag}\\s*>|\\z)', chr(10), 'g')"
    text = f"regexp_replace({text}, '(?s)<!--.*?(?:-->|\\z)', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[/!?a-zA-Z][^>]*>', chr(10), 'g')"
    for name, sign in HTML_REFERENCES:
        text = f"replace({text}, '{name}', chr({ord(sign)}))"
    return sql_strip(f"regexp_replace({text}, '[ \\t\\r\\f\\x0B\\x{{a0}}]*\\n\\s*', chr(10), 'g')")


@query(
    "extract_text",
    f"""SELECT page_id, CASE WHEN contains(html, '<') THEN 0 END AS page_no,
           CASE WHEN contains(html, '<') THEN {_visible_sql("html")} END AS text,
           CASE WHEN contains(html, '<') THEN 'success' ELSE 'extraction_failed' END AS status,
           CASE WHEN contains(html, '<') THEN NULL ELSE 'not an HTML document' END AS message
    FROM pages""",
)
def _extract_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"), id_col="page_id", payload_col="html")


@query(
    "latest_metadata",
    f"""WITH {METADATA_WRITES}, ranked AS (
        SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY seq DESC) AS n FROM metadata_writes)
    SELECT paper_id, seq, title, source, strftime(published_date, '%Y-%m-%d') AS published, url FROM ranked WHERE n = 1""",
)
def _latest_metadata(spark, sf_dir):
    latest = latest_per_key(metadata_writes(spark, sf_dir), "paper_id", "seq")
    return latest.select("paper_id", "seq", "title", "source", day("published_date").alias("published"), "url")


def ingest_markers(spark, sf_dir):
    """Labelled documents count as ingested before."""
    papers = paper_view(spark, sf_dir).select("doc_id", "paper_id")
    return papers.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "paper_id",
        (F.col("doc_id") % 9).cast("bigint").alias("chunk_count"),
        (F.col("quality") + 1).cast("bigint").alias("page_count"),
    )


def paper_fetches(spark, sf_dir):
    """Outcome of fetching and opening each paper's PDF."""
    chars = F.col("n_chars")
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return paper_view(spark, sf_dir).select("doc_id", "paper_id").join(documents, "doc_id").select(
        "paper_id",
        (chars % 9 != 0).alias("fetched"),
        F.when(chars % 10 == 0, F.lit("damaged file")).alias("extract_error"),
    )


INGEST_SQL = f"""{PAPER_VIEW}, {DOCUMENT_LINES}, {sql_full_text("document_lines")},
markers AS (
    SELECT paper_id, doc_id % 9 AS chunk_count, CAST(quality + 1 AS BIGINT) AS page_count
    FROM paper_view JOIN labels USING (doc_id)),
judged AS (
    SELECT p.paper_id, m.chunk_count AS stored_chunks, m.page_count AS stored_pages, f.page_count,
           CASE WHEN m.paper_id IS NOT NULL THEN 'already_cached'
                WHEN coalesce(p.pdf_url, '') = '' THEN 'no_pdf_available'
                WHEN d.n_chars % 9 = 0 THEN 'download_failed'
                WHEN d.n_chars % 10 = 0 THEN 'extraction_failed'
                WHEN length(f.text) / f.page_count < 50 THEN 'scanned_pdf'
                ELSE 'success' END AS status
    FROM paper_view p JOIN documents d USING (doc_id) LEFT JOIN markers m ON m.paper_id = p.paper_id
    LEFT JOIN full_text f ON f.paper_id = p.paper_id),
fresh_text AS (SELECT paper_id, text FROM full_text JOIN judged USING (paper_id) WHERE status = 'success'),
{sql_chunks("fresh_text", "paper_id", CHUNK_SIZE, CHUNK_OVERLAP)},
counts AS (SELECT paper_id, count(*) AS chunk_count FROM chunks GROUP BY paper_id),
ingest_log AS (
    SELECT j.paper_id, status,
           CASE WHEN status = 'already_cached' THEN stored_chunks ELSE coalesce(c.chunk_count, 0) END AS chunk_count,
           CASE status WHEN 'already_cached' THEN stored_pages WHEN 'success' THEN page_count END AS page_count,
           CASE status WHEN 'already_cached' THEN 'ingested before; force a new run to redo it'
                WHEN 'no_pdf_available' THEN 'the source names no PDF'
                WHEN 'download_failed' THEN 'the PDF could not be fetched'
                WHEN 'extraction_failed' THEN 'damaged file'
                WHEN 'scanned_pdf' THEN 'the PDF holds no text layer' END AS message
    FROM judged j LEFT JOIN counts c ON c.paper_id = j.paper_id)"""


def ingest_all(spark, sf_dir):
    papers = paper_view(spark, sf_dir).withColumn("seq", F.col("doc_id"))
    return ingest_papers(
        papers, paper_fetches(spark, sf_dir), document_lines(spark, sf_dir), ingest_markers(spark, sf_dir)
    )


@query("ingest_papers", f"WITH {INGEST_SQL} SELECT * FROM ingest_log")
def _ingest_papers(spark, sf_dir):
    return ingest_all(spark, sf_dir).log


@query("ingest_chunks", f"WITH {INGEST_SQL} SELECT paper_id, chunk_index, text FROM chunks")
def _ingest_chunks(spark, sf_dir):
    chunks = ingest_all(spark, sf_dir).chunks
    return chunks.select("paper_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "text")


@query("ingest_status", f"WITH {INGEST_SQL} SELECT paper_id, status FROM judged")
def _ingest_status(spark, sf_dir):
    flags = ingest_flags(
        paper_view(spark, sf_dir),
        paper_fetches(spark, sf_dir),
        document_lines(spark, sf_dir),
        ingest_markers(spark, sf_dir),
    )
    return flags.select("paper_id", ingest_status().alias("status"))


@query("summarizable", f"WITH {INGEST_SQL} SELECT paper_id FROM judged WHERE status IN ('success', 'already_cached')")
def _summarizable(spark, sf_dir):
    return summarizable(_ingest_status(spark, sf_dir)).select("paper_id")


@query(
    "ingest_markers",
    f"WITH {INGEST_SQL} SELECT paper_id, chunk_count, page_count FROM ingest_log WHERE status = 'success'",
)
def _ingest_markers(spark, sf_dir):
    return new_markers(ingest_all(spark, sf_dir).log)


@query(
    "ingest_incremental",
    f"""WITH {PAPER_VIEW} SELECT paper_id, CASE WHEN l.doc_id IS NULL THEN 'todo' ELSE 'done' END AS state
    FROM paper_view p LEFT JOIN labels l ON p.doc_id = l.doc_id""",
)
def _ingest_incremental(spark, sf_dir):
    papers = paper_view(spark, sf_dir).select("paper_id")
    todo, done = split_done(papers, ingest_markers(spark, sf_dir))
    return todo.select("paper_id", F.lit("todo").alias("state")).unionByName(
        done.select("paper_id", F.lit("done").alias("state"))
    )


@query("ingest_stream", f"WITH {INGEST_SQL} SELECT paper_id, status, chunk_count, page_count FROM ingest_log")
def _ingest_stream(spark, sf_dir):
    papers = paper_view(spark, sf_dir).withColumn("seq", F.col("doc_id"))
    log = replay_ingest(
        papers,
        paper_fetches(spark, sf_dir),
        document_lines(spark, sf_dir),
        ingest_markers(spark, sf_dir),
    )
    return log.select("paper_id", "status", "chunk_count", "page_count")


@query(
    "cache_lookup",
    """WITH searches AS (SELECT event_id, sha256('user' || user_id) AS cache_key, ts, event_type FROM events),
    answers AS (
        SELECT s.event_id, max_by(e.event_id, (e.ts, e.event_id)) AS entry
        FROM searches s JOIN searches e ON e.cache_key = s.cache_key AND e.ts <= s.ts
            AND e.ts + INTERVAL 43200 SECOND > s.ts
        WHERE s.event_type <> 'purchase' AND e.event_type = 'purchase' GROUP BY s.event_id)
    SELECT s.event_id, s.cache_key, entry, entry IS NOT NULL AS hit
    FROM searches s LEFT JOIN answers a ON a.event_id = s.event_id WHERE event_type <> 'purchase'""",
)
def _cache_lookup(spark, sf_dir):
    searches = request_log(spark, sf_dir).withColumn("cache_key", F.sha2("client", 256))
    stored = searches.where(F.col("endpoint") == "purchase").select(
        "cache_key", F.col("ts").alias("created_at"), F.col("request_id").alias("entry")
    )
    asked = searches.where(F.col("endpoint") != "purchase").select(
        F.col("request_id").alias("event_id"), "cache_key", F.col("ts").alias("asked_at")
    )
    return cache_lookup(asked, stored, ttl_seconds=43_200, tie=["entry"]).select("event_id", "cache_key", "entry", "hit")
