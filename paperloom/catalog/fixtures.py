"""Papers, pages, edges and logs derived from the given tables, once in Spark and once in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import WHITESPACE, paper_id, title_key
from paperloom.schemas import EVALUATED_ON, SOURCES, USES_METHOD
from paperloom.session import spread, task_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, ready for costly work on their texts."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def joined(names, separator: str = "|"):
    return F.array_join(names, separator)


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd")


def moment(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def paper_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper per document; the language is the topic."""
    doc = F.col("doc_id")
    number = doc % 4
    titled = documents(spark, sf_dir).select(
        doc,
        "text",
        "n_chars",
        F.col("lang").alias("topic"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.split(F.substring_index("text", "\n", 1), " ").alias("_words"),
    )
    count = F.least(doc % 23, F.floor(F.size("_words") / 2)).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
        lambda nth: F.array_join(F.slice("_words", nth * 2 - 1, F.lit(2)), " "),
    )
    source = F.get(F.array(*[F.lit(name) for name in SOURCES]), number.cast("int"))
    external = F.concat(F.lit("10."), (doc % 7).cast("string"), F.lit("/"), doc.cast("string"))
    return titled.select(
        doc,
        "topic",
        external.alias("external_id"),
        source.alias("source"),
        number.cast("int").alias("source_pos"),
        doc.alias("source_rank"),
        "title",
        F.when(count > 0, pairs).otherwise(F.array().cast("array<string>")).alias("authors"),
        F.col("text").alias("abstract"),
        F.when(
            doc % 11 != 0, F.make_date((1990 + doc % 35).cast("int"), (1 + doc % 12).cast("int"), F.lit(1))
        ).alias("published_date"),
        F.when(doc % 3 != 0, F.concat(F.lit("10.1000/"), (F.col("n_chars") % 997).cast("string"))).alias("doi"),
        F.when(doc % 5 == 1, F.lit(""))
        .when(doc % 5 != 0, F.concat(F.lit("https://x/"), doc.cast("string")))
        .alias("pdf_url"),
        F.when(doc % 13 != 0, F.concat(F.lit("https://y/"), doc.cast("string"))).alias("url"),
        paper_id(source, external).alias("paper_id"),
    )


PAPER_VIEW = """paper_base AS (
    SELECT doc_id, lang AS topic, text, n_chars, split_part(text, chr(10), 1) AS title,
           string_split(split_part(text, chr(10), 1), ' ') AS w
    FROM documents),
paper_view AS (
    SELECT doc_id, topic, '10.' || (doc_id % 7) || '/' || doc_id AS external_id,
           CASE doc_id % 4 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'semantic_scholar' WHEN 2 THEN 'pubmed' ELSE 'openalex' END
               AS source,
           doc_id % 4 AS source_pos, doc_id AS source_rank, title,
           list_transform(generate_series(1, least(doc_id % 23, len(w) // 2)), lambda i: w[2 * i - 1] || ' ' || w[2 * i])
               AS authors,
           text AS abstract,
           CASE WHEN doc_id % 11 <> 0 THEN make_date(1990 + doc_id % 35, 1 + doc_id % 12, 1) END AS published_date,
           CASE WHEN doc_id % 3 <> 0 THEN '10.1000/' || (n_chars % 997) END AS doi,
           CASE WHEN doc_id % 5 = 1 THEN '' WHEN doc_id % 5 <> 0 THEN 'https://x/' || doc_id END AS pdf_url,
           CASE WHEN doc_id % 13 <> 0 THEN 'https://y/' || doc_id END AS url,
           CASE doc_id % 4 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'semantic_scholar' WHEN 2 THEN 'pubmed' ELSE 'openalex' END
               || '_10.' || (doc_id % 7) || '_' || doc_id AS paper_id
    FROM paper_base)"""


def metadata_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata written repeatedly under one id: documents with the same title key, in document order."""
    return (
        paper_view(spark, sf_dir)
        .withColumn("paper_id", F.coalesce(title_key(F.col("title")), F.lit("untitled")))
        .withColumn("seq", F.col("doc_id"))
    )


METADATA_WRITES = (
    PAPER_VIEW
    + """,
metadata_writes AS (
    SELECT * REPLACE (coalesce(nullif(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), ''), 'untitled') AS paper_id),
           doc_id AS seq
    FROM paper_view)"""
)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the papers: every line of a document is a page."""
    papers = paper_view(spark, sf_dir).select("paper_id", "abstract")
    return papers.select("paper_id", F.posexplode(F.split("abstract", "\n")).alias("page_no", "text"))


def sql_strip(text: str) -> str:
    return f"trim({text}, '{WHITESPACE}')"


DOCUMENT_LINES = """document_lines AS (
    SELECT paper_id, unnest(generate_series(0, len(string_split(abstract, chr(10))) - 1)) AS page_no,
           unnest(string_split(abstract, chr(10))) AS text
    FROM paper_view)"""


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per conversation, a page per turn."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("paper_id"), F.col("turn").alias("page_no"), "text"
    )


CONVERSATION_PAGES = """conversation_pages AS (
    SELECT 'conv_' || conv_id AS paper_id, turn AS page_no, text FROM conversations)"""


def sql_full_text(pages: str) -> str:
    """Assembled documents of a page table."""
    return f"""full_text AS (
    SELECT paper_id, count(*) AS page_count, string_agg({sql_strip("text")}, chr(10) || chr(10) ORDER BY page_no) AS text
    FROM {pages} GROUP BY paper_id)"""


def sql_chunks(source: str, key: str, size: int, overlap: int, name: str = "chunks") -> str:
    """Chunks of ``source(key, text)``."""
    step = size - overlap
    return f"""{name}_stripped AS (SELECT {key}, {sql_strip("text")} AS text FROM {source}),
{name}_windows AS (
    SELECT {key}, text, unnest(generate_series(0, length(text) - 1, {step})) AS first_char FROM {name}_stripped WHERE text <> ''),
{name}_pieces AS (
    SELECT {key}, first_char, {sql_strip(f"substr(text, first_char + 1, {size})")} AS text FROM {name}_windows
    WHERE first_char = 0 OR first_char - {step} + {size} < length(text)),
{name} AS (
    SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY first_char) - 1 AS chunk_index, text
    FROM {name}_pieces WHERE text <> '')"""


def edge_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for work on the edges, by the number of order lines, which the files tell without being read."""
    return task_count(spark, table(spark, sf_dir, "lineitem").count())


def edge_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(set_id, paper_id, year, method, dataset)`` per order line: order = paper, customer = set of papers.

    Partitioned by paper, and so are the edges that come of it.
    """
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("year")
    )
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("method"), F.col("p_type").alias("dataset"))
    used = lines.join(parts, "p_partkey").drop("p_partkey").repartition(edge_tasks(spark, sf_dir), "paper_id")
    return used.join(orders, "paper_id")


def edge_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ``(paper_id, rel, name)``."""
    both = F.array(
        F.struct(F.lit(USES_METHOD).alias("rel"), F.col("method").alias("name")),
        F.struct(F.lit(EVALUATED_ON).alias("rel"), F.col("dataset").alias("name")),
    )
    mentions = edge_mentions(spark, sf_dir).select("paper_id", F.explode(both).alias("edge"))
    return mentions.select("paper_id", "edge.rel", "edge.name").distinct()


def node_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper node per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("paper_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.year("o_orderdate").alias("year"),
    )


def member_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of papers per customer."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("paper_id"))


EDGE_VIEW = """mentions AS (
    SELECT o_custkey AS set_id, o_orderkey AS paper_id, year(o_orderdate) AS year, p_brand AS method, p_type AS dataset
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
edge_view AS (
    SELECT DISTINCT paper_id, 'USES_METHOD' AS rel, method AS name FROM mentions
    UNION ALL SELECT DISTINCT paper_id, 'EVALUATED_ON', dataset FROM mentions),
node_view AS (
    SELECT o_orderkey AS paper_id, 'Order ' || o_orderkey AS title, year(o_orderdate) AS year FROM orders),
member_view AS (SELECT o_custkey AS set_id, o_orderkey AS paper_id FROM orders)"""


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests from events: the type is the endpoint, an error event a failed request, the value the latency."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("endpoint"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("client"),
        F.when(F.col("event_type") == "error", F.lit(500)).otherwise(F.lit(200)).alias("status_code"),
        F.col("value").alias("latency_ms"),
    )


REQUEST_LOG = """request_log AS (
    SELECT event_id AS request_id, ts, event_type AS endpoint, 'user' || user_id AS client,
           CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, value AS latency_ms
    FROM events)"""
