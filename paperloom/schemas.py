"""Schemas, enumerations and defaults."""

from pyspark.sql import types as T

# Source codes in default merge order, with their display names.
SOURCES = ("arxiv", "semantic_scholar", "pubmed", "openalex")
SOURCE_LABELS = {
    "arxiv": "ArXiv",
    "semantic_scholar": "Semantic Scholar",
    "pubmed": "PubMed",
    "openalex": "OpenAlex",
}

# Ingest and summary statuses.
ALREADY_CACHED = "already_cached"
SUCCESS = "success"
NO_PDF_AVAILABLE = "no_pdf_available"
DOWNLOAD_FAILED = "download_failed"
EXTRACTION_FAILED = "extraction_failed"
SCANNED_PDF = "scanned_pdf"
NOT_INGESTED = "not_ingested"
NO_CHUNKS_AVAILABLE = "no_chunks_available"
LLM_FAILED = "llm_failed"

# Relation names and the node label each one points to.
AUTHORED = "AUTHORED"
USES_METHOD = "USES_METHOD"
EVALUATED_ON = "EVALUATED_ON"
NODE_LABELS = {AUTHORED: "Author", USES_METHOD: "Method", EVALUATED_ON: "Dataset"}

# Required fields of a model summary, in report order.
SUMMARY_FIELDS = ("tldr", "problem", "method_explained", "key_results", "limitations")

# Defaults.
PER_SOURCE_CAP = 10
MAX_SOURCE_CAP = 50
SELECTED_PAPERS = 5
CACHE_TTL_SECONDS = 3600
CHUNK_SIZE = 1500
CHUNK_OVERLAP = 200
SUMMARY_CHUNKS = 3
ENTITY_CHUNKS = 1
MIN_CHARS_PER_PAGE = 50
LATENCY_WINDOW = 500
SEARCH_LIMIT_PER_HOUR = 30
DEFAULT_LIMIT_PER_HOUR = 100

PAPER = T.StructType(
    [
        T.StructField("external_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("abstract", T.StringType()),
        T.StructField("published_date", T.DateType()),
        T.StructField("pdf_url", T.StringType()),
        T.StructField("doi", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)
PAPER_COLUMNS = tuple(PAPER.fieldNames())
