"""WARC derivatives of crawled responses: linked metadata and plain-text conversion records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import compute_once

NEWLINE = "\r\n"
#: Date of records whose source names none.
NO_DATE = "1970-01-01T00:00:00Z"
#: Patterns that turn a page into text, in this order; the same in Java and RE2. What is not closed reaches to the end
#: of the page (a head to the first block), so no pattern scans the same text once for each opening mark.
TEXT_STEPS = [
    (r"(?s)<!--.*?(?:-->|\z)", " "),
    (r"(?is)<script\b.*?(?:</script\s*>|\z)", " "),
    (r"(?is)<style\b.*?(?:</style\s*>|\z)", " "),
    (r"(?is)<noscript\b.*?(?:</noscript\s*>|\z)", " "),
    (
        r"(?is)<head\b.*?(?:</head\s*>|<(?:body|article|div|h[1-6]|header|main|nav|ol|p|pre|section|table|ul)\b[^>]*"
        r"(?:>|\z)|\z)",
        "\n",
    ),
    (
        r"(?i)</?(address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|"
        r"pre|section|table|td|th|tr|ul)\b[^>]*(?:>|\z)",
        "\n",
    ),
    (r"<[/!?a-zA-Z][^>]*(?:>|\z)", ""),
]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
SPACE_STEPS = [(r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", "")]
TITLE = r"(?is)<title\b(?:[^>]*>(.*?)(?:</title|\z)|[^>]*\z)"
LANGUAGE = r"(?is)<html\b[^<>]*?\slang=.([a-z-]+)"
#: Become spaces in header values, so that no value can write lines of its own.
CONTROLS = r"[\x00-\x1F\x7F]"


def plain_text(html: Column) -> Column:
    """The page's text: no markup, scripts or head; a line for each block, single spaces, the common entities.

    Marks left open reach to the end of the page, an open head to the first block.
    """
    for pattern, put in TEXT_STEPS:
        html = F.regexp_replace(html, pattern, put)
    return _tidied(html)


def _tidied(text: Column) -> Column:
    for entity, letter in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(letter))
    for pattern, put in SPACE_STEPS:
        text = F.regexp_replace(text, pattern, put)
    return text


def _uuid(*parts: Column) -> Column:
    """A record id that follows from its parts, so that a job run again gives the same records."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(part.cast("string"), F.lit("")) for part in parts]).cast("binary"))
    pieces = [F.substring(digest, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *pieces))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def _lines(*fields: tuple[str, Column]) -> Column:
    """``name: value`` lines with control characters as spaces; a null value has no line."""
    lines = [F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), CONTROLS, " "), F.lit(NEWLINE)) for name, value in fields]
    return F.concat(*[F.coalesce(line, F.lit("")) for line in lines])


def responses(pages: DataFrame) -> DataFrame:
    """``(page_id, record_id, target_uri, date, http_headers, payload)`` of ``pages(page_id, url, html)``."""
    html = F.coalesce("html", F.lit(""))
    length = F.octet_length(html).cast("string")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{NEWLINE}Content-Type: text/html; charset=utf-8{NEWLINE}Content-Length: "), length)
    return pages.select(
        "page_id",
        _uuid(F.lit("response"), F.col("page_id"), F.col("url"), _digest(html)).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(None).cast("string").alias("date"),
        head.alias("http_headers"),
        html.alias("payload"),
    )


def derivatives(source: DataFrame) -> DataFrame:
    """Two rows for every response: its ``metadata`` and its plain-text ``conversion`` record.

    Columns: ``page_id``, ``warc_type``, ``record_id``, ``refers_to`` (the response's record id), ``target_uri``,
    ``source_digest`` (of the response's payload), ``block_digest``, ``content_length`` in octets, ``record`` (the record
    up to the blank lines that end it). The metadata record carries the response's HTTP headers, digest, title and
    language and names the conversion record it belongs to; both keep the response's date and URI.

    A null payload is empty text, a null URI or header has no line, a null date is 1970. Control characters in
    header values become spaces; ``target_uri`` stays as given. Equal responses give equal
    records. Further columns are ignored, an empty table gives no rows.
    """
    html = F.coalesce("payload", F.lit(""))
    date = F.coalesce("date", F.lit(NO_DATE))
    title, language = F.regexp_extract("html", TITLE, 1), F.regexp_extract("html", LANGUAGE, 1)
    given = source.select("page_id", "record_id", "target_uri", date.alias("date"), "http_headers", html.alias("html"))
    html = F.col("html")
    read = compute_once(
        given,
        source_digest=_digest(html),
        text=plain_text(html),
        title=F.nullif(F.regexp_replace(_tidied(title), r"\s+", " "), F.lit("")),
        language=F.nullif(F.lower(language), F.lit("")),
    ).drop("html")
    named = read.select(
        "*",
        _uuid(F.lit("metadata"), F.col("record_id")).alias("metadata_id"),
        _uuid(F.lit("conversion"), F.col("record_id")).alias("conversion_id"),
    )
    headers = F.regexp_replace("http_headers", r"\r\n", "; ")
    fields = _lines(
        ("title", F.col("title")), ("language", F.col("language")), ("source-http-headers", headers),
        ("source-payload-digest", F.col("source_digest")), ("conversion-record-id", F.concat(F.lit("<"), F.col("conversion_id"), F.lit(">"))),
        ("characters", F.length("text")),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.col("metadata_id").alias("id"), F.lit("application/warc-fields").alias("kind"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.col("conversion_id").alias("id"), F.lit("text/plain; charset=UTF-8").alias("kind"), F.col("text").alias("block")),
    )
    each = named.select("page_id", F.col("record_id").alias("source_id"), "target_uri", "date", "source_digest", F.inline(kinds))
    sized = each.select("*", _digest(F.col("block")).alias("block_digest"), F.octet_length("block").cast("long").alias("content_length"))
    angled = lambda name: F.concat(F.lit("<"), F.col(name), F.lit(">"))
    head = _lines(
        ("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", angled("id")), ("WARC-Date", F.col("date")),
        ("WARC-Target-URI", F.col("target_uri")), ("WARC-Refers-To", angled("source_id")), ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("kind")), ("Content-Length", F.col("content_length")),
    )
    record = F.concat(F.lit(f"WARC/1.1{NEWLINE}"), head, F.lit(NEWLINE), F.col("block"))
    return sized.select(
        "page_id", "warc_type", F.col("id").alias("record_id"), F.col("source_id").alias("refers_to"), "target_uri",
        "source_digest", "block_digest", "content_length", record.alias("record"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files of ``records(record)``: records one after another, each ended by two blank lines."""
    records.select("record").write.option("lineSep", NEWLINE * 2).text(path)


def _sql_text(value: str, steps) -> str:
    for pattern, put in steps:
        put = "chr(10)" if put == "\n" else f"'{put}'"
        value = f"regexp_replace({value}, '{pattern}', {put}, 'g')"
    return value


def _sql_tidied(value: str) -> str:
    for entity, letter in ENTITIES:
        letter = letter.replace("'", "''")
        value = f"replace({value}, '{entity}', '{letter}')"
    return _sql_text(value, SPACE_STEPS)


def _sql_uuid(*parts: str) -> str:
    digest = f"md5({" || '|' || ".join(parts)})"
    pieces = " || '-' || ".join(f"substr({digest}, {at}, {size})" for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'urn:uuid:' || {pieces}"


END = "chr(13) || chr(10)"
WARC_SQL = f"""
WITH source AS (
    SELECT page_id, url, coalesce(html, '') AS html, 'sha256:' || sha256(coalesce(html, '')) AS source_digest FROM pages),
read AS (
    SELECT *, {_sql_uuid("'response'", "coalesce(CAST(page_id AS VARCHAR), '')", "coalesce(url, '')", "source_digest")} AS source_id,
           {_sql_tidied(_sql_text("html", TEXT_STEPS))} AS text,
           nullif(regexp_replace({_sql_tidied(f"regexp_extract(html, '{TITLE}', 1)")}, '\\s+', ' ', 'g'), '') AS title,
           nullif(lower(regexp_extract(html, '{LANGUAGE}', 1)), '') AS language
    FROM source),
named AS (
    SELECT *, {_sql_uuid("'metadata'", "source_id")} AS metadata_id, {_sql_uuid("'conversion'", "source_id")} AS conversion_id FROM read),
each_one AS (
    SELECT *, 'metadata' AS warc_type, metadata_id AS record_id, 'application/warc-fields' AS kind,
           coalesce('title: ' || regexp_replace(title, '{CONTROLS}', ' ', 'g') || {END}, '') || coalesce('language: ' || language || {END}, '')
           || 'source-http-headers: HTTP/1.1 200 OK; Content-Type: text/html; charset=utf-8; Content-Length: ' || strlen(html) || {END}
           || 'source-payload-digest: ' || source_digest || {END} || 'conversion-record-id: <' || conversion_id || '>' || {END}
           || 'characters: ' || length(text) || {END} AS block
    FROM named
    UNION ALL SELECT *, 'conversion', conversion_id, 'text/plain; charset=UTF-8', text FROM named),
sized AS (SELECT *, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length FROM each_one)
SELECT page_id, warc_type, record_id, source_id AS refers_to, url AS target_uri, source_digest, block_digest, content_length,
       'WARC/1.1' || {END} || 'WARC-Type: ' || warc_type || {END} || 'WARC-Record-ID: <' || record_id || '>' || {END}
       || 'WARC-Date: {NO_DATE}' || {END} || coalesce('WARC-Target-URI: ' || regexp_replace(url, '{CONTROLS}', ' ', 'g') || {END}, '')
       || 'WARC-Refers-To: <' || source_id || '>' || {END} || 'WARC-Block-Digest: ' || block_digest || {END}
       || 'Content-Type: ' || kind || {END} || 'Content-Length: ' || content_length || {END} || {END} || block AS record
FROM sized
"""
