"""Text extraction from document payloads: HTML by expressions, anything else with an injected function."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.text import strip
from paperloom.schemas import EXTRACTION_FAILED, SUCCESS

#: Character references that :func:`visible_text` resolves, the ampersand last.
HTML_REFERENCES = (
    ("&nbsp;", "\u00a0"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&amp;", "&"),
)
HIDDEN_TAGS = ("script", "style", "template", "noscript")


def visible_text(html: Column) -> Column:
    """Text of an HTML document, a line per run between tags.

    Hidden blocks and comments reach to their end mark or to the end of the document.  Other character references than
    those of ``HTML_REFERENCES`` stay as they are; :func:`html_pages` resolves all.
    """
    text = html
    for tag in HIDDEN_TAGS:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)", "\n")
    text = F.regexp_replace(text, r"(?s)<!--.*?(?:-->|\z)", "\n")
    text = F.regexp_replace(text, "<[/!?a-zA-Z][^>]*>", "\n")
    for name, sign in HTML_REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return strip(F.regexp_replace(text, r"[ \t\r\f\x0B\xA0]*\n\s*", "\n"))


def html_pages(html: str) -> list[str]:
    """Visible text of an HTML document as a single page; anything without markup is refused."""
    if "<" not in html:
        raise ValueError("not an HTML document")
    hidden = set(HIDDEN_TAGS)
    pieces: list[str] = []

    class Visible(HTMLParser):
        depth = 0

        def handle_starttag(self, tag, attrs):
            self.depth += tag in hidden

        def handle_endtag(self, tag):
            self.depth -= tag in hidden and self.depth > 0

        def handle_data(self, data):
            if not self.depth and data.strip():
                pieces.append(data.strip())

    parser = Visible(convert_charrefs=True)
    parser.feed(html)
    parser.close()
    return ["\n".join(pieces)]


def extract_text(
    documents: DataFrame,
    extract: Callable[[object], list[str]] | None = None,
    id_col: str = "paper_id",
    payload_col: str = "payload",
) -> DataFrame:
    """One row per page: ``(id, page_no, text, status, message)``.

    ``extract`` turns a payload into its list of page texts; without it, payloads are HTML of a single page, read by
    :func:`visible_text`.  A document that cannot be read yields one row with status ``extraction_failed`` and the error;
    other documents are not affected.
    """
    if extract is None:
        readable = F.coalesce(F.contains(F.col(payload_col), F.lit("<")), F.lit(False))
        return documents.select(
            id_col,
            F.when(readable, F.lit(0)).alias("page_no"),
            F.when(readable, visible_text(F.col(payload_col))).alias("text"),
            F.when(readable, F.lit(SUCCESS)).otherwise(F.lit(EXTRACTION_FAILED)).alias("status"),
            F.when(~readable, F.lit("not an HTML document")).alias("message"),
        )
    id_field = documents.schema[id_col]
    schema = T.StructType(
        [
            T.StructField(id_col, id_field.dataType),
            T.StructField("page_no", T.IntegerType()),
            T.StructField("text", T.StringType()),
            T.StructField("status", T.StringType()),
            T.StructField("message", T.StringType()),
        ]
    )

    def pages_of(key, payload):
        try:
            texts = extract(payload)
        except Exception as error:
            return [(key, None, None, EXTRACTION_FAILED, str(error))]
        return [(key, number, text, SUCCESS, None) for number, text in enumerate(texts)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for key, payload in zip(batch[id_col], batch[payload_col]) for row in pages_of(key, payload)]
            frame = pd.DataFrame(rows, columns=schema.fieldNames())
            yield frame.astype({"page_no": "Int32"})

    return documents.select(id_col, payload_col).mapInPandas(run, schema)
