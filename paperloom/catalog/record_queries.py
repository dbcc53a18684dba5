"""arXiv's feed and records at rest, over the paper view."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.catalog.fixtures import PAPER_VIEW, day, joined, paper_view, sql_strip
from paperloom.catalog.registry import query
from paperloom.operators.records import read_records, store_records
from paperloom.session import fresh_path
from paperloom.sources.payloads import arxiv_feed_papers

# Not allowed in XML, so no feed holds them.
_UNFIT = r"[\x00-\x09\x0B-\x1F]"
_MARKS = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]
_ENTRY = '<entry xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">'


def _escaped(text):
    text = F.regexp_replace(text, _UNFIT, " ")
    for sign, reference in _MARKS:
        text = F.replace(text, F.lit(sign), F.lit(reference))
    return text


def _element(name, text):
    return F.coalesce(F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>")), F.lit(""))


def _link(title, address):
    return F.coalesce(F.concat(F.lit(f'<link title="{title}" href="'), address, F.lit('" rel="related"/>')), F.lit(""))


def landed_feed(spark, sf_dir):
    """A feed entry per document, every seventeenth cut off before its end mark."""
    people = F.transform("authors", lambda name: _element("author", _element("name", F.concat(F.lit("A. "), _escaped(name)))))
    entry = F.concat(
        F.lit(_ENTRY),
        _element("id", F.concat(F.lit("http://arxiv.org/abs/"), F.col("external_id"))),
        _element("title", _escaped(F.concat(F.lit("On "), F.col("title")))),
        _element("summary", _escaped(F.concat(F.lit("We "), F.col("abstract")))),
        _element("published", F.concat(day("published_date"), F.lit("T10:00:00Z"))),
        F.array_join(people, ""),
        _link("other", F.col("url")),
        _link("pdf", F.nullif("pdf_url", F.lit(""))),
        _element("arxiv:doi", F.col("doi")),
        F.when(F.col("doc_id") % 17 != 0, F.lit("</entry>")).otherwise(F.lit("")),
    )
    return paper_view(spark, sf_dir).select("topic", "source_rank", entry.alias("payload"))


def _read_text(text):
    return f"translate({sql_strip(f"regexp_replace({text}, '{_UNFIT}', ' ', 'g')")}, chr(10), ' ')"


@query(
    "src_arxiv_atom",
    f"""WITH {PAPER_VIEW}, fit AS (SELECT *, doc_id % 17 <> 0 AS fit FROM paper_view)
    SELECT doc_id AS source_rank, CASE WHEN NOT fit THEN 'malformed' END AS reject_reason,
           CASE WHEN fit THEN external_id END AS external_id,
           CASE WHEN fit THEN {_read_text("'On ' || title")} END AS title,
           CASE WHEN fit THEN {_read_text("'We ' || abstract")} END AS abstract,
           CASE WHEN fit THEN coalesce(array_to_string(list_transform(authors, lambda a: {_read_text("'A. ' || a")}), '|'), '')
                ELSE '' END AS authors,
           CASE WHEN fit THEN strftime(published_date, '%Y-%m-%d') END AS published,
           CASE WHEN fit THEN nullif(pdf_url, '') END AS pdf_url, CASE WHEN fit THEN doi END AS doi,
           CASE WHEN fit THEN 'http://arxiv.org/abs/' || external_id END AS url
    FROM fit""",
)
def _src_arxiv_atom(spark, sf_dir):
    return arxiv_feed_papers(landed_feed(spark, sf_dir)).select(
        "source_rank", "reject_reason", "external_id", "title", "abstract", joined("authors").alias("authors"),
        day("published_date").alias("published"), "pdf_url", "doi", "url",
    )


@query(
    "records_round_trip",
    f"""WITH {PAPER_VIEW}, fit AS (SELECT *, doc_id % 19 <> 0 AND doc_id % 23 <> 0 AS fit FROM paper_view)
    SELECT doc_id, fit AS readable, CASE WHEN fit THEN title END AS title, CASE WHEN fit THEN abstract END AS abstract,
           CASE WHEN fit THEN authors[1] END AS first_author, CASE WHEN fit THEN year(published_date) END AS year,
           CASE WHEN fit THEN doi END AS doi
    FROM fit""",
)
def _records_round_trip(spark, sf_dir):
    """Papers as JSON, every nineteenth cut off, every twenty-third with its year given twice."""
    body = F.to_json(F.struct("title", "abstract", "authors", F.year("published_date").alias("year"), F.struct("doi").alias("ids")))
    broken = F.when(F.col("doc_id") % 19 == 0, F.substring(body, 1, 12)).when(
        F.col("doc_id") % 23 == 0, F.concat(F.lit('{"year":1,"year":2,'), F.substring(body, 2, 2**30))
    )
    path = fresh_path(spark, "records")
    store_records(paper_view(spark, sf_dir).select("doc_id", F.coalesce(broken, body).alias("body")), path)
    return read_records(
        spark.read.parquet(path), title=("$.title", "string"), abstract=("$.abstract", "string"),
        first_author=("$.authors[0]", "string"), year=("$.year", "bigint"), doi=("$.ids.doi", "string"),
    )
