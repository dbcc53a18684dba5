"""Landed API payloads turned into papers.

Input rows are ``(topic, source_rank, payload)`` with one response item as JSON text per row (PubMed: one response per
row).  Every mapper adds ``source`` and ``source_pos`` and a ``reject_reason`` that is null for usable items;
:func:`accepted` and :func:`rejected` split the result.  A bad item never costs its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import or_null, strip, words
from paperloom.schemas import PAPER_COLUMNS, SOURCES
from paperloom.session import compute_once

_CORRUPT = "_corrupt_record"
_PARSE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
# Names are kept as maps so that an absent name and a null name stay apart.
_PEOPLE = "array<map<string,string>>"

ARXIV_ITEM = f"""id string, title string, authors {_PEOPLE}, summary string, published string, pdf_url string,
    doi string, entry_id string, {_CORRUPT} string"""
ARXIV_ENTRY = f"""id string, title string, summary string, published string, author array<struct<name string>>,
    link array<struct<_href string, _title string>>, doi string, {_CORRUPT} string"""
SEMANTIC_SCHOLAR_ITEM = f"""paperId string, title string, authors {_PEOPLE}, abstract string, year bigint,
    externalIds struct<DOI string>, openAccessPdf struct<url string>, url string, {_CORRUPT} string"""
PUBMED_RESPONSE = f"idlist array<string>, result map<string,string>, {_CORRUPT} string"
PUBMED_ITEM = f"""title string, authors {_PEOPLE}, pubdate string, articleids array<struct<idtype string, value string>>,
    {_CORRUPT} string"""
OPENALEX_ITEM = f"""id string, title string, display_name string, authorships array<struct<author map<string,string>>>,
    abstract_inverted_index map<string,array<int>>, publication_year bigint, open_access struct<oa_url string>,
    doi string, {_CORRUPT} string"""


def _parsed(df: DataFrame, schema: str) -> DataFrame:
    """``item`` by the fixed schema and ``document`` as it is, each parsed once per payload."""
    return compute_once(df, item=F.from_json("payload", schema, _PARSE), document=F.try_parse_json("payload"))


def _is_null(field: str) -> Column:
    """True where the field is given as null; an absent one is no such case."""
    return F.schema_of_variant(F.try_variant_get("document", f"$.{field}", "variant")) == "VOID"


def _not_text(fields: Iterable[str]) -> Column:
    """True if one of the fields holds a JSON value other than text or null."""
    document = F.col("document")
    checks = [
        ~F.coalesce(F.schema_of_variant(F.try_variant_get(document, f"$.{field}", "variant")), F.lit("VOID")).isin(
            "STRING", "VOID"
        )
        for field in fields
    ]
    wrong = checks[0]
    for check in checks[1:]:
        wrong = wrong | check
    return wrong


def _names(people: Column, field: str) -> Column:
    """One name per person; '' where the field is absent, null where it is null."""
    return F.transform(
        F.coalesce(people, F.array().cast(_PEOPLE)),
        lambda person: F.when(F.map_contains_key(person, field), F.try_element_at(person, F.lit(field))).otherwise(
            F.lit("")
        ),
    )


def _first_of_year(year: Column) -> Column:
    return F.when(year.between(1, 9999), F.make_date(year.cast("int"), F.lit(1), F.lit(1)))


def _bad_year(year: Column) -> Column:
    return F.coalesce((year != 0) & ~year.between(1, 9999), F.lit(False))


def _reject(*rules: tuple[str, Column]) -> Column:
    """The first reason that applies, else null."""
    reason = F.when(F.lit(False), F.lit(""))
    for text, applies in rules:
        reason = reason.when(F.coalesce(applies, F.lit(False)), F.lit(text))
    return reason


def _malformed() -> tuple[str, Column]:
    return "malformed", F.col(_CORRUPT).isNotNull() | F.col("payload").isNull()


def _nameless(authors: str) -> Column:
    return F.exists(authors, lambda name: name.isNull())


def _finish(mapped: DataFrame, source: str, reason: Column, extra: tuple[str, ...] = ("topic", "source_rank")) -> DataFrame:
    columns = [F.lit(source).alias(name) if name == "source" else F.col(name) for name in PAPER_COLUMNS]
    return mapped.select(
        *extra, *columns, F.lit(SOURCES.index(source)).alias("source_pos"), reason.alias("reject_reason"), "payload"
    )


def _single_line(text: Column) -> Column:
    return F.translate(strip(text), "\n", " ")


def arxiv_papers(landed: DataFrame) -> DataFrame:
    item = _parsed(landed, ARXIV_ITEM)
    mapped = item.select(
        "topic",
        "source_rank",
        "payload",
        F.col("item.id").alias("external_id"),
        _single_line(F.col("item.title")).alias("title"),
        F.transform("item.authors", lambda person: F.try_element_at(person, F.lit("name"))).alias("authors"),
        _single_line(or_null(F.col("item.summary"))).alias("abstract"),
        F.to_date(F.try_to_timestamp("item.published")).alias("published_date"),
        "item.pdf_url",
        "item.doi",
        F.col("item.entry_id").alias("url"),
        F.col(f"item.{_CORRUPT}").alias(_CORRUPT),
        "document",
    )
    reason = _reject(
        _malformed(),
        ("wrong type", _not_text(["id", "title", "summary", "doi", "pdf_url", "entry_id"])),
        ("no id", F.col("external_id").isNull()),
        ("no title", F.col("title").isNull()),
        ("null author", F.col("authors").isNull() | _nameless("authors")),
    )
    return _finish(mapped, "arxiv", reason)


def arxiv_feed_papers(landed: DataFrame) -> DataFrame:
    """Papers of arXiv's own Atom feed, one ``<entry>`` element as XML text per row.

    Namespaces are ignored, so prefixed elements are read by their names.  The id is the end of the entry's address, the
    PDF its link of that title.  An entry that is not well-formed costs only itself.
    """
    entry = compute_once(landed, item=F.from_xml("payload", ARXIV_ENTRY, {**_PARSE, "ignoreNamespace": "true"}))
    pdf = F.filter("item.link", lambda link: link["_title"] == "pdf")
    mapped = entry.select(
        "topic",
        "source_rank",
        "payload",
        F.substring_index("item.id", "arxiv.org/abs/", -1).alias("external_id"),
        _single_line(F.col("item.title")).alias("title"),
        F.coalesce(F.transform("item.author", lambda author: strip(author["name"])), F.array().cast("array<string>")).alias("authors"),
        _single_line(or_null(F.col("item.summary"))).alias("abstract"),
        F.to_date(F.try_to_timestamp("item.published")).alias("published_date"),
        F.get(pdf, 0)["_href"].alias("pdf_url"),
        "item.doi",
        F.col("item.id").alias("url"),
        F.col(f"item.{_CORRUPT}").alias(_CORRUPT),
    )
    reason = _reject(
        _malformed(),
        ("no id", F.col("external_id").isNull()),
        ("no title", F.col("title").isNull()),
        ("null author", _nameless("authors")),
    )
    return _finish(mapped, "arxiv", reason)


def semantic_scholar_papers(landed: DataFrame) -> DataFrame:
    item = _parsed(landed, SEMANTIC_SCHOLAR_ITEM)
    mapped = item.select(
        "topic",
        "source_rank",
        "payload",
        # An absent id becomes '', an explicit null makes the item unusable.
        F.coalesce("item.paperId", F.lit("")).alias("external_id"),
        F.coalesce(or_null(F.col("item.title")), F.lit("Untitled")).alias("title"),
        _names(F.col("item.authors"), "name").alias("authors"),
        "item.abstract",
        _first_of_year(F.col("item.year")).alias("published_date"),
        F.col("item.openAccessPdf.url").alias("pdf_url"),
        F.col("item.externalIds.DOI").alias("doi"),
        "item.url",
        F.col(f"item.{_CORRUPT}").alias(_CORRUPT),
        "document",
        F.col("item.year").alias("year"),
    )
    reason = _reject(
        _malformed(),
        ("wrong type", _not_text(["paperId", "title", "abstract", "url", "externalIds.DOI", "openAccessPdf.url"])),
        ("no id", _is_null("paperId")),
        ("null author", _nameless("authors")),
        ("bad year", _bad_year(F.col("year"))),
    )
    return _finish(mapped, "semantic_scholar", reason)


def pubmed_date(pubdate: Column) -> Column:
    """1 January of the year that starts the text, null when it does not start with one."""
    return _first_of_year(F.get(words(pubdate), F.lit(0)).try_cast("int"))


def pubmed_papers(landed: DataFrame) -> DataFrame:
    """``payload`` holds the id list and the summaries by id; ids without a summary are left out."""
    response = compute_once(landed, response=F.from_json("payload", PUBMED_RESPONSE, _PARSE))
    unreadable = F.col("payload").isNull() | F.col(f"response.{_CORRUPT}").isNotNull()
    ids = F.when(unreadable, F.array(F.lit(None).cast("string"))).otherwise(F.col("response.idlist"))
    listed = response.select(
        "topic",
        "source_rank",
        unreadable.alias("unreadable"),
        "payload",
        F.col("response.result").alias("summaries"),
        F.posexplode(ids).alias("list_pos", "pmid"),
    )
    summary = F.when(F.col("unreadable"), F.col("payload")).otherwise(F.try_element_at("summaries", "pmid"))
    found = listed.select(
        "topic", "source_rank", "unreadable", "list_pos", "pmid", summary.alias("payload")
    ).where(F.col("unreadable") | ~F.coalesce(F.col("payload").isin("", "{}", "null"), F.lit(True)))
    item = _parsed(found, PUBMED_ITEM)
    doi = F.get(F.filter("item.articleids", lambda entry: entry["idtype"] == "doi"), F.lit(0))["value"]
    mapped = item.select(
        "topic",
        # By response, then by place in its id list, which is an int.
        (F.shiftleft(F.col("source_rank").cast("bigint"), 32) + F.col("list_pos")).alias("source_rank"),
        "payload",
        F.col("pmid").alias("external_id"),
        F.coalesce(or_null(F.col("item.title")), F.lit("Untitled")).alias("title"),
        _names(F.col("item.authors"), "name").alias("authors"),
        F.lit(None).cast("string").alias("abstract"),
        pubmed_date(F.col("item.pubdate")).alias("published_date"),
        F.lit(None).cast("string").alias("pdf_url"),
        doi.alias("doi"),
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/")).alias("url"),
        F.col(f"item.{_CORRUPT}").alias(_CORRUPT),
        "document",
        "unreadable",
    )
    reason = _reject(
        ("malformed", F.col("unreadable")),
        _malformed(),
        ("wrong type", _not_text(["title", "pubdate"])),
        ("null author", _nameless("authors")),
    )
    return _finish(mapped, "pubmed", reason)


def with_inverted_abstract(df: DataFrame, index: Column, name: str = "abstract") -> DataFrame:
    """Add the text of a map of word to positions.

    Words in position order, single spaces, no text for an empty or missing map.  When two words claim a position, the
    later entry of the map has it.
    """
    placed = F.flatten(
        F.transform(
            F.map_entries(index),
            lambda entry, nth: F.transform(
                entry["value"],
                lambda position: F.struct(position.alias("position"), nth.alias("nth"), entry["key"].alias("word")),
            ),
        )
    )
    ordered = compute_once(df, _ordered=F.sort_array(placed))
    # Next to its successor, an entry shows whether a later one claims the same position.
    winners = F.zip_with(
        "_ordered",
        F.slice("_ordered", F.lit(2), F.greatest(F.size("_ordered"), F.lit(1))),
        lambda entry, following: F.when(
            following["position"].isNull() | (following["position"] != entry["position"]), entry["word"]
        ),
    )
    # array_join leaves out the nulls of replaced words.
    return ordered.withColumn(name, or_null(F.array_join(winners, " "))).drop("_ordered")


def openalex_papers(landed: DataFrame) -> DataFrame:
    item = with_inverted_abstract(_parsed(landed, OPENALEX_ITEM), F.col("item.abstract_inverted_index"))
    people = F.transform(
        F.filter("item.authorships", lambda entry: F.coalesce(F.size(entry["author"]), F.lit(0)) > 0),
        lambda entry: entry["author"],
    )
    mapped = item.select(
        "topic",
        "source_rank",
        "payload",
        F.substring_index(F.coalesce("item.id", F.lit("")), "/", -1).alias("external_id"),
        F.coalesce(
            or_null(F.col("item.title")), or_null(F.col("item.display_name")), F.lit("Untitled")
        ).alias("title"),
        _names(people, "display_name").alias("authors"),
        "abstract",
        _first_of_year(F.col("item.publication_year")).alias("published_date"),
        F.col("item.open_access.oa_url").alias("pdf_url"),
        or_null(F.replace(F.col("item.doi"), F.lit("https://doi.org/"), F.lit(""))).alias("doi"),
        F.col("item.id").alias("url"),
        F.col(f"item.{_CORRUPT}").alias(_CORRUPT),
        "document",
        F.col("item.publication_year").alias("year"),
    )
    reason = _reject(
        _malformed(),
        ("wrong type", _not_text(["id", "title", "display_name", "doi", "open_access.oa_url"])),
        ("no id", _is_null("id")),
        ("null author", _nameless("authors")),
        ("bad year", _bad_year(F.col("year"))),
    )
    return _finish(mapped, "openalex", reason)


def accepted(mapped: DataFrame) -> DataFrame:
    return mapped.where(F.col("reject_reason").isNull()).drop("reject_reason", "payload")


def rejected(mapped: DataFrame) -> DataFrame:
    return mapped.where(F.col("reject_reason").isNotNull()).select(
        "topic", "source", "source_rank", "reject_reason", "payload"
    )


MAPPERS = {
    "arxiv": arxiv_papers,
    "semantic_scholar": semantic_scholar_papers,
    "pubmed": pubmed_papers,
    "openalex": openalex_papers,
}


def read_landed(spark, path: str) -> DataFrame:
    """JSON lines of ``{topic, source_rank, payload}``; the schema is fixed, nothing is inferred."""
    return spark.read.schema("topic string, source_rank bigint, payload string").json(path)
