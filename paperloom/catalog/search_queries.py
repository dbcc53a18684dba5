"""Search, dedupe, citations and payload mapping over the paper view."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.catalog.fixtures import PAPER_VIEW, day, documents, joined, paper_view, sql_strip, table
from paperloom.catalog.registry import query
from paperloom.functions import citation
from paperloom.functions.text import doi_key, id_list, title_key
from paperloom.operators.dedupe import dedupe_papers, merge_order
from paperloom.operators.incremental import create_kept, insert_kept, kept_rows
from paperloom.operators.search import (
    merge_sources,
    per_source_cap,
    recency_sort,
    restrict_sources,
    search_totals,
    select_top_n,
    year_filter,
)
from paperloom.operators.store import cache_key
from paperloom.plans.search import landed_papers, refine_hits, search_with_cache, with_cache_key
from paperloom.plans.search import search_papers as run_search
from paperloom.schemas import SOURCES
from paperloom.session import compute_once, cut_lineage, fresh_path
from paperloom.sources import payloads

TITLE_KEY_SQL = "nullif(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), '')"
DOI_KEY_SQL = f"nullif({sql_strip('lower(doi)')}, '')"


@query("title_key", f"WITH {PAPER_VIEW} SELECT doc_id, {TITLE_KEY_SQL} AS title_key FROM paper_view")
def _title_key(spark, sf_dir):
    return paper_view(spark, sf_dir).select("doc_id", title_key(F.col("title")).alias("title_key"))


@query("paper_id", f"WITH {PAPER_VIEW} SELECT doc_id, paper_id FROM paper_view")
def _paper_id(spark, sf_dir):
    return paper_view(spark, sf_dir).select("doc_id", "paper_id")


@query(
    "year_filter",
    f"""WITH {PAPER_VIEW} SELECT doc_id, CAST(year(published_date) AS BIGINT) AS year FROM paper_view
    WHERE year(published_date) BETWEEN 2000 AND 2015""",
)
def _year_filter(spark, sf_dir):
    kept = year_filter(paper_view(spark, sf_dir), 2000, 2015)
    return kept.select("doc_id", F.year("published_date").cast("bigint").alias("year"))


@query(
    "recency_sort",
    f"""WITH {PAPER_VIEW} SELECT doc_id, strftime(published_date, '%Y-%m-%d') AS published
    FROM paper_view ORDER BY published_date DESC NULLS LAST, source_pos, source_rank""",
)
def _recency_sort(spark, sf_dir):
    return recency_sort(paper_view(spark, sf_dir)).select("doc_id", day("published_date").alias("published"))


@query(
    "per_source_cap",
    f"""WITH {PAPER_VIEW}, ranked AS (
        SELECT topic, source, doc_id, row_number() OVER (PARTITION BY topic, source ORDER BY source_rank) AS n
        FROM paper_view)
    SELECT topic, source, doc_id FROM ranked WHERE n <= 10""",
)
def _per_source_cap(spark, sf_dir):
    return per_source_cap(paper_view(spark, sf_dir)).select("topic", "source", "doc_id")


@query(
    "merge_sources",
    f"""WITH {PAPER_VIEW} SELECT doc_id, source,
        CAST(CASE source WHEN 'openalex' THEN 0 WHEN 'pubmed' THEN 1 ELSE 2 END AS BIGINT) AS source_pos
    FROM paper_view WHERE source <> 'semantic_scholar'""",
)
def _merge_sources(spark, sf_dir):
    papers = paper_view(spark, sf_dir)
    merged = merge_sources([papers.where(F.col("source") == name) for name in SOURCES])
    asked = restrict_sources(merged, ["openalex", "pubmed", "arxiv"])
    return asked.select("doc_id", "source", F.col("source_pos").cast("bigint").alias("source_pos"))


@query(
    "select_top_n",
    f"""WITH {PAPER_VIEW}, ranked AS (
        SELECT topic, doc_id, row_number() OVER (PARTITION BY topic
            ORDER BY coalesce(pdf_url, '') <> '' DESC, published_date DESC NULLS LAST, source_pos, source_rank) AS n
        FROM paper_view)
    SELECT topic, doc_id, n AS selected_rank FROM ranked WHERE n <= 5""",
)
def _select_top_n(spark, sf_dir):
    chosen = select_top_n(paper_view(spark, sf_dir))
    return chosen.select("topic", "doc_id", F.col("selected_rank").cast("bigint").alias("selected_rank"))


@query("search_totals", f"WITH {PAPER_VIEW} SELECT topic, count(*) AS results FROM paper_view GROUP BY topic")
def _search_totals(spark, sf_dir):
    return search_totals(paper_view(spark, sf_dir))


def first_wins_sql(scope: str, papers: str = "paper_view") -> str:
    """Sequential walk: one row per step, carrying the keys of the kept rows."""
    return f"""keyed AS MATERIALIZED (
    SELECT doc_id, row_number() OVER (ORDER BY source_pos, source_rank) AS n,
           {scope} || ':' || {DOI_KEY_SQL} AS d, {scope} || ':' || {TITLE_KEY_SQL} AS t
    FROM {papers}),
walk(n, doc_id, kept, dois, titles) AS (
    SELECT 0::BIGINT, NULL::BIGINT, FALSE, []::VARCHAR[], []::VARCHAR[]
    UNION ALL
    SELECT k.n, k.doc_id, k.keep,
           CASE WHEN k.keep AND k.d IS NOT NULL THEN list_append(k.dois, k.d) ELSE k.dois END,
           CASE WHEN k.keep AND k.t IS NOT NULL THEN list_append(k.titles, k.t) ELSE k.titles END
    FROM (SELECT keyed.*, walk.dois, walk.titles,
                 NOT coalesce(list_contains(walk.dois, d), FALSE) AND NOT coalesce(list_contains(walk.titles, t), FALSE)
                     AS keep
          FROM walk JOIN keyed ON keyed.n = walk.n + 1) k)"""


@query("dedupe_papers", f"WITH RECURSIVE {PAPER_VIEW}, {first_wins_sql(chr(39) * 2)} SELECT doc_id FROM walk WHERE kept")
def _dedupe_papers(spark, sf_dir):
    return dedupe_papers(paper_view(spark, sf_dir)).select("doc_id")


@query("dedupe_incremental", f"WITH RECURSIVE {PAPER_VIEW}, {first_wins_sql(chr(39) * 2)} SELECT doc_id FROM walk WHERE kept")
def _dedupe_incremental(spark, sf_dir):
    """Three quarters of the papers first, the others in two insertions between them."""
    papers = paper_view(spark, sf_dir).select("doc_id", "doi", "title", merge_order().alias("ord"))
    keyed = cut_lineage(papers.select(
        "doc_id", F.lit("").alias("scope"), "ord", doi_key(F.col("doi")).alias("doi_key"), title_key(F.col("title")).alias("title_key")
    ))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    path = fresh_path(spark, "kept")
    create_kept(keyed.where(part < 6).drop("doc_id"), path)
    for number in (6, 7):
        insert_kept(spark, path, keyed.where(part == number).drop("doc_id"))
    keyless = keyed.where("doi_key is null and title_key is null").select("doc_id")
    return keyed.join(kept_rows(spark, path), ["scope", "ord"], "left_semi").select("doc_id").union(keyless)


@query(
    "search_papers",
    f"""WITH RECURSIVE {PAPER_VIEW}, {first_wins_sql("topic")}
    SELECT p.topic, p.doc_id, p.paper_id, p.title, strftime(p.published_date, '%Y-%m-%d') AS published
    FROM walk JOIN paper_view p ON p.doc_id = walk.doc_id
    WHERE kept AND year(p.published_date) BETWEEN 2000 AND 2015
    ORDER BY p.topic, p.published_date DESC, p.source_pos, p.source_rank""",
)
def search_papers(spark, sf_dir):
    found = refine_hits(paper_view(spark, sf_dir), 2000, 2015)
    return recency_sort(found, by=["topic"]).select(
        "topic", "doc_id", "paper_id", "title", day("published_date").alias("published")
    )


_PAPER = ("title", "authors", "published_date", "doi", "url")
_LAST_FIRST = """CASE WHEN len(p) < 2 THEN a
    ELSE p[-1] || ', ' || array_to_string(list_transform(p[:-2], lambda x: x[1] || '.'), ' ') END"""
_WORDS = "list_filter(regexp_split_to_array({}, '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda x: x <> '')"
_YEAR = "coalesce(CAST(year(published_date) AS VARCHAR), '{}')"
AUTHOR_NAMES_SQL = f"""author_words AS (
    SELECT doc_id, n, a, {_WORDS.format('a')} AS p
    FROM (SELECT doc_id, unnest(authors) AS a, unnest(generate_series(1, len(authors))) AS n FROM paper_view)),
author_names AS (SELECT doc_id, list({_LAST_FIRST} ORDER BY n) AS names FROM author_words GROUP BY doc_id)"""
APA_SQL = f"""CASE WHEN names IS NULL THEN 'Unknown Author' WHEN len(names) = 1 THEN names[1]
        WHEN len(names) <= 20 THEN array_to_string(names[:-2], ', ') || ', & ' || names[-1]
        ELSE array_to_string(names[:19], ', ') || ', ... ' || names[-1] END
    || ' (' || {_YEAR.format('n.d.')} || '). ' || rtrim(title, '.') || '.'
    || CASE WHEN coalesce(doi, '') <> '' THEN ' https://doi.org/' || doi WHEN coalesce(url, '') <> '' THEN ' ' || url
       ELSE '' END"""
BIBTEX_KEY_SQL = f"""CASE WHEN coalesce(len({_WORDS.format('authors[1]')}), 0) = 0 THEN 'unknown'
        ELSE lower(regexp_replace(({_WORDS.format('authors[1]')})[-1], '[^a-zA-Z]', '', 'g')) END
    || {_YEAR.format('nd')}
    || CASE WHEN len({_WORDS.format('title')}) = 0 THEN 'paper'
       ELSE lower(regexp_replace(({_WORDS.format('title')})[1], '[^a-zA-Z]', '', 'g')) END"""
BIBTEX_SQL = f"""'@article{{' || {BIBTEX_KEY_SQL} || ',' || chr(10) || '  title = {{' || title || '}},' || chr(10)
    || '  author = {{' || CASE WHEN len(authors) > 0 THEN array_to_string(authors, ' and ') ELSE 'Unknown Author' END
    || '}},' || chr(10) || '  year = {{' || {_YEAR.format('n.d.')} || '}},' || chr(10)
    || CASE WHEN coalesce(doi, '') <> '' THEN '  doi = {{' || doi || '}},' || chr(10) ELSE '' END
    || CASE WHEN coalesce(url, '') <> '' THEN '  url = {{' || url || '}},' || chr(10) ELSE '' END || '}}'""".replace(
    "{{", "{"
).replace("}}", "}")


@query(
    "apa_citation",
    f"""WITH {PAPER_VIEW}, {AUTHOR_NAMES_SQL}
    SELECT doc_id, {APA_SQL} AS citation FROM paper_view LEFT JOIN author_names USING (doc_id)""",
)
def _apa_citation(spark, sf_dir):
    fields = [F.col(name) for name in _PAPER]
    return paper_view(spark, sf_dir).select("doc_id", citation.apa_citation(*fields).alias("citation"))


@query("bibtex_key", f"WITH {PAPER_VIEW} SELECT doc_id, {BIBTEX_KEY_SQL} AS bibtex_key FROM paper_view")
def _bibtex_key(spark, sf_dir):
    key = citation.bibtex_key(F.col("title"), F.col("authors"), F.col("published_date"))
    return paper_view(spark, sf_dir).select("doc_id", key.alias("bibtex_key"))


@query("bibtex_citation", f"WITH {PAPER_VIEW} SELECT doc_id, {BIBTEX_SQL} AS citation FROM paper_view")
def _bibtex_citation(spark, sf_dir):
    fields = [F.col(name) for name in _PAPER]
    return paper_view(spark, sf_dir).select("doc_id", citation.bibtex_citation(*fields).alias("citation"))


BYLINE_SQL = "array_to_string(authors[:4], ', ') || CASE WHEN len(authors) > 4 THEN ', et al.' ELSE '' END"
SOURCE_LABEL_SQL = """CASE source WHEN 'arxiv' THEN 'ArXiv' WHEN 'semantic_scholar' THEN 'Semantic Scholar'
    WHEN 'pubmed' THEN 'PubMed' WHEN 'openalex' THEN 'OpenAlex' ELSE source END"""


@query(
    "byline",
    f"WITH {PAPER_VIEW} SELECT doc_id, {BYLINE_SQL} AS byline, {SOURCE_LABEL_SQL} AS source_label FROM paper_view",
)
def _byline(spark, sf_dir):
    return paper_view(spark, sf_dir).select(
        "doc_id",
        citation.byline(F.col("authors")).alias("byline"),
        citation.source_label(F.col("source")).alias("source_label"),
    )


@query(
    "parse_id_list",
    f"""WITH pieces AS (
        SELECT doc_id, unnest(string_split(text, ',')) AS piece,
               unnest(generate_series(1, len(string_split(text, ',')))) AS n FROM documents),
    ids AS (SELECT doc_id, n, {sql_strip("piece")} AS id FROM pieces)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos, id FROM ids WHERE id <> ''""",
)
def _parse_id_list(spark, sf_dir):
    ids = documents(spark, sf_dir).select("doc_id", F.posexplode(id_list(F.col("text"))).alias("pos", "id"))
    return ids.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "cache_key",
    f"""WITH {PAPER_VIEW} SELECT doc_id, sha256({sql_strip("lower(title)")} || '|' ||
        CASE WHEN doc_id % 2 = 0 THEN 'arxiv,pubmed' ELSE source END || '|10|'
        || coalesce(CAST(year(published_date) AS VARCHAR), 'None') || '|None') AS cache_key
    FROM paper_view""",
)
def _cache_key(spark, sf_dir):
    sources = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("pubmed"), F.lit("arxiv"))).otherwise(F.array("source"))
    key = cache_key(F.col("title"), sources, F.lit(10), F.year("published_date"), F.lit(None))
    return paper_view(spark, sf_dir).select("doc_id", key.alias("cache_key"))


# --- landed payloads: built with to_json from the paper view, damaged in places, and mapped back -------------------

PER_RESPONSE = 20
_ROW = ("topic", "doc_id AS source_rank")


NULL_NAME = "@null@"


def _people(field: str = "name"):
    nameless = F.col("doc_id") % 17 == 1
    return F.transform("authors", lambda name: F.struct(F.when(nameless, F.lit(NULL_NAME)).otherwise(name).alias(field)))


def _year_or_zero():
    return F.coalesce(F.year("published_date"), F.lit(0))


def _damaged(good, typed_field: str = "title", cut: bool = True):
    """Truncated, null-author and wrong-type variants next to good payloads."""
    doc = F.col("doc_id")
    broken = F.when((doc % 17 == 0) & F.lit(cut), F.left(good, F.char_length(good) - 3))
    return (
        broken.when(doc % 17 == 1, F.replace(good, F.lit(f'"{NULL_NAME}"'), F.lit("null")))
        .when(doc % 17 == 2, F.replace(good, F.lit(f'"{typed_field}":"'), F.lit(f'"{typed_field}":7,"was":"')))
        .otherwise(good)
    )


def _reason_sql(cut: bool = True) -> str:
    truncated = "WHEN doc_id % 17 = 0 THEN 'malformed'" if cut else ""
    return f"""CASE {truncated} WHEN doc_id % 17 = 1 AND len(authors) > 0 THEN 'null author'
        WHEN doc_id % 17 = 2 THEN 'wrong type' END"""


def landed_arxiv(spark, sf_dir):
    item = F.struct(
        F.col("external_id").alias("id"),
        F.concat(F.lit("  "), "title", F.lit("\n")).alias("title"),
        _people().alias("authors"),
        F.col("abstract").alias("summary"),
        F.date_format("published_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"),
        "pdf_url",
        "doi",
        F.col("url").alias("entry_id"),
    )
    return paper_view(spark, sf_dir).withColumn("payload", _damaged(F.to_json(item))).selectExpr(*_ROW, "payload")


def landed_semantic_scholar(spark, sf_dir):
    item = F.struct(
        F.col("external_id").alias("paperId"),
        "title",
        _people().alias("authors"),
        "abstract",
        _year_or_zero().alias("year"),
        F.struct(F.col("doi").alias("DOI")).alias("externalIds"),
        F.struct(F.col("pdf_url").alias("url")).alias("openAccessPdf"),
        "url",
    )
    return paper_view(spark, sf_dir).withColumn("payload", _damaged(F.to_json(item))).selectExpr(*_ROW, "payload")


def landed_pubmed(spark, sf_dir):
    """Responses of up to PER_RESPONSE summaries, each also listing an id that has no summary."""

    def article_id(kind: str, value):
        return F.struct(F.lit(kind).alias("idtype"), value.alias("value"))

    item = F.struct(
        "title",
        _people().alias("authors"),
        F.when(F.col("doc_id") % 6 == 2, F.lit("Spring 2020"))
        .otherwise(F.concat(_year_or_zero().cast("string"), F.lit(" Jun 12")))
        .alias("pubdate"),
        F.array(article_id("pii", F.lit("x")), article_id("doi", F.col("doi"))).alias("articleids"),
    )
    items = paper_view(spark, sf_dir).select(
        F.floor(F.col("doc_id") / PER_RESPONSE).alias("response"),
        "doc_id",
        _damaged(F.to_json(item), cut=False).alias("item"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("doc_id", "item")))
    grouped = items.groupBy("response").agg(ordered.alias("items"))
    ids = F.transform("items", lambda one: F.concat(F.lit('"'), one["doc_id"].cast("string"), F.lit('"')))
    summaries = F.transform(
        "items", lambda one: F.concat(F.lit('"'), one["doc_id"].cast("string"), F.lit('":'), one["item"])
    )
    payload = F.concat(
        F.lit('{"idlist":['), F.array_join(ids, ","), F.lit(',"none"],"result":{"uids":[],'),
        F.array_join(summaries, ","), F.lit("}}"),
    )
    return grouped.select(
        F.lit("all").alias("topic"), F.col("response").alias("source_rank"), payload.alias("payload")
    )


def shown_rank(source: str):
    """The document an item stems from: PubMed ranks hold the response above the place in it."""
    rank = F.col("source_rank").cast("bigint")
    if source == "pubmed":
        rank = F.shiftright(rank, 32) * PER_RESPONSE + rank.bitwiseAND(0xFFFFFFFF)
    return rank.alias("source_rank")


def with_word_index(papers, text: str):
    """Adds ``word_index``, the inverted index of every row's text, null where it has no words or the row no ``doc_id``.

    Built within the row: sorted by word and position, every word is a run of its places.
    """
    words = F.filter(F.split(text, "[ \n]+"), lambda word: word != "")
    pairs = F.sort_array(F.transform(words, lambda word, nth: F.struct(word.alias("word"), nth.alias("position"))))
    placed = compute_once(papers, _placed=F.when(F.col("doc_id").isNotNull() & (F.size(words) > 0), pairs))
    last = F.size("_placed") - 1

    def begins(nth):
        return (nth == 0) | (F.get("_placed", nth)["word"] != F.get("_placed", nth - 1)["word"])

    runs = compute_once(placed, _starts=F.when(F.col("_placed").isNotNull(), F.filter(F.sequence(F.lit(0), last), begins)))

    def positions(start, nth):
        end = F.coalesce(F.get("_starts", nth + 1) - 1, last)
        return F.transform(F.sequence(start, end), lambda place: F.get("_placed", place)["position"])

    index = F.map_from_arrays(
        F.transform("_starts", lambda start: F.get("_placed", start)["word"]), F.transform("_starts", positions)
    )
    return compute_once(runs, word_index=index).drop("_placed", "_starts")


WORDS_SQL = "nullif(array_to_string(list_filter(regexp_split_to_array({}, '[ \n]+'), lambda x: x <> ''), ' '), '')"


def landed_openalex(spark, sf_dir):
    people = F.transform(_people("display_name"), lambda person: F.struct(person.alias("author")))
    item = F.struct(
        F.concat(F.lit("https://openalex.org/"), F.col("doc_id").cast("string")).alias("id"),
        F.col("title").alias("display_name"),
        people.alias("authorships"),
        F.col("word_index").alias("abstract_inverted_index"),
        _year_or_zero().alias("publication_year"),
        F.struct(F.col("pdf_url").alias("oa_url")).alias("open_access"),
        F.concat(F.lit("https://doi.org/"), "doi").alias("doi"),
    )
    papers = with_word_index(paper_view(spark, sf_dir), "abstract")
    return papers.withColumn("payload", _damaged(F.to_json(item), typed_field="id")).selectExpr(*_ROW, "payload")


LANDED = {
    "arxiv": landed_arxiv,
    "semantic_scholar": landed_semantic_scholar,
    "pubmed": landed_pubmed,
    "openalex": landed_openalex,
}


@query("inverted_abstract", f"SELECT doc_id, {WORDS_SQL.format('text')} AS abstract FROM documents")
def _inverted_abstract(spark, sf_dir):
    indexed = with_word_index(documents(spark, sf_dir).select("doc_id", "text"), "text")
    return payloads.with_inverted_abstract(indexed, F.col("word_index")).select("doc_id", "abstract")


def _source_query(source: str, columns: dict[str, str], cut: bool = True):
    names = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    oracle = f"""WITH {PAPER_VIEW} SELECT doc_id AS source_rank, {names} FROM paper_view
        WHERE ({_reason_sql(cut)}) IS NULL"""

    @query(f"src_{source}", oracle)
    def build(spark, sf_dir):
        papers = payloads.accepted(payloads.MAPPERS[source](LANDED[source](spark, sf_dir)))
        return papers.select(
            shown_rank(source),
            "external_id",
            "source",
            "title",
            joined("authors").alias("authors"),
            "abstract",
            day("published_date").alias("published"),
            "pdf_url",
            "doi",
            "url",
        )


_UNTITLED = "CASE WHEN title = '' THEN 'Untitled' ELSE title END"
_AUTHORS = "array_to_string(authors, '|')"
_NEW_YEAR = "strftime(date_trunc('year', published_date), '%Y-%m-%d')"

_source_query(
    "arxiv",
    {
        "external_id": "external_id",
        "source": "'arxiv'",
        "title": f"replace({sql_strip('title')}, chr(10), ' ')",
        "authors": _AUTHORS,
        "abstract": f"CASE WHEN abstract <> '' THEN replace({sql_strip('abstract')}, chr(10), ' ') END",
        "published": "strftime(published_date, '%Y-%m-%d')",
        "pdf_url": "pdf_url",
        "doi": "doi",
        "url": "url",
    },
)
_source_query(
    "semantic_scholar",
    {
        "external_id": "external_id",
        "source": "'semantic_scholar'",
        "title": _UNTITLED,
        "authors": _AUTHORS,
        "abstract": "abstract",
        "published": _NEW_YEAR,
        "pdf_url": "pdf_url",
        "doi": "doi",
        "url": "url",
    },
)
_source_query(
    "pubmed",
    {
        "external_id": "CAST(doc_id AS VARCHAR)",
        "source": "'pubmed'",
        "title": _UNTITLED,
        "authors": _AUTHORS,
        "abstract": "CAST(NULL AS VARCHAR)",
        "published": f"CASE WHEN doc_id % 6 <> 2 THEN {_NEW_YEAR} END",
        "pdf_url": "CAST(NULL AS VARCHAR)",
        "doi": "doi",
        "url": "'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/'",
    },
    cut=False,
)
_source_query(
    "openalex",
    {
        "external_id": "CAST(doc_id AS VARCHAR)",
        "source": "'openalex'",
        "title": _UNTITLED,
        "authors": _AUTHORS,
        "abstract": WORDS_SQL.format("abstract"),
        "published": _NEW_YEAR,
        "pdf_url": "pdf_url",
        "doi": "doi",
        "url": "'https://openalex.org/' || doc_id",
    },
)


def rejects_sql() -> str:
    parts = [
        f"SELECT '{source}' AS source, doc_id AS source_rank, {_reason_sql(source != 'pubmed')} AS reject_reason FROM paper_view"
        for source in SOURCES
    ]
    return " UNION ALL ".join(parts)


def payload_rejects(spark, sf_dir):
    return merge_sources(
        [payloads.rejected(payloads.MAPPERS[source](LANDED[source](spark, sf_dir))) for source in SOURCES]
    )


@query(
    "payload_rejects",
    f"WITH {PAPER_VIEW}, judged AS ({rejects_sql()}) SELECT * FROM judged WHERE reject_reason IS NOT NULL",
)
def _payload_rejects(spark, sf_dir):
    document = F.when(F.col("source") == "pubmed", shown_rank("pubmed")).otherwise(shown_rank("arxiv"))
    return payload_rejects(spark, sf_dir).select("source", document.alias("source_rank"), "reject_reason")


# --- searches over landed payloads, with and without the cache ------------------------------------------------------

SEARCH_CAP = 50


def landed_hits(spark, sf_dir):
    return landed_papers({source: build(spark, sf_dir) for source, build in LANDED.items()})


def _hits_sql(name: str) -> str:
    """Usable items of all sources, cut per topic and source."""
    title = f"replace({sql_strip('title')}, chr(10), ' ')"
    untitled = "CASE WHEN title = '' THEN 'Untitled' ELSE title END"
    year = "date_trunc('year', published_date)"
    shapes = {
        "arxiv": ("topic", "external_id", title, "published_date"),
        "semantic_scholar": ("topic", "external_id", untitled, year),
        "pubmed": ("'all'", "CAST(doc_id AS VARCHAR)", untitled, f"CASE WHEN doc_id % 6 <> 2 THEN {year} END"),
        "openalex": ("topic", "CAST(doc_id AS VARCHAR)", untitled, year),
    }
    parts = [
        f"""SELECT {topic} AS topic, '{source}' AS source, {place} AS source_pos, doc_id AS source_rank,
            {place} * 1000000000000 + doc_id AS doc_id, {key} AS external_id, {shown} AS title,
            CAST({published} AS DATE) AS published_date, doi
        FROM paper_view WHERE ({_reason_sql(source != "pubmed")}) IS NULL"""
        for place, (source, (topic, key, shown, published)) in enumerate(shapes.items())
    ]
    return f"""landed AS ({" UNION ALL ".join(parts)}),
    {name} AS (
        SELECT * EXCLUDE (nth) FROM (
            SELECT *, row_number() OVER (PARTITION BY topic, source ORDER BY source_rank) AS nth FROM landed)
        WHERE nth <= {SEARCH_CAP})"""


_FOUND_SQL = f"""{PAPER_VIEW}, {_hits_sql("hits")}, {first_wins_sql("topic", "hits")},
found AS (
    SELECT h.topic, h.source, h.external_id, h.title, strftime(h.published_date, '%Y-%m-%d') AS published
    FROM walk JOIN hits h ON h.doc_id = walk.doc_id WHERE kept AND year(h.published_date) BETWEEN 1995 AND 2020)"""
_SEARCH = {"max_results": SEARCH_CAP, "year_from": 1995, "year_to": 2020}


@query("search_landed", f"WITH RECURSIVE {_FOUND_SQL} SELECT * FROM found")
def _search_landed(spark, sf_dir):
    found = run_search(landed_hits(spark, sf_dir), **_SEARCH)
    return found.select("topic", "source", "external_id", "title", day("published_date").alias("published"))


@query(
    "search_cached",
    f"""WITH RECURSIVE {_FOUND_SQL}, asked AS (
        SELECT topic, unnest([0, 1800, 3599, 3600, 9000]) AS after FROM (SELECT DISTINCT topic FROM paper_view)),
    judged AS (
        SELECT topic, after, after < 2700 AND ascii(topic) % 2 = 0 AS stored FROM asked)
    SELECT j.topic, after, 'stored' AS origin, p.source, p.external_id, p.title
    FROM judged j JOIN paper_view p ON p.topic = j.topic JOIN labels l ON l.doc_id = p.doc_id WHERE stored
    UNION ALL
    SELECT j.topic, after, 'searched', f.source, f.external_id, f.title
    FROM judged j JOIN found f ON f.topic = j.topic WHERE NOT stored""",
)
def _search_cached(spark, sf_dir):
    """Every topic is asked five times; half of them have the labelled papers stored from a quarter of an hour before."""
    start = F.timestamp_seconds(F.lit(1_700_000_000))
    papers = paper_view(spark, sf_dir)
    topics = papers.select("topic").distinct().where("topic is not null")
    after = F.explode(F.array(*[F.lit(seconds) for seconds in (0, 1_800, 3_599, 3_600, 9_000)])).alias("after")
    asked = topics.select("topic", after).withColumn("asked_at", F.timestamp_seconds(F.col("after") + 1_700_000_000))
    even = topics.where(F.ascii("topic") % 2 == 0)
    keys = with_cache_key(even, **_SEARCH).withColumn("created_at", start - F.expr("interval 15 minutes"))
    labelled = papers.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    stored = labelled.join(keys, "topic").select("cache_key", "created_at", "topic", "source", "external_id", F.concat(F.lit("stored "), "title").alias("title"))
    answers = search_with_cache(asked, landed_hits(spark, sf_dir), keys.drop("topic"), stored, **_SEARCH)
    old = F.startswith("title", F.lit("stored "))
    return answers.results.select(
        "topic",
        F.col("after").cast("bigint").alias("after"),
        F.when(old, F.lit("stored")).otherwise(F.lit("searched")).alias("origin"),
        "source",
        "external_id",
        F.when(old, F.substr("title", F.lit(8))).otherwise(F.col("title")).alias("title"),
    )
