import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from paperloom.functions.text import id_list, paper_id, strip, title_key, words
from paperloom.operators import dedupe
from paperloom.operators.dedupe import dedupe_papers, first_wins
from paperloom.operators.search import (
    check_cap,
    check_topic,
    check_years,
    per_source_cap,
    recency_sort,
    restrict_sources,
    select_top_n,
    year_filter,
)
from paperloom.plans.search import search_papers, search_with_cache, with_cache_key

SCHEMA = """topic string, source string, source_pos int, source_rank bigint, external_id string, title string,
    doi string, published_date date, pdf_url string"""


def papers(spark, rows):
    """Rows of (external_id, source, rank, title, doi, date, pdf)."""
    order = ["arxiv", "semantic_scholar", "pubmed", "openalex"]
    full = [
        ("t", source, order.index(source), rank, key, title, doi, day, pdf)
        for key, source, rank, title, doi, day, pdf in rows
    ]
    return spark.createDataFrame(full, SCHEMA)


def ids(frame):
    return [row.external_id for row in frame.select("external_id").collect()]


def simple(spark, titles_and_dois):
    return papers(
        spark, [(str(n), "arxiv", n, title, doi, None, None) for n, (title, doi) in enumerate(titles_and_dois)]
    )


def kept(spark, titles_and_dois):
    return sorted(ids(dedupe_papers(simple(spark, titles_and_dois))))


def test_same_doi_keeps_the_first(spark):
    assert kept(spark, [("One", "10.77/rain-b"), ("Two", "\t10.77/RAIN-B ")]) == ["0"]


def test_same_title_keeps_the_first(spark):
    assert kept(spark, [("Rain, Twice: A Study", None), ("rain twice -- a STUDY?", None)]) == ["0"]


def test_distinct_papers_stay(spark):
    assert kept(spark, [("One", "a"), ("Two", "b")]) == ["0", "1"]


def test_a_dropped_paper_links_nothing(spark):
    assert kept(spark, [("T1", "d1"), ("T1", "d2"), ("T2", "d2")]) == ["0", "2"]


def test_titles_without_letters_never_match(spark):
    assert kept(spark, [("論文", None), ("論文", None), ("!!", "")]) == ["0", "1", "2"]


def check_first_wins(rows, found):
    """No two kept rows share a key, and every dropped one shares a key with an earlier kept one: only one set does both."""
    first = {}
    for scope, order, doi, title in rows:
        for key in {(scope, "d", doi), (scope, "t", title)}:
            if key[2] is not None and (scope, order) in found:
                assert key not in first
                first[key] = order
    for scope, order, doi, title in rows:
        if (scope, order) not in found:
            assert min(first.get((scope, "d", doi), order), first.get((scope, "t", title), order)) < order


@pytest.mark.parametrize("seed", range(3))
def test_first_wins(spark, seed):
    """Many small random scopes plus one large scope in which one DOI holds a third of the rows."""
    draw = random.Random(seed)
    rows = []
    for scope in range(150):
        for order in range(draw.randint(1, 12)):
            rows.append((str(scope), order, draw.choice([None, "a", "b", "c", "d"]), draw.choice([None, "u", "v", "w", "x"])))
    for order in range(3000):
        doi = "hot" if draw.random() < 0.34 else draw.choice([None, str(draw.randint(0, 900))])
        rows.append(("big", order, doi, draw.choice([None, str(draw.randint(0, 900))])))
    draw.shuffle(rows)
    keyed = spark.createDataFrame(rows, "scope string, ord bigint, doi_key string, title_key string")
    check_first_wins(rows, {(row.scope, row.ord) for row in first_wins(keyed).collect()})


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """Neighbours share a key, so plain rounds alone would settle two rows of a chain at a time."""
    rows = [("", n, f"d{n // 2}", f"t{(n + 1) // 2}") for n in range(3_000)]
    rows += [("x", n, f"d{n // 3}", f"t{(n + 1) // 2}") for n in range(300)]
    calls = []
    plain = dedupe._round_winners
    monkeypatch.setattr(dedupe, "_round_winners", lambda undecided: calls.append(1) or plain(undecided))
    keyed = spark.createDataFrame(rows, "scope string, ord bigint, doi_key string, title_key string")
    found = {(row.scope, row.ord) for row in first_wins(keyed).collect()}
    check_first_wins(rows, found)
    assert {n for scope, n in found if not scope} == set(range(0, 3_000, 2)) and len(calls) < 60


def test_papers_of_one_position(spark):
    """Ties go by external id; equal rows with a key are one paper."""
    rows = [("b", "arxiv", 0, "One", "10.1/x", None, None), ("a", "arxiv", 0, "Two", "10.1/x", None, None), ("c", "arxiv", 0, "Three", None, None, None)]
    rows += [rows[2], ("d", "arxiv", 0, "!!", None, None, None), ("d", "arxiv", 0, "!!", None, None, None)]
    assert sorted(ids(dedupe_papers(papers(spark, rows)))) == ["a", "c", "d", "d"]


def test_dedupe_runs_before_the_year_filter(spark):
    rows = [
        ("undated", "arxiv", 0, "Same", None, None, None),
        ("dated", "openalex", 0, "Same", None, date(2021, 1, 1), None),
    ]
    assert ids(search_papers(papers(spark, rows), year_from=2020)) == []


def test_search_orders_newest_first(spark):
    rows = [
        ("old", "arxiv", 0, "Old", None, date(2015, 1, 1), None),
        ("none", "arxiv", 1, "None", None, None, None),
        ("new", "semantic_scholar", 0, "New", None, date(2023, 1, 1), None),
    ]
    assert ids(search_papers(papers(spark, rows))) == ["new", "old", "none"]


def test_year_filter(spark):
    rows = [
        ("a", "arxiv", 0, "A", None, date(2010, 1, 1), None),
        ("b", "arxiv", 1, "B", None, date(2023, 1, 1), None),
        ("c", "arxiv", 2, "C", None, None, None),
    ]
    frame = papers(spark, rows)
    assert ids(year_filter(frame, year_from=2020)) == ["b"]
    assert ids(year_filter(frame, year_to=2010)) == ["a"]
    assert sorted(ids(year_filter(frame))) == ["a", "b", "c"]


def test_ties_keep_merge_order(spark):
    day = date(2020, 1, 1)
    rows = [(key, source, 0, key, None, day, None) for key, source in (("x", "openalex"), ("y", "arxiv"), ("z", "pubmed"))]
    assert ids(recency_sort(papers(spark, rows))) == ["y", "z", "x"]


def test_cap_and_sources(spark):
    rows = [(f"{source}{n}", source, n, f"{source}{n}", None, None, None) for source in ("arxiv", "pubmed") for n in range(12)]
    frame = papers(spark, rows)
    assert per_source_cap(frame).count() == 20
    assert per_source_cap(frame, 3).count() == 6
    asked = restrict_sources(frame, ["pubmed", "arxiv"])
    assert {(row.source, row.source_pos) for row in asked.collect()} == {("pubmed", 0), ("arxiv", 1)}
    assert restrict_sources(frame, []).count() == 24


def test_selection_prefers_papers_with_pdf(spark):
    rows = [
        ("without", "arxiv", 0, "A", None, date(2023, 1, 1), ""),
        ("with", "arxiv", 1, "B", None, date(2010, 1, 1), "https://x"),
    ]
    assert ids(select_top_n(papers(spark, rows), 1)) == ["with"]


def test_parameter_bounds():
    assert check_cap(None) == check_cap(0) == 10
    for wrong in (lambda: check_cap(51), lambda: check_topic("a"), lambda: check_years(1800, None)):
        with pytest.raises(ValueError):
            wrong()


def test_text_helpers(spark):
    blanks = " \x1c a \x85b　"
    frame = spark.createDataFrame([(blanks,)], "text string")
    row = frame.select(strip(F.col("text")).alias("s"), words(F.col("text")).alias("w")).first()
    assert row.s == blanks.strip() and row.w == blanks.split()
    row = frame.select(
        paper_id(F.lit("arxiv"), F.lit("cs/0112/7")).alias("id"),
        title_key(F.lit("A-b C!")).alias("key"),
        id_list(F.lit(" a, ,b,a ,")).alias("ids"),
    ).first()
    assert (row.id, row.key, row.ids) == ("arxiv_cs_0112_7", "abc", ["a", "b", "a"])


def test_ranks_are_cut_before_the_shuffle(spark):
    frame = per_source_cap(papers(spark, [("a", "arxiv", 0, "A", None, None, None)]))
    assert "WindowGroupLimit" in frame._jdf.queryExecution().executedPlan().toString()


def test_a_search_is_stored_and_answers_until_its_time_is_over(spark):
    hits = simple(spark, [("One", "a"), ("Two", "b"), ("One", "c")]).where("topic = 't'")
    asked = spark.sql(
        """select topic, timestamp_seconds(at) asked_at, id from values ('t', 0, 0), (' T ', 50, 1), ('t', 100, 2), ('none', 10, 3)
        as asked(topic, at, id)"""
    )
    columns = "cache_key string, created_at timestamp, external_id string"
    nothing = spark.createDataFrame([], columns)
    first = search_with_cache(asked.where("id in (0, 3)"), hits, nothing.select("cache_key", "created_at"), nothing, 100)
    assert sorted(row.external_id for row in first.results.collect()) == ["0", "1"]
    assert first.entries.count() == 2 and first.stored.count() == 2
    # Stored under another title: the second run must not search again before the time is over.
    stored = first.stored.withColumn("title", F.lit("stored"))
    later = search_with_cache(asked.where("id > 0"), hits, first.entries, stored, 100)
    titles = {(row.id, row.title) for row in later.results.collect()}
    assert titles == {(1, "stored"), (2, "One"), (2, "Two")}
    assert [row.created_at.timestamp() for row in later.entries.collect()] == [100.0]
    assert with_cache_key(asked, year_from=2000).select("cache_key").distinct().count() == 2


def test_cached_search_without_requests(spark):
    hits = simple(spark, [("One", "a")])
    asked = spark.createDataFrame([], "topic string, asked_at timestamp")
    nothing = spark.createDataFrame([], "cache_key string, created_at timestamp, external_id string")
    answers = search_with_cache(asked, hits, nothing.select("cache_key", "created_at"), nothing)
    assert answers.results.count() == answers.entries.count() == 0
