import json
from datetime import date

from pyspark.sql import functions as F

from paperloom.sources.payloads import (
    accepted,
    arxiv_papers,
    openalex_papers,
    pubmed_date,
    pubmed_papers,
    read_landed,
    rejected,
    semantic_scholar_papers,
    with_inverted_abstract,
)


def landed(spark, *payloads):
    rows = [("t", n, payload if isinstance(payload, (str, type(None))) else json.dumps(payload)) for n, payload in enumerate(payloads)]
    return spark.createDataFrame(rows, "topic string, source_rank bigint, payload string")


def split(mapped):
    good = {row.source_rank: row for row in accepted(mapped).collect()}
    bad = {row.source_rank: row.reject_reason for row in rejected(mapped).collect()}
    return good, bad


def test_arxiv(spark):
    item = {
        "id": "2301.00017v1", "title": " Tides\nand Moons ", "authors": [{"name": "A B"}], "summary": "One\ntwo\n",
        "published": "2023-01-02T03:04:05Z", "pdf_url": "p", "doi": None, "entry_id": "e",
    }
    good, bad = split(arxiv_papers(landed(spark, item, json.dumps(item)[:-4], {**item, "authors": [{"name": None}]}, None)))
    assert good[0].title == "Tides and Moons" and good[0].abstract == "One two"
    assert good[0].published_date == date(2023, 1, 2) and good[0].authors == ["A B"] and good[0].source_pos == 0
    assert bad == {1: "malformed", 2: "null author", 3: "malformed"}


def test_semantic_scholar(spark):
    item = {"paperId": "x", "title": "", "authors": [{}, {"name": "N"}], "year": 2020, "externalIds": {"DOI": "d"}, "openAccessPdf": None}
    without_id = {key: value for key, value in item.items() if key != "paperId"}
    good, bad = split(
        semantic_scholar_papers(
            landed(
                spark, item, without_id, {**item, "paperId": None}, {**item, "year": 0}, {**item, "year": None},
                {**item, "year": 99999}, {**item, "authors": [{"name": None}]}, {**item, "title": 5}, {**item, "year": "x"}, {**item, "externalIds": {"DOI": 7}}, {**item, "openAccessPdf": {"url": True}},
            )
        )
    )
    assert good[0].title == "Untitled" and good[0].authors == ["", "N"]
    assert (good[0].doi, good[0].pdf_url, good[0].published_date) == ("d", None, date(2020, 1, 1))
    assert good[1].external_id == ""
    assert good[3].published_date is None and good[4].published_date is None
    assert bad == {2: "no id", 5: "bad year", 6: "null author", 7: "wrong type", 8: "malformed", 9: "wrong type", 10: "wrong type"}


def test_pubmed(spark):
    summary = {"title": "T", "authors": [{"name": "N"}], "pubdate": "2023 Jun 12", "articleids": [{"idtype": "pii", "value": "p"}, {"idtype": "doi", "value": "d"}]}
    response = {"idlist": ["3", "9", "1"], "result": {"uids": ["1", "3"], "1": {**summary, "authors": [{"name": None}]}, "3": summary}}
    good, bad = split(pubmed_papers(landed(spark, response)))
    assert [row.external_id for row in good.values()] == ["3"]
    assert (good[0].doi, good[0].url) == ("d", "https://pubmed.ncbi.nlm.nih.gov/3/")
    assert bad == {2: "null author"}
    assert split(pubmed_papers(landed(spark, '{"idlist": ["1"')))[1] == {0: "malformed"}


def test_pubmed_responses_keep_their_order(spark):
    """Neighbouring responses never share a position, however long the first one's list is."""
    responses = [
        {"idlist": [f"{n}{letter}" for letter in "cab"], "result": {f"{n}{letter}": {"title": "T"} for letter in "cab"}} for n in range(3)
    ]
    found = accepted(pubmed_papers(landed(spark, *responses))).orderBy("source_rank").collect()
    assert [row.external_id for row in found] == [f"{n}{letter}" for n in range(3) for letter in "cab"]
    assert len({row.source_rank for row in found}) == 9


def test_pubmed_dates(spark):
    texts = ["2023 Jun", "2023", "2023 Jun 12", "Spring 2020", "", None, "0", "99999"]
    frame = spark.createDataFrame([(text,) for text in texts], "text string")
    found = [row.day for row in frame.select(pubmed_date(F.col("text")).alias("day")).collect()]
    assert found == [date(2023, 1, 1)] * 3 + [None] * 5


def test_openalex(spark):
    item = {
        "id": "https://openalex.org/W1", "title": None, "display_name": "D", "publication_year": 2021,
        "authorships": [{"author": {"display_name": "A"}}, {"author": {}}, {"author": None}, {"author": {"id": "i"}}],
        "abstract_inverted_index": {"rain": [1, 4], "after": [2], "more": [0, 3]},
        "open_access": {"oa_url": "u"}, "doi": "https://doi.org/10.1/x",
    }
    good, bad = split(openalex_papers(landed(spark, item, {**item, "doi": ""}, {**item, "publication_year": 10000}, {**item, "open_access": {"oa_url": 3}})))
    assert (good[0].external_id, good[0].title, good[0].doi, good[0].pdf_url) == ("W1", "D", "10.1/x", "u")
    assert good[0].authors == ["A", ""] and good[0].abstract == "more rain after more rain"
    assert good[1].doi is None and bad == {2: "bad year", 3: "wrong type"}


def test_inverted_abstract(spark):
    indexes = [None, "{}", '{"a":[0,7],"b":[3]}', '{"early":[1],"x":[0],"late":[1]}']
    frame = spark.createDataFrame(list(enumerate(indexes)), "n int, json string").select(
        "n", F.from_json("json", "map<string,array<int>>").alias("word_index")
    )
    found = with_inverted_abstract(frame, F.col("word_index")).orderBy("n").collect()
    assert [row.abstract for row in found] == [None, None, "a b a", "x late"]


def test_landed_files(spark, tmp_path):
    (tmp_path / "part.json").write_text('{"topic":"t","source_rank":1,"payload":"{}"}\n')
    assert read_landed(spark, str(tmp_path)).first().source_rank == 1


def test_each_payload_is_parsed_once(spark):
    plan = accepted(arxiv_papers(landed(spark, {}))).select("title")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1
