from paperloom.operators.records import read_records, store_records
from paperloom.session import fresh_path
from paperloom.sources.payloads import accepted, arxiv_feed_papers

FEED = """<entry xmlns="http://www.w3.org/2005/Atom"><id>http://arxiv.org/abs/hep-th/9901001v2</id>
<published>1999-01-04T23:59:59Z</published><title> Strings &amp;
 branes </title><summary/><author><name>Ada B</name><arxiv:affiliation xmlns:arxiv="http://arxiv.org/schemas/atom">X</arxiv:affiliation></author>
<author><name>C</name></author><arxiv:doi xmlns:arxiv="http://arxiv.org/schemas/atom">10.1/x</arxiv:doi>
<link href="http://arxiv.org/abs/hep-th/9901001v2" rel="alternate"/><link title="pdf" href="http://arxiv.org/pdf/9" rel="related"/></entry>"""


def feed(spark, *payloads):
    landed = spark.createDataFrame([("t", n, text) for n, text in enumerate(payloads)], "topic string, source_rank long, payload string")
    return arxiv_feed_papers(landed)


def test_entry(spark):
    row = feed(spark, FEED).first()
    assert row.reject_reason is None and row.external_id == "hep-th/9901001v2" and row.title == "Strings &  branes"
    assert row.authors == ["Ada B", "C"] and row.abstract is None and str(row.published_date) == "1999-01-04"
    assert (row.doi, row.pdf_url, row.url) == ("10.1/x", "http://arxiv.org/pdf/9", "http://arxiv.org/abs/hep-th/9901001v2")


def test_bad_entries_cost_only_themselves(spark):
    rows = feed(spark, FEED[:-9], None, FEED, "<entry><title>x</title></entry>", "<entry><id>1</id></entry>", "")
    reasons = {row.source_rank: row.reject_reason for row in rows.collect()}
    assert reasons[0] == reasons[1] == "malformed" and reasons[2] is None
    assert reasons[3] == "no id" and reasons[4] == "no title" and reasons[5] is not None
    assert accepted(rows).count() == 1


def test_records(spark):
    path = fresh_path(spark, "records")
    bodies = ['{"a": {"b": [1, "x"]}}', '{"a": 1, "a": 2}', "{", None, "null", '{"a": null}', '{"a": {"b": ["y", 2]}}']
    store_records(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"), path)
    stored = spark.read.parquet(path)
    assert stored.schema["record"].dataType.simpleString() == "variant"
    rows = read_records(stored, first=("$.a.b[0]", "int"), second=("$.a.b[1]", "string")).orderBy("id").collect()
    assert [row.readable for row in rows] == [True, False, False, False, True, True, True]
    assert [(row.first, row.second) for row in rows] == [(1, "x")] + [(None, None)] * 5 + [(None, "2")]
