import hashlib
import re
import time

from pyspark.sql import functions as F

from paperloom.llm.queries import QUERIES
from paperloom.llm.warc import derivatives, plain_text, responses, write_warc
from paperloom.session import fresh_path

SF = "/root/testdata/sf0.001"


def test_records_parse_and_link(spark):
    rows = QUERIES["op10_warc_derivatives"](spark, SF).collect()
    pages = {row.page_id: row for row in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == 2 * len(pages) and len({row.record_id for row in rows}) == len(rows)
    pairs = {}
    for row in rows:
        head, block = row.record.split("\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        page = pages[row.page_id]
        assert head.startswith("WARC/1.1\r\n") and fields["WARC-Type"] == row.warc_type
        assert fields["WARC-Refers-To"] == f"<{row.refers_to}>" and fields["WARC-Target-URI"] == page.url
        assert int(fields["Content-Length"]) == row.content_length == len(block.encode())
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block.encode()).hexdigest()
        assert row.source_digest == "sha256:" + hashlib.sha256(page.html.encode()).hexdigest()
        pairs.setdefault(row.refers_to, {})[row.warc_type] = (row, block)
    for pair in pairs.values():
        fields = dict(line.split(": ", 1) for line in pair["metadata"][1].strip().split("\r\n"))
        assert fields["conversion-record-id"] == f"<{pair['conversion'][0].record_id}>"
        assert "Content-Type: text/html" in fields["source-http-headers"]
        assert "<p" not in pair["conversion"][1] and "track(" not in pair["conversion"][1]


def test_files_hold_the_records(spark):
    path = fresh_path(spark, "warc")
    records = derivatives(responses(spark.read.parquet(f"{SF}/pages.parquet")))
    write_warc(records, path)
    whole = b"".join(row.content for row in spark.read.format("binaryFile").load(f"{path}/*.txt").collect())
    found, at = [], 0
    while at < len(whole):
        head = whole.index(b"\r\n\r\n", at) + 4
        end = head + int(re.search(rb"Content-Length: (\d+)", whole[at:head])[1])
        found.append(whole[at:end].decode())
        assert whole[end : end + 4] == b"\r\n\r\n"
        at = end + 4
    assert sorted(found) == sorted(row.record for row in records.collect())


def test_text_of_markup(spark):
    html = "<head><title>T</title></head><!-- <p>x --><SCRIPT>a<b</SCRIPT><p>One&nbsp; &amp;lt; <b>t</b>wo<br/>3 &lt; 4</p>\n\n<div>é</div>"
    assert spark.range(1).select(plain_text(F.lit(html))).first()[0] == "One &lt; two\n3 < 4\né"


def test_marks_left_open(spark):
    """Each of them as often as in a very long damaged page; what follows the last one is markup, not text."""
    marks = ["<script>", "<style>", "<noscript>", "<head>", "<!--", "<title>", "<title ", "<html ", "<p ", "<a ", "<", "<head ", "<script"]
    pages = spark.createDataFrame([(n, "u", "<p>kept</p>" + mark * 40_000) for n, mark in enumerate(marks)], "page_id long, url string, html string")
    started = time.time()
    rows = derivatives(responses(pages)).where("warc_type = 'conversion'").collect()
    assert time.time() - started < 60 and len(rows) == len(marks)
    assert all(row.record.split("\r\n\r\n", 1)[1].startswith("kept") for row in rows)


def test_head_left_open_ends_at_the_first_block(spark):
    html = "<head><title>T</title><script>x('<div>')</script><body class=a><p>one</p> 3 < 4 and 5 > 4"
    assert spark.range(1).select(plain_text(F.lit(html))).first()[0] == "one\n3 < 4 and 5 > 4"


def test_values_write_no_headers(spark):
    url = "http://x/\r\nWARC-Type: response\r\n\r\nbody"
    pages = spark.createDataFrame([(1, url, "<title>a\r\nb\x00c</title>")], "page_id long, url string, html string")
    for row in derivatives(responses(pages)).collect():
        head, block = row.record.split("\r\n\r\n", 1)
        assert [line.split(": ")[0] for line in head.split("\r\n")].count("WARC-Type") == 1
        assert row.target_uri == url and "WARC-Target-URI: http://x/  WARC-Type: response    body" in head
        assert row.warc_type == "conversion" or "title: a b c\r\n" in block


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "y"), (2, "u", "", "y"), (None, "u", "<p>" * 30_000, "z")], "page_id long, url string, html string, record_id string")
    rows = derivatives(responses(pages)).collect()
    assert len(rows) == 8 and all("None" not in row.record for row in rows)
    assert not any("Target-URI" in row.record for row in rows if row.page_id == 1)
    assert derivatives(responses(pages.limit(0))).count() == 0
