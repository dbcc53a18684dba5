from datetime import date

import pytest
from pyspark.sql import functions as F

from paperloom.functions.citation import apa_citation, bibtex_citation, bibtex_key, byline, first_author_last_name, source_label

SCHEMA = "title string, authors array<string>, published date, doi string, url string"
RECORD = ("Tides and Moons", ["Mara Quist", "Ole B. Tarn"], date(2019, 3, 4), "10.77/tides.9", None)


def show(spark, paper, build, *names):
    frame = spark.createDataFrame([paper], SCHEMA)
    return frame.select(build(*[F.col(name) for name in names]).alias("shown")).first().shown


def apa(spark, paper):
    return show(spark, paper, apa_citation, "title", "authors", "published", "doi", "url")


def test_apa(spark):
    assert apa(spark, RECORD) == (
        "Quist, M., & Tarn, O. B. (2019). Tides and Moons. https://doi.org/10.77/tides.9"
    )
    assert apa(spark, ("Title...", [], None, "", "https://y")) == "Unknown Author (n.d.). Title. https://y"
    assert apa(spark, ("T", ["Plato "], None, None, "")) == "Plato  (n.d.). T."
    assert apa(spark, ("T", ["Ann B. Cee"], None, None, None)) == "Cee, A. B. (n.d.). T."


@pytest.mark.parametrize("count", [2, 3, 19, 20, 21, 30])
def test_apa_author_lists(spark, count):
    names = [f"First Last{n}" for n in range(count)]
    shown = [f"Last{n}, F." for n in range(count)]
    if count <= 20:
        wanted = ", ".join(shown[:-1]) + ", & " + shown[-1]
    else:
        wanted = ", ".join(shown[:19]) + ", ... " + shown[-1]
    assert apa(spark, ("T", names, None, None, None)) == f"{wanted} (n.d.). T."


def test_bibtex(spark):
    assert show(spark, RECORD, bibtex_key, "title", "authors", "published") == "quist2019tides"
    assert show(spark, (RECORD[0], [], *RECORD[2:]), bibtex_key, "title", "authors", "published") == "unknown2019tides"
    assert show(spark, (" ", ["  "], None, None, None), bibtex_key, "title", "authors", "published") == "unknownndpaper"
    assert show(spark, ("Über x", ["Ann Müller"], None, None, None), bibtex_key, "title", "authors", "published") == "mllerndber"
    text = show(spark, RECORD, bibtex_citation, "title", "authors", "published", "doi", "url")
    assert text.splitlines() == [
        "@article{quist2019tides,",
        "  title = {Tides and Moons},",
        "  author = {Mara Quist and Ole B. Tarn},",
        "  year = {2019},",
        "  doi = {10.77/tides.9},",
        "}",
    ]


def test_display(spark):
    assert show(spark, ("T", list("abcde"), None, None, None), byline, "authors") == "a, b, c, d, et al."
    assert show(spark, ("T", list("abcd"), None, None, None), byline, "authors") == "a, b, c, d"
    assert show(spark, ("T", [" "], None, None, None), first_author_last_name, "authors") == "Unknown"
    assert show(spark, ("pubmed", [], None, None, None), source_label, "title") == "PubMed"
    assert show(spark, ("other", [], None, None, None), source_label, "title") == "other"
