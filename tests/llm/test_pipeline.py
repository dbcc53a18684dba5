import re

import pytest

import corpus_pipeline
from paperloom.llm.queries import ORACLES, QUERIES
from paperloom.session import cut_lineage
from test_decontamination import distance, normalised
from test_jaccard import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = [(10_001, "123 456 !!!", "en", "junk", 11), (10_002, None, None, None, None), (10_003, "", "fr", "junk", 0)]
    docs = cut_lineage(docs.union(spark.createDataFrame(junk, docs.schema)))
    out = []
    for name, stage in corpus_pipeline.STAGES:
        kept = cut_lineage(stage(spark, docs, SF))
        out.append((name, docs, kept))
        docs = kept
    return out


def test_all_but_the_last_return_documents(stages):
    assert [kept.columns for _, _, kept in stages[:-1]] == [COLUMNS] * 4


def test_language_keeps_what_has_letters(stages):
    _, before, after = stages[0]
    assert {row.doc_id for row in after.collect()} == {r.doc_id for r in before.collect() if re.search(r"[^\W\d_]", r.text or "")}


def test_one_document_of_each_group_stays(stages):
    _, before, after = stages[1]
    rows = [(row.doc_id, row.text) for row in before.collect()]
    assert sorted(row.doc_id for row in after.collect()) == sorted(set(brute(rows, 5, 80).values()))
    assert after.count() < before.count()


def test_repeated_windows_are_gone(stages):
    _, before, after = stages[2]
    was = {row.doc_id: row.text for row in before.collect()}
    now = {row.doc_id: row.text for row in after.collect()}
    assert was.keys() == now.keys()
    times = {}
    for text in was.values():
        words = text.split()
        for n in range(len(words) - 34):
            window = tuple(words[n : n + 35])
            times[window] = times.get(window, 0) + 1
    for doc_id, text in was.items():
        words = text.split()
        gone = {p for n in range(len(words) - 34) if times[tuple(words[n : n + 35])] > 1 for p in range(n, n + 35)}
        want = " ".join(word for n, word in enumerate(words) if n not in gone) if gone else text
        assert now[doc_id] == want
    assert all(row.n_chars == len(row.text) for row in after.collect())


def test_leaks_go_and_clean_documents_stay(spark, stages):
    _, before, after = stages[3]
    items = [normalised(row.text) for row in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {row.doc_id for row in after.collect()}
    for row in before.collect():
        plain = normalised(row.text)
        if row.doc_id not in kept:
            assert any(distance(item, plain) <= len(item) // 20 for item in items)
        else:
            assert not any(item in plain for item in items)
    assert len(kept) < before.count()


def test_every_token_is_packed(stages):
    _, before, after = stages[4]
    assert {row.doc_id for row in after.collect()} == {row.doc_id for row in before.collect()}
    assert max(row["offset"] + row.length for row in after.collect()) <= 4096


def _through(spark, stage, rows):
    docs = spark.createDataFrame([(*row, "s", len(row[1] or "")) for row in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)[stage](spark, docs.coalesce(1), SF)
    assert kept.columns == COLUMNS
    return sorted(((row.doc_id, row.text) for row in kept.collect()), key=str)


def _words(first, count):
    return " ".join(f"w{n}" for n in range(first, first + count))


def test_null_and_shared_ids_are_judged_by_row(spark):
    trained = [(n, "the words of the text", "en") for n in range(100, 120)]
    rows = [(None, "clean words", "en"), (None, "12 34", "en"), (None, None, "en"), (1, "more words", "en"), (1, "56 78", "en")]
    kept = _through(spark, "language ID", rows + trained)
    assert [row for row in kept if (row[0] or 0) < 100] == [(1, "more words"), (None, "clean words")]

    one, two, three, four = (_words(n * 1000, 40) for n in range(4))
    rows = [(None, one, "en"), (None, two, "en"), (None, one, "en"), (7, three, "en"), (7, four, "en"), (7, four, "en"), (9, four, "en")]
    assert _through(spark, "n-gram Jaccard join", rows) == sorted([(None, one), (None, two), (7, three), (7, four)], key=str)

    passage = _words(0, 35)
    rows = [(None, f"a {passage} b", "en"), (3, f"c {passage} d", "en"), (3, "other  text", "en"), (None, "short\ttext", "en")]
    want = [(None, "a b"), (3, "c d"), (3, "other  text"), (None, "short\ttext")]
    assert _through(spark, "substring dedup", rows) == sorted(want, key=str)

    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, f"so {item} so", "en"), (None, "clean", "en"), (5, f"so {item} so", "en"), (5, "clean too", "en")]
    assert _through(spark, "benchmark decontamination", rows) == sorted([(None, "clean"), (5, "clean too")], key=str)


def test_missing_languages_are_filled_in(spark):
    given = [(n, "the words of the text and more of them " * 5, "en") for n in range(40)]
    given += [(n, "les mots du texte et encore des mots " * 5, "fr") for n in range(40, 80)]
    asked = [(100, "the text and the words of it " * 5, None), (101, "les mots et le texte encore " * 5, None), (102, "les mots du texte", "xx")]
    kind = "doc_id long, text string, lang string, source string, n_chars long"

    def languages(rows):
        docs = spark.createDataFrame([(*row, "s", len(row[1] or "")) for row in rows], kind)
        return {row.doc_id: row.lang for row in corpus_pipeline.language(spark, docs, SF).collect()}

    found = languages(given + asked)
    assert {doc_id: found[doc_id] for doc_id in (0, 79, 100, 101, 102)} == {0: "en", 79: "fr", 100: "en", 101: "fr", 102: "xx"}
    assert languages([(1, "a text", None), (2, "12", None), (3, None, None)]) == {1: "und"}


def test_registration():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in names if name.startswith("op") and name[2].isdigit()}
    assert "pipeline" in names and set(ORACLES) <= set(QUERIES) <= set(names)


def test_columns_with_clashing_names(spark):
    """Columns named as those that the operators add, with spaces and dots, of map type, and none of the rows lost."""
    extra = """concat('s', doc_id) AS score, true AS held_out, 'x' AS lang_pred, 1 AS row_key, 2 AS others, 3 AS rejected_doc_id,
        4 AS n_removed, 5 AS kept, 6 AS `a b`, 7 AS `c.d`, map('k', doc_id) AS pairs"""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.createOrReplaceTempView("clashing_source")
    docs = spark.sql(f"SELECT *, {extra} FROM clashing_source")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            kept = stage(spark, given, SF)
            assert kept.columns == docs.columns, name
            rows = kept.select("doc_id", "score", "row_key", "`a b`", "`c.d`", "pairs").collect()
            assert all((row.score, row.row_key, row[3], row[4], row.pairs) == (f"s{row.doc_id}", 1, 6, 7, {"k": row.doc_id}) for row in rows), name
            assert bool(rows) == (given is docs), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
