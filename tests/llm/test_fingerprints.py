import hashlib
import random
import re

from pyspark.sql import functions as F

from paperloom.llm.fingerprints import PARAGRAPH, differences, digests, document_fingerprints, sketch


def paragraphs(text):
    return {found.strip(" ") for found in re.findall(PARAGRAPH, text or "")} - {""}


def near(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / max(len(a), len(b)) if a or b else 1.0


def brute(rows):
    """Texts of one id differ nowhere in ``rows``."""
    text_of = {doc_id: text or "" for doc_id, text in rows}
    order = sorted(text_of, key=lambda doc_id: (doc_id is not None, doc_id or 0))
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    for doc_id, text in rows:
        text, following = text or "", text_of[after[doc_id]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        lost, added = paragraphs(text) - paragraphs(edited), paragraphs(edited) - paragraphs(text)
        yield (
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), near(text, edited), near(text, following),
            len(paragraphs(text)), len(lost), len(added),
        )


def sample():
    rng = random.Random(13)
    words = ["the", "Öl", "日本", "fox", "𝄞", "ran", "é"]

    def line():
        return " ".join(rng.choice(words) + str(rng.randrange(60)) + rng.choice(["", "", ".", "!?", ","]) for _ in range(rng.randrange(1, 25)))

    rows = [(n * 3 - 60, "\n".join(line() for _ in range(rng.randrange(8)))) for n in range(60)]
    rows += [(9_000 + n, rows[5][1]) for n in range(4)]
    rows += [(7_000, None), (7_001, ""), (7_002, "abc"), (7_003, "one."), (None, "no id. at all\nbut text"), (7_004, "\n\n . \t\n")]
    rows += [(8_000, "\n".join(f"line {n}" for n in range(3_000))), (8_001, "\n".join(f"line {n}" for n in range(5, 3_000, 2)))]
    rows += [(8_002, "a" * 20_000), (8_003, "x. " * 7_000)]
    return rows + [rows[3], rows[3], (None, "no id. at all\nbut text")]


def test_all_columns(spark):
    rows = sample()
    docs = spark.createDataFrame([(*row, "x", 1.0) for row in rows], "doc_id long, text string, place string, need double").repartition(4)
    got = document_fingerprints(docs).collect()
    plain = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.n_paragraphs, r.n_lost, r.n_added) for r in got]
    assert sorted(plain, key=str) == sorted(brute(rows), key=str)
    prints = {}
    for row in got:
        prints.setdefault(row.doc_id, set()).add(row.fingerprint)
    assert all(len(own) == 1 for own in prints.values())
    assert len(set.union(*[prints[n] for n in (9_000, 9_001, 9_002, -45)])) == 1
    assert len(set.union(*prints.values())) > 60


def test_next_of_ids_with_several_texts(spark):
    docs = spark.createDataFrame([(1, "aaaa. bbbb."), (2, "cccc."), (2, "dddd."), (1, "eeeeeeee")], "doc_id long, text string")
    got = {(row.doc_id, row.n_chars): row.edited_sha256 for row in document_fingerprints(docs).collect()}
    assert len(got) == 3
    one = [hashlib.sha256(("aaaa. bbb"[:9] + start).encode()).hexdigest() for start in ("cc", "dd")]
    assert got[1, 11] in one


def test_empty_and_lone(spark):
    kind = "doc_id long, text string"
    assert document_fingerprints(spark.createDataFrame([], kind)).collect() == []
    (row,) = document_fingerprints(spark.createDataFrame([(4, "abcd. efgh")], kind)).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcd. efab").hexdigest() and row.near_next == 1.0


def test_differences_are_the_digests(spark):
    rows = [("a.\nb.\nc.", "a.\nc.\nd."), ("", "a."), ("\n".join(map(str, range(900))), "\n".join(map(str, range(400, 2_000))))]
    pairs = spark.createDataFrame(rows, "x string, y string").select(digests(F.col("x")).alias("a"), digests(F.col("y")).alias("b"))
    zero = F.lit(0)
    found = pairs.select("a", "b", differences(F.col("a"), F.col("b"), sketch(F.col("a"), zero), sketch(F.col("b"), zero)).alias("d"))
    for row in found.collect():
        assert sorted(row.d.plus) == sorted(set(row.a) - set(row.b))
        assert sorted(row.d.minus) == sorted(set(row.b) - set(row.a))


def test_no_python_on_the_way(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    plan = document_fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
