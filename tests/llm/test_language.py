import numpy as np

from paperloom.llm.language import Predictor, _convolved, identify, train, training_sample, windows_of
from paperloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = QUERIES["op1_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    unseen = [row for row in rows if row.held_out]
    assert len(unseen) > 150 and np.mean([row.lang == row.lang_pred for row in unseen]) > 0.97
    assert all(0 <= row.score <= 1 for row in rows)


def test_windows_hold_every_byte_run():
    text = bytes(range(32, 127)) * 7
    rows = windows_of(text, 160)
    spans = {bytes(row[n : n + 4]) for row in rows for n in range(157)}
    assert {text[n : n + 4] for n in range(len(text) - 3)} <= spans
    assert len(windows_of(b"")) == 1 and (windows_of(b"a")[0][1:] == 255).all()


def test_pair_tables_convolve_alike():
    network = train([("a", b"abc abc " * 30), ("b", b"xyz zyx " * 30)])
    rows = windows_of(b"abc zyx! " * 90)
    pooled = np.concatenate([_convolved(network, rows, nth).max(axis=1) for nth in range(3)], axis=1) + network.bias
    logits = np.maximum(pooled, 0) @ network.out + network.out_bias
    odds = np.exp(logits - logits.max(axis=1, keepdims=True))
    assert np.allclose(Predictor(network).probabilities(rows), odds / odds.sum(axis=1, keepdims=True), atol=1e-4)


def test_odd_documents(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 ... \n", "fr"), (4, "é", None), (None, "the words", None), (5, "the " * 40_000, None), (6, "x", "en")]
    docs = spark.createDataFrame([(*row, "s") for row in rows], "doc_id long, text string, lang string, score string")
    network = train([("en", b"the words of the text " * 20), ("fr", "é è à ça été ".encode() * 20)])
    got = {(row.doc_id, row.score > 0): row.lang_pred for row in identify(docs, network).collect()}
    assert got[1, False] == got[2, False] == got[3, False] == "und"
    assert got[4, True] == "fr" and got[5, True] == "en" and (None, True) in got
    nothing = training_sample(docs.limit(0))
    assert nothing == [] and {row.lang_pred for row in identify(docs, train(nothing)).collect()} == {"und"}
    assert identify(docs.limit(0), network).count() == 0


def test_training_never_sees_held_out_documents(spark):
    docs = spark.createDataFrame([(n, f"text {n}", "en") for n in range(400)], "doc_id long, text string, lang string")
    import zlib

    seen = {text.decode() for _, text in training_sample(docs)}
    assert seen == {f"text {n}" for n in range(400) if zlib.crc32(str(n).encode()) % 4 != 2}
    assert len(training_sample(docs, most=7)) == 7
