import numpy as np

from paperloom.llm.quality import ABSTAINS, BAD, GOOD, LABELLERS, classify, features, fit_label_model, votes
from paperloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_accuracies_are_recovered():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.85, 0.75, 0.9])
    said = np.where(rng.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    said[rng.random(said.shape) < 0.2] = -1
    patterns, counts = np.unique(said, axis=0, return_counts=True)
    model = fit_label_model(patterns, counts)
    assert abs(model.prior - 0.7) < 0.03
    found = model.said[:, 1, 2] / (model.said[:, 1, 1] + model.said[:, 1, 2])
    assert np.abs(found - right).max() < 0.04


def test_agrees_with_the_labels_it_never_saw(spark):
    rows = QUERIES["op8_quality_classifier"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good = np.array([row.score for row in rows if row.quality == 1])
    bad = np.array([row.score for row in rows if row.quality == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert np.mean([row.keep for row in rows if row.quality == 1]) > 0.97
    assert np.mean([row.keep for row in rows if row.quality == 0]) < 0.35


def test_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "few words"), (4, "SPAM!! " * 30_000), (None, "the quick brown fox jumps over a lazy dog " * 3), (5, "a\x00b 🎉 " * 20), (5, "a\x00b 🎉 " * 20)]
    docs = spark.createDataFrame([(*row, "x") for row in rows], "doc_id long, text string, score string")
    got = classify(docs).collect()
    assert len(got) == len(rows) and all(0 <= row.score <= 1 and 0 <= row.posterior <= 1 for row in got)
    assert classify(docs.limit(0)).count() == 0


def test_features_have_length_one():
    own, x = features(b"Some words, some WORDS !!!! 123")
    assert len(set(own.tolist())) == len(own) and abs((x**2).sum() - 1) < 1e-5


def _vote(labeller, words):
    return votes(" ".join(words).encode())[LABELLERS.index(labeller)]


def test_votes_read_the_whole_text_at_any_length():
    few = [f"longer{n}" if n % 100 else "the" for n in range(20_000)]
    assert _vote("short_words", few) == ABSTAINS
    most = ["the" if n % 100 else f"longer{n}" for n in range(20_000)]
    assert _vote("short_words", most) == GOOD
    for count in (100, 300, 390, 1_000, 20_000):
        assert _vote("short_words", ["the" if n % 10 == 0 else f"longer{n}" for n in range(count)]) == ABSTAINS
        assert _vote("short_words", ["the" if n % 5 == 0 else f"longer{n}" for n in range(count)]) == GOOD
    paragraph = [f"word{n}" for n in range(200)]
    for times in (2, 5, 100):
        assert _vote("variety", paragraph * times) == BAD
    assert _vote("variety", paragraph) == GOOD and _vote("variety", [f"word{n}" for n in range(20_000)]) == GOOD
