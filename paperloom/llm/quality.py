"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import by_batch, lists, texts

#: Texts of fewer words are too short for most labellers.
FEW_WORDS = 15
#: Bound of the scorer's training sample: documents, chosen by a hash.
SAMPLE_DOCS = 6_000
BUCKETS = 1 << 15
EM_ROUNDS = 60
EPOCHS = 12
GOOD, BAD, ABSTAINS = 1, 0, -1
LABELLERS = ("variety", "capitals", "symbols", "word_length", "exclamation", "short_words", "lines", "separators")
_word_end = re.compile(rb"[.,;:?]+$")


def votes(text: bytes) -> list[int]:
    """What each labeller says of a text: 1 good, 0 bad, -1 nothing."""
    words = text.split()
    count = len(words)
    if count < FEW_WORDS:
        return [ABSTAINS] * len(LABELLERS)
    letters = text.translate(None, bytes(range(0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)))
    upper = len(letters.translate(None, bytes(range(0x5B, 0x100))))
    marks = len(text.translate(None, bytes(range(0x21)) + b"0123456789.,;:?'\"-" + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))))
    lines = text.split(b"\n")
    mean = len(letters) / count
    says = lambda bad, good: BAD if bad else GOOD if good else ABSTAINS
    # Shares of the whole text, which mean the same at any length.
    variety = len(set(zip(words, words[1:], words[2:]))) / (count - 2)
    short = sum(len(word) < 4 for word in words) / count
    return [
        says(variety < 0.6, variety > 0.9),
        says(upper > 0.3 * len(letters), upper < 0.15 * len(letters)),
        says(marks > 0.05 * len(text), marks < 0.01 * len(text)),
        says(mean < 2 or mean > 14, 3 < mean < 9),
        says(text.count(b"!") > 0.1 * count, text.count(b"!") < 0.02 * count),
        says(False, short > 0.15),
        says(len(lines) > 4 and len(set(lines)) < 0.6 * len(lines), len(set(lines)) > 0.9 * len(lines)),
        says(text.count(b"|") + text.count(b"\t") > 0.1 * count, b"|" not in text),
    ]


@dataclass
class LabelModel:
    """``prior``: share of good texts; ``said[labeller, class, vote]``: chance of a vote, abstaining included."""

    prior: float
    said: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance that texts with these votes are good."""
        logs = np.log([1 - self.prior, self.prior])[None, :].repeat(len(patterns), 0)
        for nth in range(patterns.shape[1]):
            logs += np.log(self.said[nth][:, patterns[:, nth] + 1]).T
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> LabelModel:
    """Expectation-maximisation over vote patterns and how many texts have each.

    A labeller looks for one fault and says good where that one is missing, so the start takes every text with a bad vote
    for bad, and for good those with good votes only.
    """
    good, bad = (patterns == GOOD).any(axis=1), (patterns == BAD).any(axis=1)
    belief = np.where(bad, 0.03, np.where(good, 0.97, 0.5))
    model = LabelModel(0.5, np.full((patterns.shape[1], 2, 3), 1 / 3))
    for _ in range(rounds):
        mass = np.stack([counts * (1 - belief), counts * belief])
        prior = float((mass[1].sum() + 1) / (mass.sum() + 2))
        said = np.stack([np.stack([mass @ (patterns[:, nth] == vote) for vote in (-1, 0, 1)], axis=1) for nth in range(patterns.shape[1])])
        model = LabelModel(prior, (said + 1) / (said + 1).sum(axis=2, keepdims=True))
        belief = model.posterior(patterns)
    return model


class _Buckets(dict):
    """Of a word, its own bucket and that of its shape: letters, capitals, digits and marks, long runs cut short."""

    SHAPE = bytes.maketrans(
        bytes(range(256)),
        bytes(65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 97 if 97 <= b <= 122 or b >= 128 else b for b in range(256)),
    )

    def __missing__(self, word: bytes) -> tuple[int, int]:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        shape = re.sub(rb"(.)\1{2,}", rb"\1\1", word.translate(self.SHAPE))
        plain = _word_end.sub(b"", word).lower()
        pair = (xxhash.xxh32_intdigest(plain) % (BUCKETS // 2), BUCKETS // 2 + xxhash.xxh32_intdigest(shape) % (BUCKETS // 2))
        self[word] = pair
        return pair


_buckets = _Buckets()


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text and their weights, of length 1: shares of words and of shapes, and of repeats."""
    words = text.split()
    if not words:
        return np.zeros(1, np.int32), np.ones(1, np.float32)
    ids = np.fromiter((bucket for pair in map(_buckets.__getitem__, words) for bucket in pair), np.int64, 2 * len(words))
    times = np.bincount(ids, minlength=BUCKETS)
    own = np.flatnonzero(times)
    weights = np.sqrt(times[own] / len(words))
    return own.astype(np.int32), (weights / np.sqrt((weights**2).sum())).astype(np.float32)


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels by AdaGrad, a text at a time."""
    weights, square, bias, bias_square = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), 0.0, 1e-8
    rng = np.random.default_rng(seed)
    good = max(float(targets.sum()), 1.0)
    bad = max(float((1 - targets).sum()), 1.0)
    for _ in range(EPOCHS):
        for nth in rng.permutation(len(rows)):
            own, x = rows[nth]
            chance = 1 / (1 + np.exp(-np.clip(weights[own] @ x + bias, -30, 30)))
            # Both classes weigh alike, however rare bad texts are.
            scale = targets[nth] * len(rows) / (2 * good) + (1 - targets[nth]) * len(rows) / (2 * bad)
            error = (chance - targets[nth]) * scale
            slope = error * x
            square[own] += slope * slope
            weights[own] -= 0.3 * slope / np.sqrt(square[own])
            bias_square += error * error
            bias -= 0.3 * error / np.sqrt(bias_square)
    return weights.astype(np.float32), float(bias)


def classify(docs: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """``(doc_id, posterior, score, keep)`` for every row of ``docs(doc_id, text)``.

    Every text is voted on; the votes of all texts, as counts of at most 3^8 patterns, give the labellers' accuracies.
    ``posterior`` is the label model's chance that the text is good, ``score`` the scorer's, which has learnt from the
    posteriors of at most ``sample`` texts chosen by a hash, and ``keep`` whether their mean is at least one half. No given
    label is read.

    A null or empty text, and one of fewer than 15 words, gets no votes, so its posterior is that of a text on which all
    abstain. A null ``doc_id`` is kept, repeated rows are answered each. Further columns are ignored; an empty table gives
    no rows.
    """

    def voted(batch: pa.RecordBatch) -> dict[str, object]:
        said = np.array([votes(text) for text in texts(batch)], np.int64)
        code = ((said + 1) * 3 ** np.arange(len(LABELLERS))).sum(axis=1)
        return {"doc_id": batch.column("doc_id"), "pattern": pa.array(code, pa.int32())}

    plain = docs.select("doc_id", "text")
    counted = by_batch(plain, voted, "doc_id long, pattern int").groupBy("pattern").agg(F.count("*").alias("n")).collect()
    codes = np.array(sorted(row.pattern for row in counted), np.int64)
    times = {row.pattern: row.n for row in counted}
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    model = fit_label_model(patterns, np.array([times[code] for code in codes.tolist()], float))
    posterior = dict(zip(codes.tolist(), model.posterior(patterns).tolist(), strict=True))

    def described(batch: pa.RecordBatch) -> dict[str, object]:
        given = texts(batch)
        rows = [features(text) for text in given]
        code = [int(((np.array(votes(text)) + 1) * 3 ** np.arange(len(LABELLERS))).sum()) for text in given]
        sizes = [len(own) for own, _ in rows]
        return {
            "posterior": pa.array([posterior[own] for own in code], pa.float64()),
            "ids": lists(np.concatenate([own for own, _ in rows]), sizes), "weights": lists(np.concatenate([x for _, x in rows]), sizes),
        }

    chosen = plain.where("text is not null").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "text").limit(sample)
    learnt = by_batch(chosen, described, "posterior double, ids array<int>, weights array<float>").toArrow()
    rows = [(np.array(own), np.array(x)) for own, x in zip(learnt.column("ids").to_pylist(), learnt.column("weights").to_pylist(), strict=True)]
    weights, bias = train_scorer(rows, learnt.column("posterior").to_numpy())

    def scored(batch: pa.RecordBatch) -> dict[str, object]:
        given = texts(batch)
        said = np.array([votes(text) for text in given], np.int64)
        belief = np.array([posterior[code] for code in ((said + 1) * 3 ** np.arange(len(LABELLERS))).sum(axis=1).tolist()])
        sums = np.array([weights[own] @ x for own, x in map(features, given)], np.float64) + bias
        score = 1 / (1 + np.exp(-np.clip(sums, -500, 500)))
        return {"doc_id": batch.column("doc_id"), "posterior": belief, "score": score, "keep": (belief + score) / 2 >= 0.5}

    return by_batch(plain, scored, "doc_id long, posterior double, score double, keep boolean")
