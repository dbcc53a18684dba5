"""Language identification: a byte convolutional network over fixed-length windows, trained in numpy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import by_batch, kinds_of, texts

WINDOW = 160
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bound of the training sample: documents of each language, and characters of each of them.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 2_400
EPOCHS = 5
#: The byte that fills a text's last window; it never occurs in UTF-8 and its weights stay zero.
PAD = 0xFF
UNKNOWN = "und"
NOT_LETTERS = bytes(range(0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x100))


@dataclass
class Network:
    """For each width, one table of byte weights per place; a bias per filter; softmax weights over the pooled filters."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows_of(text: bytes, length: int = WINDOW) -> np.ndarray:
    """The whole text in rows of ``length`` bytes; neighbours share the bytes a filter may span."""
    step = length - max(WIDTHS) + 1
    count = max(1, -(-(len(text) - max(WIDTHS) + 1) // step))
    data = np.full((count - 1) * step + length, PAD, np.uint8)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, length)[::step]


def _convolved(network: Network, windows: np.ndarray, nth: int) -> np.ndarray:
    table = network.tables[nth]
    places = windows.shape[1] - WIDTHS[nth] + 1
    total = table[0][windows[:, :places]]
    for place in range(1, WIDTHS[nth]):
        total += table[place][windows[:, place : place + places]]
    return total


def train(samples: list[tuple[str, bytes]], seed: int = 7) -> Network:
    """Fit the network on labelled texts by Adam on the cross-entropy of their windows."""
    rng = np.random.default_rng(seed)
    languages = sorted({language for language, _ in samples})
    cut = [(languages.index(language), windows_of(text)) for language, text in samples if text]
    x = np.concatenate([rows for _, rows in cut]) if cut else np.empty((0, WINDOW), np.uint8)
    y = np.concatenate([np.full(len(rows), label) for label, rows in cut]) if cut else np.empty(0, int)
    network = Network(
        languages,
        [rng.normal(0, 0.1, (width, 256, FILTERS)).astype(np.float32) for width in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    for table in network.tables:
        table[:, PAD] = 0
    values = [*network.tables, network.bias, network.out, network.out_bias]
    moments = [(np.zeros_like(value), np.zeros_like(value)) for value in values]
    share = np.bincount(y, minlength=len(languages))
    weight = (len(y) / (len(languages) * np.maximum(share, 1)))[y].astype(np.float32) if len(y) else y
    turn = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            own = order[at : at + 128]
            turn += 1
            for value, grad, (mean, square) in zip(values, _gradients(network, x[own], y[own], weight[own]), moments, strict=True):
                mean += 0.1 * (grad - mean)
                square += 0.001 * (grad * grad - square)
                value -= 0.01 * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.999**turn)) + 1e-8)
    return network


def _gradients(network: Network, windows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    rows = np.arange(len(windows))
    maps = [_convolved(network, windows, nth) for nth in range(len(WIDTHS))]
    at = [own.argmax(axis=1) for own in maps]
    pooled = np.concatenate([np.take_along_axis(m, a[:, None], 1)[:, 0] for m, a in zip(maps, at, strict=True)], axis=1)
    pooled = pooled + network.bias
    active = np.maximum(pooled, 0)
    logits = active @ network.out + network.out_bias
    wrong = np.exp(logits - logits.max(axis=1, keepdims=True))
    wrong /= wrong.sum(axis=1, keepdims=True)
    wrong[rows, labels] -= 1
    wrong *= (weight / len(windows))[:, None]
    back = (wrong @ network.out.T) * (pooled > 0)
    grads = []
    for nth, width in enumerate(WIDTHS):
        grad = np.zeros_like(network.tables[nth])
        own = back[:, nth * FILTERS : (nth + 1) * FILTERS]
        for place in range(width):
            np.add.at(grad[place], (windows[rows[:, None], at[nth] + place], np.arange(FILTERS)[None, :]), own)
        grad[:, PAD] = 0
        grads.append(grad)
    return [*grads, back.sum(axis=0), active.T @ wrong, wrong.sum(axis=0)]


class Predictor:
    """The trained network with the tables of neighbouring bytes summed up, so that a place costs five look-ups."""

    def __init__(self, network: Network):
        self.network = network
        pairs = [[t[n][:, None] + t[n + 1][None, :] for n in range(0, len(t) - 1, 2)] for t in network.tables]
        self.pairs = [[p.reshape(1 << 16, FILTERS) for p in own] for own in pairs]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(windows), 128):
            own = windows[at : at + 128]
            pair = (own[:, :-1].astype(np.int32) << 8) | own[:, 1:]
            pooled = []
            for nth, width in enumerate(WIDTHS):
                places = own.shape[1] - width + 1
                total = self.pairs[nth][0][pair[:, :places]]
                for n, table in enumerate(self.pairs[nth][1:], 1):
                    total += table[pair[:, 2 * n : 2 * n + places]]
                if width % 2:
                    total += self.network.tables[nth][-1][own[:, width - 1 : width - 1 + places]]
                pooled.append(total.max(axis=1))
            active = np.maximum(np.concatenate(pooled, axis=1) + self.network.bias, 0)
            logits = active @ self.network.out + self.network.out_bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            parts.append(odds / odds.sum(axis=1, keepdims=True))
        return np.concatenate(parts)


def has_letter(text: bytes) -> bool:
    return bool(text.translate(None, NOT_LETTERS)) or any(letter.isalpha() for letter in text.decode())


def held_out() -> F.Column:
    """Documents that no training may see."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def training_sample(docs: DataFrame, most: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, bytes]]:
    """At most ``most`` documents of each language, chosen by a hash, and the first ``chars`` characters of each."""
    known = docs.where("lang is not null and text is not null").where(~F.coalesce(held_out(), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
    short = known.select("doc_id", "lang", F.substring("text", 1, chars).alias("text"))
    chosen = short.withColumn("place", place).where(F.col("place") <= most)
    return sorted((row.lang, row.text.encode()) for row in chosen.select("lang", "text").collect())


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs(doc_id, text)``.

    Every window of the whole text is classified; the document's language has the largest mean of log-probabilities,
    weighted by the windows' letters, ties to the first in the alphabet, and its score is the mean of its probabilities.
    A text that is null or holds no letter is ``und`` with score 0, as is every text when the network knows no language.
    A null ``doc_id`` stays null and counts as not held out. Repeated rows are answered each. Further columns are ignored.
    """
    return predictions(docs, network).select("doc_id", "held_out", "lang_pred", "score")


def predictions(docs: DataFrame, network: Network, carry: Sequence[str] = ()) -> DataFrame:
    """As ``identify``, with ``lettered``, whether the text holds a letter, and the columns ``carry`` of each row's own."""
    schema = "doc_id long, held_out boolean, lang_pred string, score double, lettered boolean" + kinds_of(docs, carry)
    weights = network

    def predict(batch: pa.RecordBatch) -> dict[str, object]:
        predictor = Predictor(weights)
        given = texts(batch)
        lettered = [has_letter(text) for text in given]
        chosen, scores = [UNKNOWN] * len(given), np.zeros(len(given))
        todo = [n for n, known in enumerate(lettered) if known and weights.languages]
        at = 0
        while at < len(todo):
            group, size = [], 0
            while at < len(todo) and (size < 1 << 20 or not group):
                group.append(todo[at])
                size += len(given[todo[at]])
                at += 1
            for n, (language, score) in zip(group, _of_documents(predictor, [given[n] for n in group]), strict=True):
                chosen[n], scores[n] = weights.languages[language], score
        found = {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(chosen), "score": scores}
        return found | {"lettered": pa.array(lettered, pa.bool_())} | {name: batch.column(name) for name in carry}

    others = [name for name in carry if name != "text"]
    marked = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text", *others)
    return by_batch(marked, predict, schema)


def _of_documents(predictor: Predictor, given: list[bytes]) -> list[tuple[int, float]]:
    cut = [windows_of(text) for text in given]
    sizes = np.array([len(rows) for rows in cut])
    rows = np.concatenate(cut)
    odds = predictor.probabilities(rows).astype(np.float64)
    letters = ((rows | 0x20) >= 0x61).sum(axis=1) + 1e-3
    first = np.cumsum(sizes) - sizes
    total = np.add.reduceat(letters, first)[:, None]
    logs = np.add.reduceat(np.log(np.maximum(odds, 1e-12)) * letters[:, None], first) / total
    best = logs.argmax(axis=1)
    mean = np.add.reduceat(odds * letters[:, None], first) / total
    return [(int(n), float(min(1.0, mean[at, n]))) for at, n in enumerate(best)]
