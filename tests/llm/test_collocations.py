import random
import re
from collections import Counter

import numpy as np
import pytest

from paperloom.llm.collocations import collocations
from paperloom.llm.quotient import counted, decode, encode, limb_widths, pack_ids, permute, restore, unpack_ids

UPPER = {code: code + 32 for code in range(65, 91)}


def brute(rows, least, longest, first, subsumed):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\v\f\r]", (text or "").translate(UPPER)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, *words[at : at + k]) for at in range(len(words) - k + 1))
    candidates = {key: a for key, a in counts.items() if len(key) > 2 and a >= least}
    for lang in totals:
        found = []
        for key, a in candidates.items():
            own = key[1:]
            if key[0] != lang or any(
                other[0] == lang and len(other) > len(key) and 100 * b >= subsumed * a
                and any(other[at : at + len(own)] == own for at in range(1, len(other) - len(own) + 1))
                for other, b in candidates.items()
            ):
                continue
            cuts = []
            for k in range(1, len(own)):
                left, right = counts[(lang, *own[:k])], counts[(lang, *own[k:])]
                cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(own).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1):
            yield lang, rank, phrase.decode(), -a, left, right, totals[lang], -score


def sample(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Über", "ÉCOLE", "New", "york", "x y", "a", "b", "c", *[f"w{n}" for n in range(30)]]
    passage = "it was the best of times, it was the worst of times"
    rows = []
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(30)):
            words.append(rng.choice(vocabulary[: rng.choice([4, 10, 40])]) + rng.choice(["", "", "", "", ",", ".", "!\n"]))
            if rng.random() < 0.1:
                words.append(passage)
        rows.append((rng.choice(["en", "fr", None, "und"]), rng.choice([" ", "  ", "\t"]).join(words)))
    return rows + [("en", None), ("en", ""), ("fr", "a a a a a a a. A a"), ("en", ", . ;"), ("de", "b " * 3000), ("de", "b " * 3000)]


@pytest.mark.parametrize(("seed", "least", "subsumed", "block", "longest"), [(1, 3, 100, 50, 5), (2, 2, 60, 1 << 20, 2), (3, 2, 60, 1, 5)])
def test_counts_and_scores(spark, seed, least, subsumed, block, longest, monkeypatch):
    monkeypatch.setattr("paperloom.llm.collocations.MERGED", 64)
    rows = sample(seed)
    docs = spark.createDataFrame([(*row, n) for n, row in enumerate(rows)], "lang string, text string, n long").repartition(3)
    got = collocations(docs, least=least, longest=longest, first=25, subsumed=subsumed, block_words=block)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = list(brute(rows, least, longest, 25, subsumed))
    assert len(want) > 30
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_nothing_to_count(spark):
    kind = "lang string, text string"
    assert collocations(spark.createDataFrame([], kind)).collect() == []
    assert collocations(spark.createDataFrame([("en", None), (None, "one two")], kind)).collect() == []
    assert collocations(spark.createDataFrame([("en", "one. two")] * 3, kind), least=2).collect() == []


@pytest.mark.parametrize(("bits", "length"), [(1, 2), (9, 3), (13, 5), (25, 5), (33, 4), (40, 5)])
def test_filters_lose_nothing(bits, length):
    rng = np.random.default_rng(bits)
    size = 3_000
    ids = [rng.integers(0, min(1 << bits, 1 << 62), size).astype(np.uint64) for _ in range(length)]
    for column in ids:
        column[: size // 2] %= np.uint64(3)
    widths = limb_widths(bits * length)
    assert sum(widths) == bits * length and max(widths) <= 64
    packed = pack_ids(ids, bits)
    assert all((back == column).all() for back, column in zip(unpack_ids(packed, bits, length), ids, strict=True))
    moved = permute(packed, widths)
    assert all((back == limb).all() for back, limb in zip(restore(moved, widths), packed, strict=True))
    limbs, counts, place = counted(moved, rng.integers(1, 700, size))
    assert all((limb[place] == own).all() for limb, own in zip(limbs, moved, strict=True))
    for skipped in sorted({0, min(3, widths[0])}):
        prefix = limbs[0] >> np.uint64(widths[0] - skipped) if skipped < 64 else limbs[0]
        if not skipped:
            prefix = np.zeros(len(counts), np.uint64)
        for value in np.unique(prefix):
            own = prefix == value
            kept = [limb[own] for limb in limbs]
            back, times = decode(encode(kept, widths, counts[own], skipped), widths, int(value))
            assert (times == counts[own]).all()
            assert all((limb == other).all() for limb, other in zip(back, kept, strict=True))
