import hashlib
import random
import re
from collections import Counter

import pytest

from paperloom.llm.queries import QUERIES
from paperloom.llm.substrings import remove_repeats, runs


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text) if text else []


def brute(rows, window):
    times = Counter()
    for _, text in rows:
        words = words_of(text)
        times.update(tuple(words[n : n + window]) for n in range(len(words) - window + 1))
    for doc_id, text in rows:
        words = words_of(text)
        covered = set()
        for n in range(len(words) - window + 1):
            if times[tuple(words[n : n + window])] > 1:
                covered.update(range(n, n + window))
        kept = " ".join(word for n, word in enumerate(words) if n not in covered)
        yield doc_id, len(words), len(covered), hashlib.sha256(kept.encode()).hexdigest()


def sample(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(60)]
    passage = [[rng.choice(vocabulary) for _ in range(rng.choice([8, 12, 13, 30, 80]))] for _ in range(8)]
    rows = []
    for n in range(80):
        words = []
        for _ in range(rng.randrange(6)):
            words += [rng.choice(vocabulary) for _ in range(rng.randrange(25))]
            if rng.random() < 0.6:
                words += rng.choice(passage)
        rows.append((n, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows + [(500, "a b " * 40), (501, rows[3][1]), (3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (502, None), (503, "")]


@pytest.mark.parametrize("hot", [0, 3, 20_000])
def test_removes_what_all_windows_say(spark, hot, monkeypatch):
    import paperloom.llm.substrings as module

    plain = module.repeated_windows
    monkeypatch.setattr(module, "repeated_windows", lambda docs, window, width: plain(docs, window, width, hot))
    rows = sample(hot)
    docs = spark.createDataFrame([(*row, "x", 1) for row in rows], "doc_id long, text string, starts string, n_words int")
    got = remove_repeats(docs.repartition(3), 12, 5).drop("kept").collect()
    key = lambda row: tuple(-1 if value is None else value for value in row)
    assert sorted(map(key, got)) == sorted(map(key, brute(rows, 12)))
    assert any(row.n_removed for row in got)


def test_production_size_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(row.doc_id, row.text) for row in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op9_substring_dedup"](spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 35))


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_cover_every_window_once():
    words = [f"w{n % 17}".encode() for n in range(200)]
    first, count, least = runs(words, 35, 9)
    assert first[0] == 0 and count.sum() == 166 and (first[1:] == first[:-1] + count[:-1]).all() and len(least) < 60


@pytest.mark.parametrize("rows", [
    [(1, None)],
    [(1, None), (2, None), (None, None)],
    [(1, "one two")],
    [(1, "a b c"), (2, " ".join(f"w{n}" for n in range(60))), (3, " ".join(f"w{n}" for n in range(60)))],
], ids=["one null", "nulls", "one short", "short and long apart"])
def test_tasks_without_a_window(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows))
    got = [tuple(row)[:4] for row in remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 35), key=str)
