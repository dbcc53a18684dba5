import random

from paperloom.llm.decontamination import find_leaks, nearest, normalised, pieces
from paperloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def distance(item, text):
    """Fewest edits to any substring, by the whole matrix."""
    above = [0] * (len(text) + 1)
    for n, letter in enumerate(item, 1):
        row = [n]
        for m, other in enumerate(text, 1):
            row.append(min(above[m - 1] + (letter != other), above[m] + 1, row[-1] + 1))
        above = row
    return min(above)


def edited(rng, text, times):
    letters = list(text)
    for _ in range(times):
        at = rng.randrange(len(letters))
        letters[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "q", "z9"])
    return "".join(letters)


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(200):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(90)))
        best, end = nearest(item, text)
        assert best == distance(item, text) == distance(item, text[:end])


def test_pieces_cover_the_item():
    for errors in range(6):
        parts = pieces("abcdefghijk", errors)
        assert len(parts) == errors + 1 and "".join(piece for _, piece in parts) == "abcdefghijk"


def test_every_leak_within_the_budget(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    text_of = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(n, text_of(rng.randrange(9, 40))) for n in range(12)] + [(50, "short one"), (51, None), (52, "")]
    docs = []
    for n in range(120):
        _, item = items[rng.randrange(12)]
        leak = edited(rng, item.upper() if n % 2 else item.replace(" ", "\n-- "), rng.choice([0, 1, 3, 6, 12, 20]))
        docs.append((n, f"{text_of(30)}. {leak}, {text_of(30)}" if n % 3 else text_of(80)))
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, text_of(3_000) + items[1][1]), (503, items[2][1]), (503, items[2][1])]
    found = find_leaks(
        spark.createDataFrame([(*row, "x") for row in docs], "doc_id long, text string, item_id string").repartition(3),
        spark.createDataFrame([(*row, "y") for row in items], "item_id long, text string, doc_id string"),
    ).collect()
    want = []
    for doc_id, text in docs:
        for item_id, item in items[:12]:
            plain = normalised(item)
            best = distance(plain, normalised(text)) if text else 999
            if best <= len(plain) * 5 // 100:
                want.append((doc_id or -1, item_id, best))
    assert sorted((row.doc_id or -1, row.item_id, row.errors) for row in found) == sorted(want)
    assert 0 < len(want) < len(docs)
    whole = {(doc_id, item_id): normalised(text)  for doc_id, text in docs if text for item_id in range(12)}
    for row in found:
        place = whole[row.doc_id, row.item_id][row.first_char : row.last_char + 1]
        assert distance(normalised(items[row.item_id][1]), place) == row.errors


def test_passes_and_empty_tables(spark, monkeypatch):
    import paperloom.llm.decontamination as module

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    once = sorted(QUERIES["op5_benchmark_decontamination"](spark, SF).collect())
    monkeypatch.setattr(module, "PASS_CHARS", 3_000)
    assert sorted(find_leaks(docs, items).collect()) == once and once
    assert find_leaks(docs, items.limit(0)).count() == find_leaks(docs.limit(0), items).count() == 0
    held = {row.doc_id for row in once}
    texts = {row.doc_id: row.text for row in docs.collect()}
    exact = {doc_id for doc_id, text in texts.items() for item in items.collect() if item.text in text}
    assert exact <= held and len(held) < len(texts) / 2


def test_short_items_stand_word_for_word(spark):
    items = [(1, "What is six?"), (2, "?!"), (3, "x"), (4, None), (5, "")]
    docs = [(1, "so WHAT -- is\nsix"), (2, "what is sixty"), (3, "somewhat is six"), (4, "what is sex"), (5, "what is six what is six"), (6, "a x"), (7, None)]
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 0, 3, 13), (5, 1, 0, 0, 10), (6, 3, 0, 2, 2)]


def test_equal_rows_of_an_item_are_looked_for_once(spark, monkeypatch):
    import paperloom.llm.decontamination as module

    sizes, pass_ = [], module._pass

    def counted(docs, items, *others):
        sizes.append(sum(len(text) for _, text in items))
        return pass_(docs, items, *others)

    monkeypatch.setattr(module, "_pass", counted)
    monkeypatch.setattr(module, "PASS_CHARS", 1_000)
    item = "an item of the benchmark that many of its rows hold alike"
    docs = spark.createDataFrame([(1, f"so {item} so"), (2, "clean")], "doc_id long, text string")
    found = find_leaks(docs, spark.createDataFrame([(7, item)] * 300, "item_id long, text string"))
    assert [(row.doc_id, row.item_id, row.errors) for row in found.collect()] == [(1, 7, 0)]
    assert sizes == [len(item)]
