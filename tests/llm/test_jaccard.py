import random
import re

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import jaccard
from paperloom.llm.common import smallest_reachable
from paperloom.llm.jaccard import PartEnum, _compared, least_differences, near_duplicates, odd_sketch, shingle_set, similar_classes


def sets_of(text, most=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower()) if text else []
    if not words:
        return set()
    width = min(most, len(words))
    return {b" ".join(words[n : n + width]) for n in range(len(words) - width + 1)}


def brute(rows, words=3, percent=90):
    """Component of every doc_id by trying all pairs."""
    own = {}
    for doc_id, text in rows:
        if doc_id is not None:
            own.setdefault(doc_id, []).append(sets_of(text, words))
    label = {doc_id: doc_id for doc_id in own}
    ids = sorted(own)
    linked = [
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in own[a] for y in own[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def random_documents(seed):
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(400)]
    rows = []
    for _ in range(25):
        text = [rng.choice(words) for _ in range(rng.choice([2, 3, 8, 20, 60, 150, 400]))]
        for _ in range(rng.choice([1, 1, 2, 6, 12])):
            rows.append(" ".join(text))
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text.insert(rng.randrange(len(text)), "extra")
    rng.shuffle(rows)
    return list(enumerate(rows))


def found(spark, rows, words=3, percent=90):
    docs = spark.createDataFrame([(*row, "x", 0) for row in rows], "doc_id long, text string, leader string, component long")
    return near_duplicates(docs.repartition(4), words, percent).collect()


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 3, 90), (2, 5, 80)])
def test_components_match_all_pairs(spark, seed, words, percent):
    rows = random_documents(seed)
    want = brute(rows, words, percent)
    assert {row.doc_id: row.component_id for row in found(spark, rows, words, percent)} == want
    assert len(set(want.values())) < len(want)


def test_odd_documents(spark):
    long = " ".join(f"u{n}" for n in range(30_000))
    rows = [(9, "A b\tC d"), (4, "a B c\nd"), (1, ""), (2, None), (3, " \n"), (5, "one"), (6, "ONE"), (7, "É x y"), (8, "é x y"), (None, "one"), (None, None)]
    rows += [(20, long), (21, long + " more"), (22, "dup a b c d"), (22, "other text here now"), (23, "other text here now"), (24, "dup a b c d"), (24, "dup a b c d")]
    got = found(spark, rows)
    want = brute(rows)
    assert sorted((row.doc_id or -1, row.n_shingles) for row in got) == sorted((doc_id or -1, len(sets_of(text))) for doc_id, text in rows)
    assert {row.doc_id: row.component_id for row in got if row.doc_id is not None} == want
    assert want[22] == want[24] == want[23] == 22 and want[8] == 8
    assert all(row.component_id is None for row in got if row.doc_id is None)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_chain_links_beyond_its_first_document(spark):
    base = [f"t{n}" for n in range(200)]
    rows = []
    for step in range(40):
        rows.append((100 - step, " ".join(base)))
        base[step * 5] = f"new{step}"
    assert {row.component_id for row in found(spark, rows)} == {61}


def test_rounds_of_pairs_find_what_the_first_leaves_out(spark, monkeypatch):
    """Families of texts around the threshold: each member has more possible partners than a round names."""
    monkeypatch.setattr(jaccard, "NEAREST", 1)
    monkeypatch.setattr(jaccard, "FURTHER", 2)
    rng = random.Random(21)
    base = [f"t{n}" for n in range(120)]
    rows = []
    for doc_id in range(60):
        text = list(base)
        for place in rng.sample(range(120), rng.choice([1, 2, 2, 3])):
            text[place] = f"v{rng.randrange(3)}"
        rows.append((doc_id, " ".join(text)))
    assert {row.doc_id: row.component_id for row in found(spark, rows)} == brute(rows)


def test_a_task_names_no_more_pairs_than_asked():
    elements = np.arange(200, dtype=np.uint64)
    sketch = odd_sketch(elements)
    count = 50
    rows = pa.table({
        "signature": [7] * count, "i": [0] * count, "j": [0] * count, "own": [0] * count, "doc_id": list(range(count)),
        "component": list(range(count)), "n_shingles": [200] * count, "sketch": [sketch] * count,
    })
    near = _compared(rows, 90, 2)
    assert near.num_rows == 2 * (count - 2) + 1 and set(near["more"].to_pylist()) == {True, False}
    every = _compared(rows, 90)
    assert every.num_rows == count * (count - 1) // 2 and not any(every["more"].to_pylist())


@pytest.mark.parametrize("percent", [90, 80])
def test_similar_sets_share_a_signature(percent):
    rng = random.Random(5)
    scheme = PartEnum(percent)
    for _ in range(1000):
        size = rng.choice([1, 2, 5, 9, 10, 11, 19, 20, 21, 40, 100, 333])
        one = shingle_set(" ".join(f"{rng.random()}" for _ in range(size + 2)).encode())
        other = set(one.tolist())
        for _ in range(rng.randrange(size * (100 - percent) // 80 + 2)):
            if rng.random() < 0.5 and len(other) > 1:
                other.remove(rng.choice(sorted(other)))
            else:
                other.add(rng.getrandbits(64))
        both = set(one.tolist())
        if 100 * len(both & other) >= percent * len(both | other):
            assert set(scheme.signatures(one).tolist()) & set(scheme.signatures(np.array(sorted(other), np.uint64)).tolist())


def test_sketches_never_exceed_the_difference():
    rng = random.Random(8)
    for _ in range(300):
        pool = [rng.getrandbits(64) for _ in range(rng.choice([1, 5, 60, 700]))]
        one, other = ({x for x in pool if rng.random() < share} for share in (rng.random(), 0.9))
        sketches = [np.frombuffer(odd_sketch(np.array(sorted(x), np.uint64)), np.uint8)[None] for x in (one, other)]
        assert least_differences(*sketches) <= len(one ^ other)
        assert least_differences(sketches[0], sketches[0]) == 0


def test_smallest_reachable(spark):
    links = [(n, n + 1) for n in range(60) if n != 30] + [(100, 90), (90, 95), (7, 7)]
    got = {row.node: row.component for row in smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: 0 if n <= 30 else 31 for n in range(61)} | {90: 90, 95: 90, 100: 90}
    assert smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_classes_and_pairs_give_every_link(spark, words, percent):
    rows = [*random_documents(11), (-5, "a b c"), (-6, "A  B c"), (900, None), (901, ""), (None, "a b c")]
    classes, pairs = similar_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words, percent)
    class_of = {row.doc_id: row.class_id for row in classes.collect()}
    assert class_of.keys() == {doc_id for doc_id, text in rows if text} and class_of[None] == class_of[-5] == class_of[-6]
    joined = {(row.a, row.b) for row in pairs.collect()}
    assert all(a < b for a, b in joined) and len(joined) == pairs.count()
    own = {doc_id: sets_of(text, words) for doc_id, text in rows if text and doc_id is not None}
    ids = sorted(own)
    want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b])}
    got = {
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if class_of[a] == class_of[b] or (min(class_of[a], class_of[b]), max(class_of[a], class_of[b])) in joined
    }
    assert got == want
    # More links than the components need.
    assert len(joined) > len(set(class_of.values())) - len(set(brute(rows, words, percent).values()))
