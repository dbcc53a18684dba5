import random

import numpy as np
import pytest

from paperloom.llm.negatives import AnchorTree, hard_negatives, labelled


def brute(rows, asked, positives, negatives, low, high):
    for anchor_id, label, q in asked:
        scored = sorted(
            (-sum(a * b for a, b in zip(q, v, strict=True)), vec_id, other)
            for vec_id, other, v in rows if len(v) == len(q) and vec_id != anchor_id
        )
        for score, positive_id, _ in [row for row in scored if row[2] == label][:positives]:
            fit = [row for row in scored if row[2] != label and low * -score <= 100 * -row[0] <= high * -score]
            for rank, (other, negative_id, _) in enumerate(fit[:negatives], 1):
                yield anchor_id, positive_id, rank, negative_id, -score, -other


@pytest.mark.parametrize(("spread", "per_pass"), [(3, 7), (400, 1_000), (10**9, 20)])
def test_all_scores(spark, spread, per_pass, monkeypatch):
    monkeypatch.setattr("paperloom.llm.negatives.CHUNK", 90)
    rng = random.Random(spread)
    hot = [rng.randrange(spread) for _ in range(5)]
    centres = [[rng.randrange(spread) for _ in range(5)] for _ in range(4)]

    def near(label):
        return [x + rng.randrange(-spread // 4 - 1, spread // 4 + 1) for x in centres[label]]

    rows = [(n, n % 4, hot if n % 3 == 0 else near(n % 4)) for n in range(600)]
    rows += [(1_000 + n, n % 2, [n - 3]) for n in range(9)] + [(2_000, 1, []), (2_001, 2, []), (2_002, 1, [])]
    rows += [(3_000, 77, near(0)), (3_010, 1, [-x for x in centres[1]])]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, q array<long>").repartition(5)
    asked = [row for row in rows if row[0] % 10 == 0]
    got = hard_negatives(vectors, vectors.where("vec_id % 10 = 0"), 3, 6, pass_anchors=per_pass).collect()
    want = list(brute(rows, asked, 3, 6, 30, 90))
    assert len(want) > 200
    assert sorted(map(tuple, got)) == sorted(want)


def test_tree_joins_all_at_the_least_length():
    points = np.random.default_rng(5).integers(-50, 50, (40, 3))
    tree = AnchorTree(points)
    seen, stack, total = set(), [tree.root], 0.0
    while stack:
        at = stack.pop()
        assert at not in seen
        seen.add(at)
        for child in tree.children[at]:
            assert np.isclose(tree.edges[child], np.sqrt(((points[child] - points[at]) ** 2).sum()))
            total += tree.edges[child]
            stack.append(child)
    assert len(seen) == 40
    # Kruskal's total.
    root = list(range(40))

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    least = 0.0
    for length, a, b in sorted((float(np.sqrt(((points[a] - points[b]) ** 2).sum())), a, b) for a in range(40) for b in range(a)):
        if top(a) != top(b):
            root[top(a)] = top(b)
            least += length
    assert np.isclose(total, least)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, -0.1], 3, "x"), (None, [0.5, 0.5], 1, "x"), (2, None, 1, "x"), (3, [0.1, None], 1, "x"), (4, [nan, 0.0], 1, "x"),
        (5, [inf, 0.0], 1, "x"), (6, [0.25, 0.25], None, "x"), (7, [1.0, 1.0], 2, "x"), (7, [1.0, 1.0], 2, "y"), (7, [0.0, 1.0], 2, "z"), (8, [], 1, "x"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, q string")
    got = sorted(map(tuple, labelled(table).collect()))
    assert got == [(1, 3, [128, -26]), (7, 2, [0, 256]), (8, 1, [])]
    empty = labelled(table.where("false"))
    assert hard_negatives(empty, empty).collect() == []
    lone = labelled(table)
    assert hard_negatives(lone, lone).collect() == []
