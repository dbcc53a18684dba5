import math
import random

import numpy as np
import pytest

from paperloom.llm.topk import quantised, top_k


def brute(rows, queries, k):
    for query_id, q in queries:
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), vec_id) for vec_id, v in rows if len(v) == len(q) and vec_id != query_id)
        for rank, (score, vec_id) in enumerate(scores[:k], 1):
            yield query_id, rank, vec_id, -score


@pytest.mark.parametrize("spread", [2, 500, 10**9])
def test_all_scores(spark, spread):
    rng = random.Random(spread)
    hot = [rng.randrange(-spread, spread) for _ in range(6)]
    rows = [(n, hot if n % 3 == 0 else [rng.randrange(-spread, spread) for _ in range(6)]) for n in range(700)]
    rows += [(1_000 + n, [n - 3]) for n in range(7)] + [(2_000, []), (2_001, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, q array<long>")
    queries = vectors.where("vec_id % 20 = 0")
    got = top_k(vectors, queries, shard=120, block=10).collect()
    want = list(brute(rows, [row for row in rows if row[0] % 20 == 0], 5))
    assert sorted(map(tuple, got)) == sorted(want)


def test_quantised_leaves_out_what_is_no_vector(spark):
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, [math.nan, 0.0]), (5, [math.inf, 0.0]), (6, []), (None, [1.0, 1.0])]
    vectors = quantised(spark.createDataFrame([(*row, "x") for row in rows], "vec_id long, embedding array<float>, score string"))
    assert sorted(((row.vec_id, row.q) for row in vectors.collect()), key=str) == [(1, [128, -1]), (6, []), (None, [256, 256])]
    assert top_k(vectors, vectors).count() == 0
    assert top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_repeated_rows_count_once(spark):
    vectors = spark.createDataFrame([(1, [1, 2])] * 3 + [(2, [3, 1])] * 2, "vec_id long, q array<long>")
    assert sorted(map(tuple, top_k(vectors, vectors).collect())) == [(1, 1, 2, 5), (2, 1, 1, 5)]


def test_a_tree_skips_far_nodes():
    from paperloom.llm.topk import LEAST, BallTree, Best, search

    rng = np.random.default_rng(1)
    own = np.concatenate([rng.integers(-5, 5, (500, 4)) + 1_000 * side for side in (-1, 1)])
    tree = BallTree(own, 50)
    best = Best(1, 3, np.array([LEAST]))
    search(tree, np.arange(1_000), np.array([[9, 9, 9, 9]]), np.array([-1]), best)
    want = np.sort(own @ np.full(4, 9))[::-1][:3]
    assert best.scores[0].tolist() == want.tolist()
