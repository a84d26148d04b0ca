import math

import numpy as np
import pytest

from shelfspark.llm import topk


def brute_force(rows, k=20, every=20):
    vectors = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in vectors:
        if q % every:
            continue
        found = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def result(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(map(tuple, topk.top_k(topk.quantised(df), **how).collect()))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    v = rng.normal(0, 0.2, (700, 16)).astype(np.float32)
    v[100:300] = v[100]  # many equal vectors, so many ties
    v[300:310] = 0
    return [(int(i), [float(x) for x in r]) for i, r in enumerate(v)]


@pytest.mark.parametrize("how", [{}, {"candidate_rows": 90, "query_rows": 7}, {"k": 3}])
def test_equals_brute_force(spark, rows, how):
    assert result(spark, rows, **how) == brute_force(rows, how.get("k", 20))


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    for scale in (3e3, 4e6):
        rows = [(i, [float(np.float32(x)) for x in rng.normal(0, scale, 6)]) for i in range(80)]
        assert result(spark, rows) == brute_force(rows)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [-inf, 1.0]), (5, [0.25, -1.0]), (None, [1.0, 1.0]), (20, [0.0, 0.0])]
    assert result(spark, rows) == brute_force(rows)
    assert result(spark, rows[:0]) == []


def test_repeated_rows_are_candidates_each(spark):
    rows = [(0, [1.0]), (7, [2.0]), (7, [2.0])]
    assert result(spark, rows) == [(0, 1, 7, 8192), (0, 2, 7, 8192)]


def test_processing_stops_early(rows):
    v = np.array([[math.floor(64 * x) for x in r] for _, r in rows])
    levels = [held for held, _ in topk.segments(v)]
    assert (sum(levels) == v).all()
    assert len(levels) > 3
