import math

import numpy as np
import pytest

from shelfspark.llm import negatives, queries

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute_force(rows, scale=256, every=100, k=5, kn=5):
    fine = [(i, c, [math.floor(scale * x) for x in v]) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in fine:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, c) for i, c, w in fine if i != a)
        for p, positive, _ in [s for s in scored if s[2] == label][:k]:
            good = [(-s, i) for s, i, c in scored if c != label and 80 * -p <= 100 * -s <= 100 * -p][:kn]
            out += [(a, positive, n + 1, i, -p, s) for n, (s, i) in enumerate(good)]
    return sorted(out)


def result(spark, rows, **how):
    return sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, SCHEMA), **how).collect()))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    v = rng.normal(0, 0.2, (900, 12))
    v[:, 0] += 0.3
    v[200:320] = v[200]  # equal vectors of several labels, so many ties
    v[400:410] = 0
    labels = rng.choice(6, 900, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05])
    return [(i, int(labels[i]), [float(np.float32(x)) for x in v[i]]) for i in range(900)]


@pytest.mark.parametrize("how", [{}, {"tile": 70, "strip": 2, "block": 3, "every": 20}, {"tile": 10_000}])
def test_equals_brute_force(spark, rows, how):
    want = brute_force(rows, every=how.get("every", 100))
    assert len(want) > 30
    assert result(spark, rows, **how) == want


def test_packed_products_are_exact():
    rng = np.random.default_rng(1)
    for dims, most in ((1, 1), (3, 7), (8, 200), (64, 250), (16, 40_000), (5, 1 << 30), (4, 1 << 61)):
        v = rng.integers(-most, most + 1, (37, dims))
        low, high = int(min(0, v.min())), int(max(0, v.max()))
        width = negatives.field_width(low, high, dims)
        tile = negatives.Tile(np.arange(37), np.zeros(37, dtype=np.int64), negatives.pack(v if width <= 8 else v.astype(object), low, width), low, width)
        for a in v[:5]:
            exact = [sum(int(x) * int(y) for x, y in zip(a, c)) for c in v]
            assert tile.scores([int(x) for x in a]).tolist() == [min(max(x, negatives.LONG[0]), negatives.LONG[1]) for x in exact]


def test_best_breaks_ties_by_id():
    s, i = negatives.best(np.array([3, 9, 9, 9, 1]), np.array([1, 7, 5, 6, 2]), 2)
    assert (s.tolist(), i.tolist()) == ([9, 9], [5, 6])


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, None, [1.0, 0.5]), (3, 2, None), (4, 2, [None, 1.0]), (5, 2, [nan, 1.0]), (6, 2, [-inf, 1.0]), (None, 2, [1.0, 0.25]), (8, 2, [0.9, 0.25]), (9, 3, [0.1, 0.0]), (100, 5, [1.0, 0.0])]
    want = brute_force(rows)
    assert {(r[0], r[1], r[3]) for r in want} == {(0, 1, 8), (0, 1, 100)}
    assert result(spark, rows) == want
    assert result(spark, rows[:0]) == []
    assert result(spark, rows[2:7]) == []


def test_signs_of_the_positive_score(spark):
    rows = [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-1.0]), (3, 2, [-0.9]), (100, 7, [0.0, 1.0]), (5, 7, [1.0, 0.0]), (6, 8, [1.0, 0.0]), (7, 8, [0.5])]
    want = brute_force([(i, c, v + [0.0] * (2 - len(v))) for i, c, v in rows])
    assert {r[0] for r in want} == {100}
    assert {r[4:] for r in want} == {(0, 0)}
    assert result(spark, rows) == want


def test_repeated_rows_and_extra_columns(spark):
    rows = [(0, 1, [1.0]), (0, 1, [1.0]), (7, 1, [2.0]), (7, 1, [2.0]), (8, 2, [1.75]), (8, 2, [1.75])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", row long, v int")
    got = sorted(map(tuple, negatives.mine(df).collect()))
    assert got == sorted(2 * (2 * [(0, 7, 1, 8, 131072, 114688), (0, 7, 2, 8, 131072, 114688)]))


def test_the_query_moves_labels(spark, tmp_path, rows):
    held = [(i, (c if i % 2 else None) if i < 8 else c, v) for i, c, v in rows]
    spark.createDataFrame(held, SCHEMA).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries.op11_negatives(spark, f"file://{tmp_path}").collect()))
    moved = [(i, None if c is None else (c + 1) % 10 if i % 7 == 0 else c, v) for i, c, v in held]
    assert got == brute_force(moved)
