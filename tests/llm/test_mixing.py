import random

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Share out by weight, hold what exceeds its cap, share out the excess again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    names = ["a", "b", "Z", "é", None, "hot"]
    made = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else rng.choice(names)
        made.append((i, source, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300]))))
    return [*made, (None, "a", None), (5000, "lone", ""), (1, rows_source(made, 1), made[1][2])]


def rows_source(made, i):
    return made[i][1]


def test_targets_and_taken_words(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 300
    assert mixing.expand(mixing.mix_sources(df)).agg(F.sum("size")).first()[0] == sum(taken.values())


def test_reruns_agree_whatever_the_partitions(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    pick = lambda n: sorted(((r.doc_id, r.taken) for r in mixing.mix_sources(df.repartition(n)).collect()), key=repr)
    assert pick(1) == pick(7)


def brute_mix(rows, target, most=2, tilt=8):
    """Copies of one source's rows (size, draw): the level by bisection, whole copies, then the order by odds."""
    weight = lambda size: tilt + size.bit_length()
    low, high = 0.0, 1.0
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(s * min(most, level * weight(s)) for s, _ in rows) < target else (low, level)
    expected = [min(most, low * weight(s)) for s, _ in rows]
    copies = [int(e + 1e-9) for e in expected]
    missing, odds = target - sum(c * s for c, (s, _) in zip(copies, rows)), []
    for i, ((_, draw), e, c) in enumerate(zip(rows, expected, copies)):
        u, p = (draw + 0.5) / 2**52, e - c
        if p > 1e-9:
            odds.append((u / (1 - u) * (1 - p) / p, i))
    before = 0
    for _, i in sorted(odds):
        copies[i] += 2 * before + rows[i][0] <= 2 * missing
        before += rows[i][0]
    return copies


def test_extra_copies_come_in_the_order_of_the_odds_not_of_the_draws(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = [r for r in mixing.mix_sources(df).collect() if r.size]
    differs = 0
    for source in {r.source for r in got}:
        part = [r for r in got if r.source == source]
        assert [r.copies for r in part] == brute_mix([(r.size, r.draw) for r in part], part[0].target)
        for size in {r.size for r in part}:
            whole = min(r.copies for r in part if r.size == size)
            assert {r.copies for r in part if r.size == size} <= {whole, whole + 1}
        by_odds = sorted((r for r in part if r.odds is not None), key=lambda r: r.odds)
        differs += [r.draw for r in by_odds] != sorted(r.draw for r in by_odds)
    assert differs


def test_longer_documents_are_likelier(spark):
    rows = [(i, "s" if i % 4 else "t", " ".join(["w"] * (2 if i % 8 < 4 else 200))) for i in range(4000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).groupBy("source", "size").agg(F.avg("copies").alias("mean"))
    mean = {(r.source, r.size): r.mean for r in got.collect()}
    for source, lower, upper in (("s", 2, 200), ("t", 2, 200)):
        assert mean[source, upper] > mean[source, lower]
        assert mean[source, upper] / mean[source, lower] == pytest.approx((8 + 8) / (8 + 2), rel=0.15) or mean[source, upper] == 2


def test_a_flat_tilt_treats_all_sizes_alike(spark, rows):
    df = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"), tilt=10**9)
    for source in ("hot", "é"):
        copies = [r.copies for r in sorted(df.filter("size > 0").collect(), key=lambda r: r.draw) if r.source == source]
        assert copies == sorted(copies, reverse=True)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "s", "a b", "x", 3)], "doc_id long, source string, text string, target string, size int")
    out = mixing.mix_sources(df)
    assert sorted(out.columns) == sorted(["doc_id", "source", "text", "target", "size", "draw", "source_size", "odds", "copies", "taken"])
    assert out.first().size == 2
    assert mixing.mix_sources(df.limit(0)).collect() == []
    assert [r.taken for r in mixing.mix_sources(spark.createDataFrame([(1, None, None)], "doc_id long, source string, text string")).collect()] == [0]
