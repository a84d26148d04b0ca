import random
import re

import numpy as np
import pytest
import xxhash

from shelfspark.llm import components, simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, radius=3):
    """Fingerprints to the smallest position reachable."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    made = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(0, 120))
        for _ in range(rng.randint(1, 5)):
            text = list(base)
            if text and rng.random() < 0.6:
                text[rng.randrange(len(text))] = rng.choice(words)
            made.append(" ".join(text).title() if rng.random() < 0.3 else "\n".join(text))
    made += [None, "", " \t", "one", "one TWO", "É é", "x " * 30000, "x " * 30000]
    ids = rng.sample(range(10_000), len(made))
    return list(zip(ids, made, strict=True))


def test_classes_equal_brute_force(spark, rows):
    rows = sorted(rows)
    prints = [brute_print(t) for _, t in rows]
    root = brute_classes(prints)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.simhash & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {i: (p, rows[k][0]) for (i, _), p, k in zip(rows, prints, root, strict=True)}
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == {rows[k][0] for k in root}


def test_nulls_repeats_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a b c d", 1, "p"), (7, "a b c d", 2, "q"), (7, "a b c d", 2, "q"), (None, None, 3, "r")], "doc_id long, text string, simhash int, component_id string")
    got = sorted((r.doc_id is None, r.component_id is None, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(False, False, 7), (False, False, 7), (True, False, 7), (True, True, None)]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.simhash) for r in kept.collect() if r.doc_id) == [(7, 2)]
    assert kept.count() == 2
    assert simhash.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("within", [True, False])
def test_tiles_keep_all_components(within):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (2000, 2), dtype=np.uint64)
    prints = np.unique(np.concatenate([base, rng.choice(base, 2000) ^ np.bitwise_xor.reduce(flips, axis=1), rng.integers(0, 1 << 63, 1500, dtype=np.uint64)]))
    a, b = simhash.tile_links(prints, None, 3) if within else simhash.tile_links(prints[::2], prints[1::2], 3)
    at = {int(p): i for i, p in enumerate(prints)}
    root = components.local_roots(len(prints), np.array([at[int(x)] for x in a]), np.array([at[int(x)] for x in b]))
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    if not within:
        side = np.arange(len(prints)) % 2
        close &= side[:, None] != side[None, :]
    i, j = np.nonzero(close)
    assert (root == components.local_roots(len(prints), i, j)).all()


def test_small_tiles(spark, rows):
    df = simhash.add_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).select("simhash").distinct()
    pairs = lambda t: {frozenset(((r.node, r.root))) for r in components.components(simhash.links(df, tile_rows=t)).collect()}
    assert pairs(5) == pairs(10_000)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}
