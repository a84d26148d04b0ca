import random

import numpy as np
import pytest

from shelfspark.llm import near


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    """The smallest id of each class, links being pairs with a Jaccard similarity of at least 0.8."""
    rows = sorted(rows)
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if 5 * len(a & b) >= 4 * len(a | b) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return {rows[k][0] for k in root}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(2000)]
    made = []
    for _ in range(50):
        base = rng.choices(words, k=rng.randint(100, 300))
        for _ in range(rng.randint(1, 4)):
            text = list(base)
            for _ in range(rng.randint(0, len(base) // 60)):  # each edit changes five shingles
                text[rng.randrange(len(text))] = rng.choice(words)
            made.append(" ".join(text).title() if rng.random() < 0.3 else "\n".join(text))
    # Mostly one repeated shingle, but otherwise different: an equal fingerprint isn't a copy.
    made += ["x " * 400 + " ".join(rng.choices(words, k=60)) for _ in range(4)]
    made += [None, "", " \t", "one", "ONE", "one two", "É é"]
    return list(zip(rng.sample(range(10_000), len(made)), made, strict=True))


@pytest.mark.parametrize("small", [32, 1])
def test_equals_brute_force(spark, rows, small, monkeypatch):
    monkeypatch.setattr(near, "SMALL", small)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in near.keep_one(df).collect()} == brute_force(rows)


def test_nulls_repeats_and_columns(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1), (7, "a b c d e f", 2), (7, "a b c d e f", 2), (None, None, 3)], "doc_id long, text string, node int")
    kept = near.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.node for r in kept.collect()) == [2, 3]
    assert near.keep_one(df.limit(0)).collect() == []


def classes(sets):
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and near.similar(x.tobytes(), sets[j].tobytes()):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def kept_classes(spark, sets, keys):
    rows = [(n, n - 100_000, bytearray(x.tobytes()), k) for n, (x, k) in enumerate(zip(sets, keys, strict=True))]
    df = near.materialise(spark.createDataFrame(rows, "__row long, __set long, __shingles binary, __keys array<long>"))
    root = {r.node + 100_000: r.root + 100_000 for r in near.components(near.links(df)).collect()}
    return [root.get(n, n) for n in range(len(sets))]


@pytest.mark.parametrize(("edits", "seed"), [(9, 1), (12, 2), (14, 3), (18, 4)])
def test_variants_of_one_text_lose_no_link(spark, edits, seed, monkeypatch):
    # 300 variants of 196 shingles in one large bucket: some pairs are linked, others not, in up to hundreds of classes.
    monkeypatch.setattr(near, "BLOCK_SETS", 40)
    monkeypatch.setattr(near, "BLOCK_BYTES", 40 * 2000)
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 196, dtype=np.uint64)
    sets = []
    for n in range(300):
        x = base.copy()
        x[rng.choice(196, rng.integers(0, 2 * edits), replace=False)] = rng.integers(0, 1 << 63, dtype=np.uint64) + np.uint64(n)
        sets.append(np.unique(x))
    got = kept_classes(spark, sets, [[7, -8 - n % 2] for n in range(300)])
    assert got == classes(sets)
    assert len(set(got)) < 300


def test_a_bucket_of_sets_that_differ_loses_no_link(spark):
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 63, 20, dtype=np.uint64) for _ in range(150)]
    sets += [np.append(sets[n][:19], np.uint64(n)) for n in range(0, 60, 2)] + [np.append(sets[7], np.uint64(n)) for n in range(60)]
    sets = [np.unique(x) for x in sets]
    assert kept_classes(spark, sets, [[1, *([-1 - n] if n % 3 else [-1])] for n in range(len(sets))]) == classes(sets)


def test_a_chain_through_a_bucket_is_one_class(spark):
    # Neighbours are similar, others aren't: a star finds next to nothing.
    values = np.arange(1, 2001, dtype=np.uint64)
    sets = [values[n * 10 : n * 10 + 100] for n in range(150)]
    got = kept_classes(spark, sets, [[3]] * 150)
    assert got == classes(sets) == [0] * 150
