import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import katz


def brute_force(rows):
    """rows (doc_id, held, text) to {doc_id: (n_tokens, n_known, base, score)}, and the pair probability function."""
    tokens = {i: [*t.encode().lower().split(), b""] for i, _, t in rows}
    train = [i for i, held, _ in rows if not held]
    c = Counter(w for i in train for w in tokens[i])
    pairs = Counter(p for i in train for p in zip(["begin", *tokens[i]], tokens[i]))
    n, v = sum(c.values()), len(c)

    def of(counts):
        tally = Counter(counts)
        return katz.discounts([0, *[tally[k] for k in range(1, katz.K + 2)]]), tally

    d1, tally = of(c.values())
    freed = sum((1 - d1[k]) * k * tally[k] for k in range(1, katz.K + 1))
    scale, unknown = (n, freed / n) if freed > 0 else (n + 1, 1 / (n + 1))
    single = lambda w: (d1[c[w]] if c[w] <= katz.K else 1) * c[w] / scale if c[w] else unknown
    d2, _ = of(pairs.values())
    after = defaultdict(dict)
    for (a, b), k in pairs.items():
        after[a][b] = k

    def pair(a, b):
        if a not in after:
            return single(b)
        c1 = sum(after[a].values())
        d = {k: (d2[x] if x <= katz.K else 1) * x / c1 for k, x in after[a].items()}
        if all(x > katz.K for x in after[a].values()):
            d = {k: x / (c1 + 1) for k, x in after[a].items()}
        if b in d:
            return d[b]
        return (1 - sum(d.values())) / (1 - sum(map(single, after[a]))) * single(b)

    out = {}
    for i, ts in tokens.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts)
        out[i] = (len(ts), sum(c[w] > 0 for w in ts), base, sum(math.log10(pair(a, b)) for a, b in zip(["begin", *ts], ts)))
    return out, pair, c, after


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["The", "OF"] * 8
    weights = [1 / (i + 1) for i in range(len(words))]
    made = [(i, i % 7 == 2, " ".join(rng.choices(words, weights, k=rng.randint(0, 60))) + rng.choice(["", " x", "\n"]) + f" rare{i}") for i in range(120)]
    return [*made, (500, False, ""), (501, True, "never seen words"), (502, False, "the of " * 400), (503, True, "é É a b")]


def test_scores_equal_brute_force(spark, rows):
    want, *_ = brute_force(rows)
    df = spark.createDataFrame(rows, "doc_id long, held boolean, text string").repartition(3)
    for block_bytes in (500, 10**6):
        got = {r.doc_id: r for r in katz.score(df, block_bytes).collect()}
        assert got.keys() == want.keys()
        for i, (n, known, base, score) in want.items():
            assert (got[i].n_tokens, got[i].n_known) == (n, known)
            assert got[i].base_score == pytest.approx(base, rel=1e-9)
            assert got[i].score == pytest.approx(score, rel=1e-9), i


def test_probabilities_sum_to_one(rows):
    _, pair, counts, after = brute_force(rows)
    for first in ["begin", b"the", b"w5", b"rare3", b"unheard"]:
        assert sum(pair(first, w) for w in [*counts, b"unheard"]) == pytest.approx(1)


def test_nulls_empty_table_and_repeats(spark):
    df = spark.createDataFrame([(None, None, "src"), (1, "A b", "x"), (1, "A b", "x"), (2, "", None)], "doc_id long, text string, score string")
    got = katz.score_documents(df, F.lit(False)).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in got) == [(False, 1), (False, 3), (False, 3), (True, 1)]
    assert all(math.isfinite(r.score) for r in got)
    assert katz.score_documents(df.limit(0), F.lit(False)).collect() == []
    unlearned = katz.score_documents(df, F.lit(True)).collect()
    assert {r.train_tokens for r in unlearned} == {0}
    assert all(r.score == 0 for r in unlearned)
