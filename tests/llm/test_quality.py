import random

import numpy as np
import pytest

from shelfspark.llm import quality


def made(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(1, 400))]
        good = rng.random() < 0.7
        if not good:
            at = rng.randrange(len(words))
            words[at : at + 30] = [w + rng.choice(["***", "$$$"]) for w in words[at : at + 30]]
        rows.append((i, " ".join(words), int(good)))
    return rows


def test_chunks_overlap_and_cover_the_text():
    for n in (0, 1, 4, 1020, 1023, 1024, 1025, 1028, 5000):
        data = bytes(range(1, 251)) * (n // 250 + 1)
        parts = quality.chunks(data[:n])
        joined = parts[0].tobytes() + b"".join(p[quality.STEP :].tobytes() for p in parts[1:])
        assert joined[:n] == data[:n]
        assert all((parts[i][-quality.STEP :] == parts[i + 1][: quality.STEP]).all() for i in range(len(parts) - 1))
        assert len(joined) - n <= quality.CHUNK


def test_held_out_accuracy(spark):
    rows = made(700)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    net = quality.train(docs, labels, steps=300)
    got = {r.doc_id: r.score for r in quality.classify(spark.createDataFrame([(i, t) for i, t, _ in made(300, 9)], "doc_id long, text string"), net).collect()}
    right = np.mean([(got[i] >= 0.5) == bool(q) for i, _, q in made(300, 9)])
    assert right > 0.9
    again = quality.train(docs.repartition(5), labels, steps=300)
    assert all((a == b).all() for a, b in zip(net.parameters(), again.parameters(), strict=True))


def test_scores_depend_on_the_text_alone():
    net = quality.Network()
    texts = [t.encode() for _, t, _ in made(40)] + [b"", b"x" * 300_000]
    one = np.concatenate([net.scores([t]) for t in texts])
    assert net.scores(texts) == pytest.approx(one, abs=1e-5)


def test_without_labels_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "p"), (2, "", "q"), (2, "", "q"), (None, "x " * 50_000, "r")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (99, 1), (None, 0)], "doc_id long, quality int")
    net = quality.train(docs, labels)
    out = quality.classify(docs, net)
    assert out.columns == ["doc_id", "text", "score"]
    assert [r.score for r in out.collect()] == [0.5] * 4
    assert quality.classify(docs.limit(0), net).collect() == []
    one = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, quality.train(docs, one, steps=5)).collect())
