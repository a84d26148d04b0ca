import random

import pytest

from shelfspark.llm import licenses


def brute_force(text):
    """Names of the templates of which some window of twice their shingles holds enough."""
    words, found = licenses.words_of(text), set()
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            own = licenses.words_of(t)
            n = min(licenses.SHINGLE, len(own))
            shingles = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
            step = len(own) - n + 1
            mine = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
            if any(len(shingles & set(mine[a : a + step])) >= licenses.CONTAINED * len(shingles) for a in range(max(1, len(mine)))):
                found.add(name)
    return found


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    notices = [t for ts in licenses.TEMPLATES.values() for t in ts]
    made = []
    for _ in range(200):
        words = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(0, 300))]
        for _ in range(rng.choice([0, 1, 2])):
            own = rng.choice(notices).split()
            if rng.random() < 0.5 and len(own) > 20:
                own[rng.randrange(len(own))] = "changed"
            if rng.random() < 0.2:
                own = own[: len(own) // 2]
            at = rng.randint(0, len(words))
            words[at:at] = own
        made.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
    return made


def test_finds_what_brute_force_finds(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        assert brute_force(t) <= {f.license for f in got[i]}
        for f in got[i]:
            assert f.containment >= licenses.CONTAINED
            assert 0 <= f.start < f.stop <= len(t)


def test_spans_are_those_of_the_notice(spark):
    text = "Ééé. " * 50 + "\n(Released under the MIT License.) " + "x " * 10 + "All rights reserved."
    found = licenses.scan_licenses(spark.createDataFrame([(text,)], "text string")).first().licenses
    assert [(f.license, text[f.start : f.stop], f.containment) for f in found] == [("MIT", "Released under the MIT License", 1.0), ("Proprietary", "All rights reserved", 1.0)]


def test_small_pieces_give_the_same(spark, texts, monkeypatch):
    whole = licenses.Scanner(licenses.TEMPLATES).scan([licenses.words_of(t) for t in texts])
    single = [licenses.Scanner(licenses.TEMPLATES).scan([licenses.words_of(t)])[0] for t in texts[:60]]
    assert [{f[0] for f in w} for w in whole[:60]] == [{f[0] for f in s} for s in single]


def test_nulls_empty_repeats_long_and_clashing_columns(spark):
    long = "word " * 200_000 + "Licensed under CC BY-NC 4.0."
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, long, 0), (3, long, 0)], "doc_id long, text string, licenses int")
    out = licenses.scan_licenses(df)
    assert out.columns == ["doc_id", "text", "licenses"]
    assert sorted((r.doc_id, [f.license for f in r.licenses]) for r in out.collect()) == [(1, []), (2, []), (3, ["CC-BY-NC-4.0"]), (3, ["CC-BY-NC-4.0"])]
    assert licenses.scan_licenses(df.limit(0)).collect() == []
