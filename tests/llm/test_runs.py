import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from shelfspark.llm import queries, runs


def by_definition(words, least=12):
    """Every maximal stretch with period q, by comparing all words q apart; kept if q is its smallest period."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                stretch = words[i : j + q]
                if not any(all(stretch[x] == stretch[x + d] for x in range(len(stretch) - d)) for d in range(1, q)):
                    out.append((i, len(stretch), q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def documents():
    rng = random.Random(3)
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 300, list("ab") * 6, list("abcdefg") * 5, fibonacci(377), list("abaabaaabaaaab") * 9]
    out += [[c for c in "".join("a" * rng.randint(5, 30) + "b" for _ in range(20))] for _ in range(3)]
    out += [["x"] * 60 + ["y"] + ["x"] * 60 + ["y"] + ["x"] * 59 + ["y"] + ["x"] * 60]
    for k in (1, 2, 3, 6, 40):
        for _ in range(12):
            out.append([f"w{rng.randrange(k)}" for _ in range(rng.randint(1, 160))])
    for _ in range(60):
        words = []
        while len(words) < 120:
            unit = [f"w{rng.randrange(9)}" for _ in range(rng.randint(1, 30))]
            if rng.random() < 0.4:
                unit = unit * rng.randint(2, 4) + unit[: rng.randrange(len(unit) + 1)]
            words += unit
        out.append(words)
    return out


def test_runs_equal_their_definition():
    docs = documents()
    got = runs.find(*runs.numbered(docs))
    for i, words in enumerate(docs):
        assert got.get(i, []) == by_definition(words), words
    for i in (4, 7, 20, 80):
        assert runs.find(*runs.numbered([docs[i]])).get(0, []) == by_definition(docs[i])


@pytest.mark.parametrize("least", [2, 4, 10, 14])
def test_other_least_lengths(least):
    docs = documents()[:60]
    got = runs.find(*runs.numbered(docs), least)
    assert [got.get(i, []) for i in range(len(docs))] == [by_definition(w, least) for w in docs]


def test_seeds_in_small_parts(monkeypatch):
    docs = documents()
    want = runs.find(*runs.numbered(docs))
    monkeypatch.setattr(runs, "SEEDS_AT_ONCE", 7)
    assert runs.find(*runs.numbered(docs)) == want


def test_long_periodic_texts_need_few_seeds(monkeypatch):
    listed = []
    inner = runs.seeds

    def counted(*a):
        for lags, at in inner(*a):
            listed.append(len(lags))
            yield lags, at

    monkeypatch.setattr(runs, "seeds", counted)
    line = [f"w{i}" for i in range(10)]
    assert runs.find(*runs.numbered([line * 5000])) == {0: [(0, 50_000, 10)]}
    unit = [f"v{i}" for i in range(7000)]
    assert runs.find(*runs.numbered([["x"] + unit * 3 + unit[:9]])) == {0: [(1, 21_009, 7000)]}
    assert sum(listed) < 11 * 80_000


def test_nulls_repeats_and_clashing_columns(spark):
    line = "one two three"
    rows = [(1, None, 7), (2, "", 7), (3, " ".join([line] * 5), 7), (3, " ".join([line] * 5), 7), (None, " \t\n", 7), (5, "a\x1cb " * 30, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    out = runs.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "runs", "collapsed"]
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()]
    assert got == [(1, [], ""), (2, [], ""), (3, [(0, 15, 3)], line), (3, [(0, 15, 3)], line), (None, [], ""), (5, [(0, 30, 1)], "a\x1cb")]
    assert runs.periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="even"):
        runs.periodic_runs(df, least=5)


def test_the_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(None, "a b " * 20), (7, None), (8, ""), (9, "\n\t ")]
    rows += [(i, " ".join(w + rng.choice(["", "", "\n", " "]) for w in words)) for i, words in enumerate(documents(), 10)]
    rows += [(i, " ".join(f"u{rng.randrange(50)}" for _ in range(rng.randint(1, 400)))) for i in range(1000, 1120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_runs(spark, f"file://{tmp_path}").collect()}
    assert len(got) == len(rows)
    planted = 0
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
        g = h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = by_definition(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[doc_id]
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
    assert planted > 10


def test_numbers_of_words():
    words, sizes = runs.numbered([["a", "b"], [], ["a"]])
    assert (words.tolist(), sizes.tolist()) == ([0, 1, 0], [2, 0, 1])
    assert runs.find(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) == {}
