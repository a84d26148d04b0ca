import random

import numpy as np
import pytest

from shelfspark.llm import lines, queries


def brute_force(rows, min_words=5):
    """rows (doc_id, text) to the sorted list of (doc_id, text without later similar lines)."""
    earlier, out = [], []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            out.append((i, None, 0))
            continue
        kept, gone = [], 0
        for line in t.split("\n"):
            words = line.encode().lower().split()
            own = set(words)
            if len(words) >= min_words:
                hit = any(9 * len(own & e) >= 4 * (len(own) + len(e)) for e in earlier)
                earlier.append(own)
                if hit:
                    gone += 1
                    continue
            kept.append(line)
        out.append((i, "\n".join(kept), gone))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.text, r.removed_lines) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choices(words, k=rng.randint(3, 30)) for _ in range(60)]
    made = []
    for i in range(150):
        text = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base)) if rng.random() < 0.7 else rng.choices(words, k=rng.randint(1, 40))
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                line[rng.randrange(len(line))] = rng.choice(words)
            text.append(" ".join(line).upper() if rng.random() < 0.2 else " ".join(line))
        made.append((i, "\n".join(text)))
    core = [f"c{i}" for i in range(40)]  # a large group of similar lines
    made += [(1000 + i, " ".join([*core, f"u{i}", *rng.choices(words, k=rng.randint(0, 9))])) for i in range(120)]
    return made


@pytest.mark.parametrize("block_bytes", [3000, 10**7])
def test_equals_brute_force(spark, rows, block_bytes):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(lines.dedup_lines(df, block_bytes=block_bytes)) == brute_force(rows)


def test_lines_beyond_the_first_few_candidates_are_verified(spark, rows, monkeypatch):
    monkeypatch.setattr(lines, "FIRST_FEW", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(lines.dedup_lines(df)) == brute_force(rows)


def test_nulls_repeats_empty_and_clashing_columns(spark):
    long = " ".join(f"t{i}" for i in range(5000))
    rows = [(None, "a b c d e", "p", 1), (1, None, "q", 2), (2, "", "r", 3), (3, "a b c d e", "s", 4), (3, "a b c d e", "s", 4), (4, long + "\n" + long, "t", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, removed_lines int")
    got = lines.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "block", "removed_lines"]
    assert sorted(((r.doc_id, r.text, r.block, r.removed_lines) for r in got.collect()), key=repr) == sorted([(None, "", "p", 1), (1, None, "q", 0), (2, "", "r", 0), (3, "a b c d e", "s", 0), (3, "", "s", 1), (4, long, "t", 1)], key=repr)
    assert lines.dedup_lines(df.limit(0)).collect() == []


def test_short_lines_of_the_query(spark, tmp_path):
    made = [(1, "All rights reserved.\na b c d"), (2, "all  RIGHTS reserved.\n\nShare"), (3, "Share\n\na b c d e"), (4, "d c b\nb c d")]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(1, made[0][1], 0), (2, "\nShare", 1), (3, "", 2), (4, "d c b", 1)]
    assert result(queries.op9_lines(spark, str(tmp_path))) == want


def test_a_word_of_all_lines_costs_no_pairs_and_slices_lose_none(spark, rows):
    """Postings of five-word lines under one word at the second place can't be similar: nothing is compared."""
    n = 50_000
    one = lambda x: np.full(n, x, dtype=np.int64)
    tested = []
    y, x, more = lines.candidates(np.full(n, 7, dtype=np.uint64), one(0), one(5), one(1), np.arange(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool), 2, tested)
    assert sum(tested) == len(y) == len(x) == 0 and not more.any()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(lines.dedup_lines(df, block_bytes=3000, heavy=20)) == brute_force(rows)
