import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import lsm


def norm(text):
    return (text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


def brute_force(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, members in groups.items():
        keep = min(members)[3]
        digest = hashlib.sha256(text.encode()).hexdigest()
        kept = False
        for m in sorted(members):
            out.append((m[3], keep, len(members), not kept, digest))
            kept = True
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab \n", k=rng.randint(0, 9))) for _ in range(300)] + [None, "", "é e", "ée ", "x" * 100_000, "x " * 100_000]
    ids = rng.sample(range(9999), len(texts))
    return [*zip(ids, texts, strict=True), (None, "a b"), (None, "q q"), (5, "q  q")]


def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(lsm.dedup_exact(df)) == brute_force(rows)


def test_equal_digests_of_different_texts_are_told_apart(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda text: F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 2))
    assert result(lsm.dedup_exact(df, digest=weak)) == brute_force(rows)


def test_memtables_runs_and_compaction(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    keyed = df.select(lsm.sha256(lsm.normalised(F.col("text"))).alias("digest"), F.length(F.coalesce("text", F.lit(""))).alias("points"), "doc_id")
    runs = lsm.flush_memtables(keyed, 8, memtable_rows=10)
    assert runs.groupBy("digest").count().filter("count > 1").count() > 0
    index, whole = lsm.DigestIndex(memtable_rows=10), lsm.DigestIndex()
    for part in range(3):
        if part:
            index.seal()
        index.insert(keyed.filter(F.pmod(F.xxhash64("doc_id", "digest"), F.lit(3)) == part))
    whole.insert(keyed)
    pick = lambda i: sorted(map(tuple, i.run.select("digest", "points", "doc_id", "copies").collect()))
    assert [x[0] for x in pick(index)] == [x[0] for x in pick(whole)]
    assert [(x[1], x[3]) for x in pick(index)] == [(x[1], x[3]) for x in pick(whole)]
    assert [x[2] for x in pick(index)] == [x[2] for x in pick(whole)]
    index.seal()
    probed = lsm.may_hold(index.run, index.filters)
    assert probed.filter("not maybe").count() == 0
    other = keyed.withColumn("digest", lsm.sha256(F.concat(F.lit("new"), F.col("doc_id").cast("string"))))
    fresh = lsm.merge_runs(lsm.flush_memtables(other.filter("doc_id is not null"), index.shards))
    assert lsm.may_hold(fresh, index.filters).filter("maybe").count() < 30


def test_repeats_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, " a", "y")], "doc_id long, text string, kept string")
    assert result(lsm.dedup_exact(df)) == brute_force([(1, "a"), (1, "a"), (2, " a")])
    assert lsm.dedup_exact(df.limit(0)).collect() == []


@pytest.mark.parametrize("weak", [False, True])
def test_batches_equal_brute_force(spark, rows, weak):
    digest = (lambda text: F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 2))) if weak else lsm.sha256
    batches = [rows[::3], rows[1::3] + rows[:1], rows[2::3] + [(10_000, "a  b  \n "), *rows[:2]]]
    index, so_far = lsm.DigestIndex(memtable_rows=10), []
    for batch in batches:
        got = result(lsm.dedup_exact(spark.createDataFrame(batch, "doc_id long, text string").repartition(2), digest=digest, index=index))
        groups = {r[4]: (r[1], r[2]) for r in brute_force(so_far + batch)}
        # The row that stays is kept in the first batch that has it.
        want, done = [], set()
        for i, t in sorted(batch, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)):
            sha = hashlib.sha256(norm(t).encode()).hexdigest()
            most = max(len(x or "") for _, x in so_far + batch if norm(x) == norm(t))
            is_best = i == groups[sha][0] and len(t or "") == most
            seen = any(j == i and len(x or "") == most and norm(x) == norm(t) for j, x in so_far)
            want.append((i, *groups[sha], is_best and not seen and sha not in done, sha))
            if is_best:
                done.add(sha)
        assert got == sorted(want, key=repr)
        so_far += batch
