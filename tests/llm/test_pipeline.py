import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from shelfspark.llm import bpe, mixing, quality, simhash
from shelfspark.llm.common import materialise
from tests.llm import test_lines, test_mixing, test_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(materialise(stage(spark, docs[-1], SF)))
    return docs


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_quality_keeps_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = stages[1].select("doc_id")
    good = labels.filter("quality = 1")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.02 * good.count()
    bad = labels.filter("quality = 0")
    assert bad.join(kept, "doc_id", "left_anti").count() >= 0.5 * bad.count()
    net = quality.train(stages[0], labels)
    scores = {r.doc_id: r.score for r in quality.classify(stages[0], net).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= quality.THRESHOLD}


def test_lines_equal_brute_force(stages):
    want = [(i, t) for i, t, _ in test_lines.brute_force(rows(stages[1]), min_words=1)]
    assert sorted(rows(stages[2]), key=repr) == sorted(want, key=repr)
    assert stages[2].filter(F.col("n_chars") != F.length("text")).count() == 0


def test_near_duplicates_equal_brute_force(stages):
    assert {i for i, _ in rows(stages[3])} == test_near.brute_force(rows(stages[2]))


def test_near_duplicates_are_those_of_fingerprints(spark):
    # One shingle makes up most of each of the first two texts, so their fingerprints are equal; the third differs.
    texts = ["x " * 400 + " ".join(f"{k}{i}" for i in range(60)) for k in "ab"] + [" ".join(f"c{i}" for i in range(200))]
    docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_each(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in simhash.keep_one(docs).collect()} == {0, 2}


def test_mix_is_near_its_targets(stages):
    sizes, taken = {}, {}
    for r in stages[3].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.encode().split())
    largest = max(len(r.text.encode().split()) for r in stages[3].collect())
    for r in stages[4].collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.encode().split())
    for s, want in test_mixing.brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - want) <= largest
    assert stages[4].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= mixing.MOST_COPIES


def test_tokens_equal_the_reference_encoder(stages):
    ranks = bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(rows(stages[4]))
    got = stages[5].collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows(stages[4]))
    for r in got:
        assert list(r.token_ids) == exact.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, runs int, node long, row string, `label` int"


def test_nulls_long_texts_repeats_and_extra_columns(spark, tmp_path):
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    texts = [(1, "a text of some words that nothing else repeats here", "p"), (2, None, "p"), (3, "", None), (None, "a text without an id, and with words of its own", "p"), (5, long, "q"), (6, "twice the same row of words in the table of documents", None), (6, "twice the same row of words in the table of documents", None), (7, " \t\n", "q")]
    docs = spark.createDataFrame([(i, t, None, s, None, 0.5, 3, i, "r", None) for i, t, s in texts], COLUMNS)
    docs.write.parquet(f"file://{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(1, 1), (5, 1), (6, 1), (None, 0), (2, None)], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/a/labels.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}/a").collect()
    bodies = dict((i, t) for i, t, _ in texts)
    assert {r.doc_id for r in got} <= {1, None, 5, 6}
    assert 5 in {r.doc_id for r in got}
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256(bodies[r.doc_id].encode()).hexdigest()
        assert r.n_tokens == len(r.token_ids) > 0
    # Copies go, and no document is taken more often than the mix allows.
    assert max(Counter(r.doc_id for r in got).values()) <= mixing.MOST_COPIES
    docs.limit(0).write.parquet(f"file://{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/b").collect() == []
