"""From documents to token ids: quality, line dedup, near-dedup, mix, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that it is given and returns a frame with the columns of
documents, except the last, which returns token ids. `run` writes each stage's result as Parquet in the shared scratch
folder and reads it again as the next stage's input.

Edge cases: null and blank texts count as empty, are scored like others, and have no words for the mix to take; of rows
with equal text one stays, the one with the smallest id, and null ids come last; a text is one row throughout, however
long; without labels all documents have score 0.5 and stay; an empty table gives an empty result; further columns pass
through up to the last stage, whatever their names, which returns its own columns alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import bpe, lines, mixing, quality, simhash
from shelfspark.llm.common import materialise, written

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows outside its held-out fold, rejects go."""
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.classify(docs, net, out="__score")
    return scored.filter(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that resemble an earlier one go; n_chars follows the text."""
    kept = written(lambda: lines.dedup_lines(docs, min_words=1))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of SimHash fingerprints (at most 3 of 64 bits apart) the document with the smallest id stays."""
    return written(lambda: simhash.keep_one(docs).select(*docs.columns))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, which may be never."""
    return mixing.expand(mixing.mix_sources(docs)).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and digests of ids and decoded bytes."""
    decoded = bpe.encode_documents(docs.select("doc_id", "source", "text"), VOCABULARY, PATTERN, decoded="decoded").drop("text")
    ids = F.array_join("token_ids", ",")
    return decoded.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", distinct_lines),
    ("SimHash near-dedup", one_of_each),
    ("mixing sources to target weights", to_weights),
    ("byte-level BPE encoding and decoding", to_tokens),
]

#: The first stage is a network, which SQL can't express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
