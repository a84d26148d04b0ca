"""Queries over the given tables for each operator, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import bpe, chat, katz, licenses, lines, lsm, mixing, negatives, quality, runs, simhash, topk, toxicity
from shelfspark.llm.common import WORD, fold, materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.encode_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, decoded="decoded").drop("text")
    ids = F.array_join(F.col("token_ids"), ",")
    return decoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.allocate(materialise(mixing.measure(docs).drop("text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) AS draw
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
named AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM sizes),
ordered AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest,
    sum(source_size) OVER () AS all_words
  FROM named WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (CAST(1.5 AS DOUBLE) * CAST(all_words AS DOUBLE) - CAST(full_before AS DOUBLE)) / CAST(rest AS DOUBLE) AS level FROM ordered),
reached AS (SELECT *, max(level) OVER () AS reach FROM levels),
plan AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), reach * weight) AS target FROM reached),
cells AS (
  SELECT d.source, length(bin(d.size)) AS bits, CAST(sum(d.size) AS DOUBLE) AS words, any_value(p.source_size) AS source_size, any_value(p.target) AS target
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source GROUP BY ALL),
tilted AS (
  SELECT *, (target - 2 * coalesce(sum(words) OVER longer, 0))
    / nullif(sum((8 + bits) * words) OVER (PARTITION BY source) - coalesce(sum((8 + bits) * words) OVER longer, 0), 0) AS level
  FROM cells WINDOW longer AS (PARTITION BY source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
expected AS (
  SELECT *, CASE WHEN target >= 2 * source_size THEN CAST(2 AS DOUBLE)
    ELSE least(CAST(2 AS DOUBLE), coalesce(max(level) OVER (PARTITION BY source) * (8 + bits), 0)) END AS expected
  FROM tilted),
chances AS (
  SELECT *, floor(expected) AS whole, nullif(expected - floor(expected), 0) AS p, target - sum(floor(expected) * words) OVER (PARTITION BY source) AS missing
  FROM expected),
drawn AS (
  SELECT d.*, c.source_size, c.target, c.whole, c.missing, (CAST(d.draw AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u, c.p
  FROM docs d JOIN chances c ON d.source IS NOT DISTINCT FROM c.source AND length(bin(d.size)) = c.bits),
ranked AS (
  SELECT *, CASE WHEN size > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS odds FROM drawn),
placed AS (
  SELECT *, sum(CASE WHEN odds IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY odds NULLS LAST, draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS words_before
  FROM ranked)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN odds IS NOT NULL AND missing > 0 AND CAST(2 * words_before + size AS DOUBLE) <= 2 * missing THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm.dedup_exact(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
WITH docs AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(translate(coalesce(text, ''), E' \t\n\x0b\x0c\r', '')) AS text_sha256
  FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER best AS place
  FROM docs WINDOW best AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM ranked
"""


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(_table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.select("doc_id", F.size("licenses").alias("n_finds"), F.array_join(F.array_sort(F.array_distinct("licenses.license")), ",").alias("found"), "licenses")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality.classify(docs, net).drop("text")
    return scored.select("doc_id", (fold(F.col("doc_id"), quality.FOLDS) == quality.HELD_OUT).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


#: The conversations hold no tool calls, so turns stand for them: a user's turn calls the tool "reply" and needs the user's
#: turn before it; the assistant's next turn is the result.
REPLY = {"reply": {"type": "object", "properties": {"prompt": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["prompt", "turn"], "additionalProperties": False}}


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").withColumn("turn", F.col("turn").cast("long"))
    name = lambda turn: F.concat(F.lit("turn-"), turn.cast("string"))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))
    calls = turns.filter("role = 'user'").select("conv_id", F.col("turn").alias("position"), name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("position"), name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return chat.link_calls(calls, results, REPLY)


OP8_SQL = r"""
WITH turns AS (SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations),
calls AS (SELECT * FROM turns WHERE role = 'user'),
answers AS (
  SELECT c.conv_id, c.turn, min(r.text) AS result, count(r.turn) > 0 AS linked
  FROM calls c LEFT JOIN turns r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND r.role = 'assistant' GROUP BY ALL),
linked AS (
  SELECT c.conv_id, c.turn, 'turn-' || c.turn AS call_id, CASE WHEN a.linked THEN 'linked' ELSE 'pending' END AS status, c.text, a.result
  FROM calls c JOIN answers a ON a.conv_id = c.conv_id AND a.turn = c.turn),
orphans AS (
  SELECT r.conv_id, r.turn, 'turn-' || (r.turn - 1) AS call_id, r.text AS result FROM turns r
  WHERE r.role = 'assistant' AND NOT EXISTS (FROM calls c WHERE c.conv_id = r.conv_id AND c.turn = r.turn - 1))
SELECT conv_id, turn AS order_key, CAST(0 AS INTEGER) AS order_step, turn AS "position", call_id, status, CAST(NULL AS VARCHAR) AS error,
  '{"arguments":{"prompt":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '},"depends_on":['
  || CASE WHEN turn >= 2 THEN '"turn-' || (turn - 2) || '"' ELSE '' END || '],"id":"' || call_id || '","name":"reply","result":'
  || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || ',"status":"' || status || '"}' AS message
FROM linked
UNION ALL
SELECT conv_id, turn, CAST(0 AS INTEGER), turn, call_id, 'orphan', CAST(NULL AS VARCHAR),
  '{"id":"' || call_id || '","result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || ',"status":"orphan"}'
FROM orphans
"""


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=1)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(_table(spark, sf_dir, "embeddings")))


OP10_SQL = r"""
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 20
"""


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings"), label=moved)


OP11_SQL = r"""
WITH valid AS (
  SELECT row_number() OVER () AS place, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.place, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM valid a JOIN valid c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS number FROM scored WHERE same
  QUALIFY number <= 5),
pairs AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.place, p.number ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON n.place = p.place AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM pairs WHERE rank <= 5
"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.classify(docs, lexicon).drop("text")
    held_out = fold(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("hits").alias("n_hits"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words, g = F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.floor(hashed / 10)
    n = F.size("words").cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    repeated = F.array_join(F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.element_at("words", (a + (i - a) % p + 1).cast("int")))), " ")
    # Only every tenth text is split here; the others go on as they are.
    planted = docs.withColumn("words", F.when(hashed % 10 == 0, words)).withColumn("text", F.when(n > 0, repeated).otherwise(F.col("text"))).drop("words")
    found = runs.periodic_runs(planted).drop("text")
    order = F.expr("array_sort(runs, (a, b) -> CASE WHEN a.length <> b.length THEN CAST(sign(b.length - a.length) AS INT) WHEN a.start <> b.start THEN CAST(sign(a.start - b.start) AS INT) ELSE CAST(sign(a.period - b.period) AS INT) END)")
    best = F.get(order, F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_mix": op3_mix,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_katz": op5_katz,
    "op6_licenses": op6_licenses,
    "op7_quality": op7_quality,
    "op8_chat": op8_chat,
    "op9_lines": op9_lines,
    "op10_topk": op10_topk,
    "op11_negatives": op11_negatives,
    "op12_toxicity": op12_toxicity,
    "op13_runs": op13_runs,
}

ORACLE_SQL = {"op3_mix": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op8_chat": OP8_SQL, "op10_topk": OP10_SQL, "op11_negatives": OP11_SQL}
