"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it; in each, every filter looks at all windows of WIDTH bytes (one
each STEP bytes) and keeps its strongest answer. Of these, the largest and the mean over a document's chunks are combined
into one probability. Fitting uses a bounded sample of labelled rows in one task; scoring is a narrow map over all rows.

Edge cases: a null text counts as empty; an empty text is one chunk of padding and gets a score like any other; labels
that are null or belong to no document are left out, repeated labels count repeatedly; without labels the score is 0.5
for all, with a single class it is near that class's share. Other columns pass through; those with the name of a result
are replaced. Score and fit read the text alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import fold, small_batches

#: Windows of WIDTH bytes, one each STEP bytes; a chunk shares its last STEP bytes with the next one.
WIDTH, STEP, CHUNK = 8, 4, 1024
DIMS, FILTERS = 6, 16
#: At most so many labelled rows of each class are learned from.
ROWS_0, ROWS_1 = 1200, 1800
STEPS, BATCH, RATE, SEED = 500, 64, 0.01, 5
#: Learned from: rows outside this fold.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Chunks that go through the network at once.
CHUNKS_AT_ONCE = 512

BLOCKS = CHUNK // STEP
SHARED = (BLOCKS - 1) * STEP


def chunks(data: bytes) -> np.ndarray:
    """Rows of CHUNK bytes, one each SHARED bytes, padded with zeros."""
    n = max(1, -(-(len(data) - STEP) // SHARED))
    padded = np.zeros((n - 1) * SHARED + CHUNK, dtype=np.uint8)
    padded[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (SHARED, 1)).copy()


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, DIMS)).astype(np.float32)
        self.filters = rng.normal(0, 1 / np.sqrt(WIDTH * DIMS), (WIDTH * DIMS, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.offset]

    def answers(self, rows: np.ndarray) -> np.ndarray:
        """Of each chunk, window and filter: the filter's answer before the rectifier."""
        half = STEP * DIMS
        blocks = self.embed[rows].reshape(-1, half)
        both = blocks @ np.concatenate((self.filters[:half], self.filters[half:]), axis=1)
        both = both.reshape(len(rows), BLOCKS, 2 * FILTERS)
        return both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:]

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        best = np.concatenate([self.answers(rows[i : i + CHUNKS_AT_ONCE]).max(axis=1) for i in range(0, len(rows), CHUNKS_AT_ONCE)])
        return np.maximum(best + self.bias, 0)

    def combine(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Pooled chunks and the first chunk of each document to the documents' log odds."""
        number = np.diff(np.append(first, len(pooled)))[:, None]
        features = np.concatenate((np.maximum.reduceat(pooled, first), np.add.reduceat(pooled, first) / number), axis=1)
        return features @ self.out + self.offset[0], features

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        parts = [chunks(t) for t in texts]
        first = np.cumsum([0, *[len(p) for p in parts[:-1]]])
        odds, _ = self.combine(self.pooled(np.concatenate(parts)), first)
        return 1 / (1 + np.exp(-odds.astype(np.float64)))


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, seed: int = SEED, steps: int = STEPS) -> Network:
    """Adam on the weighted log loss. Only the winning window of each chunk and filter gets a gradient."""
    net, rng = Network(seed), np.random.default_rng(seed)
    parts = [chunks(t) for t in texts]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    for _ in range(-(-steps // max(1, -(-len(texts) // BATCH)))):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            rows = np.concatenate([parts[i] for i in picked])
            first = np.cumsum([0, *[len(parts[i]) for i in picked[:-1]]])
            best, where = [], []
            for i in range(0, len(rows), CHUNKS_AT_ONCE):
                answers = net.answers(rows[i : i + CHUNKS_AT_ONCE])
                where.append(answers.argmax(axis=1))
                best.append(np.take_along_axis(answers, where[-1][:, None], axis=1)[:, 0])
            raw, where = np.concatenate(best) + net.bias, np.concatenate(where)
            pooled = np.maximum(raw, 0)
            odds, features = net.combine(pooled, first)
            error = ((1 / (1 + np.exp(-odds)) - labels[picked]) * weights[picked] / weights[picked].sum()).astype(np.float32)
            g_features = error[:, None] * net.out
            number = np.diff(np.append(first, len(rows)))
            doc = np.repeat(np.arange(len(picked)), number)
            largest = pooled == features[doc, :FILTERS]
            ties = np.add.reduceat(largest.astype(np.float32), first)[doc]
            g_pooled = g_features[doc, :FILTERS] * largest / ties + g_features[doc, FILTERS:] / number[doc][:, None]
            g_raw = (g_pooled * (raw > 0)).astype(np.float32)
            starts = where * STEP
            windows = rows[np.arange(len(rows))[:, None, None], starts[:, :, None] + np.arange(WIDTH)]
            seen = net.embed[windows].reshape(len(rows), FILTERS, WIDTH * DIMS)
            g_filters = np.einsum("cf,cfk->kf", g_raw, seen)
            g_seen = (g_raw[:, :, None] * net.filters.T[None]).reshape(-1, DIMS)
            g_embed = np.stack([np.bincount(windows.ravel(), weights=g_seen[:, d], minlength=256) for d in range(DIMS)], axis=1)
            gradients = [g_embed, g_filters, g_raw.sum(axis=0), features.T @ error, error.sum(keepdims=True)]
            step += 1
            for p, g, (m, v) in zip(net.parameters(), gradients, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", rows: tuple[int, int] = (ROWS_0, ROWS_1), steps: int = STEPS) -> Network:
    """Fit on at most `rows` labelled documents of class 0 and 1, outside the held-out fold: those whose ids hash lowest.

    Only ids of that bounded sample are broadcast; texts stay on the executors, and the driver gets the weights alone.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter((fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    shares = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    sample = [usable.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows[k]) for k in (0, 1)]
    picked = sample[0].unionByName(sample[1])
    texts = documents.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body")).join(F.broadcast(picked), "doc_id")
    share = [shares.get(k, 0) / max(1, min(shares.get(k, 0), rows[k])) for k in (0, 1)]

    def fit_sample(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "label", "body"])
        net = fit([b.encode("utf-8", "replace") for b in part["body"]], part["label"].to_numpy(), np.where(part["label"] == 1, share[1], share[0]), steps=steps)
        return pd.DataFrame({"weights": [pickle.dumps([p.tobytes() for p in net.parameters()])]})

    got = texts.groupBy(F.lit(0).alias("one")).applyInPandas(fit_sample, "weights binary").collect()
    net = Network()
    if not got:
        net.out[:] = 0
        return net
    for p, data in zip(net.parameters(), pickle.loads(got[0]["weights"]), strict=True):
        p[...] = np.frombuffer(data, dtype=p.dtype).reshape(p.shape)
    return net


def classify(df: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """Add `out` (double, 0 to 1) for the whole text of each row."""
    keep = [c for c in small_batches(df).columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [(t or "").encode("utf-8", "replace") for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(net.scores(texts), pa.float64())], names=[*keep, out])

    rows = df.select(*[F.col(f"`{c}`") for c in keep])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())]))
