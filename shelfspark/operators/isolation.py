"""Isolation forest (Liu, Ting and Zhou 2008): each tree isolates the points of a small sample by random cuts.

A bounded sample of rows, those that hash lowest, is dealt to the trees; each tree is built in a group of its own. Scoring
is a vectorised map over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.selection import exact_quantiles

TREES, SAMPLE, DEPTH, CONTAMINATION, SEED = 400, 256, 8, 0.05, 42
NODES = 2 ** (DEPTH + 1) - 1
#: Rows that walk through a tree at once.
SCORED = 1 << 13
MODEL = "tree int, feature array<int>, threshold array<double>, path array<double>, sampled int"


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe))


def grow(x: np.ndarray, tree: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, thresholds (go right at or above) and, at leaves, path lengths."""
    rng = np.random.default_rng((SEED, tree))
    feature, threshold, path = np.zeros(NODES, dtype=np.int32), np.full(NODES, np.inf), np.zeros(NODES)
    node = np.zeros(len(x), dtype=np.int64)
    for level in range(depth + 1):
        for k in range(2**level - 1, 2 ** (level + 1) - 1):
            own = x[node == k]
            spread = np.ptp(own, axis=0) if len(own) else np.zeros(x.shape[1])
            path[k] = level + float(average_path(len(own)))
            if level < depth and len(own) > 1 and spread.max() > 0:
                feature[k] = rng.choice(np.flatnonzero(spread > 0))
                low, high = own[:, feature[k]].min(), own[:, feature[k]].max()
                threshold[k] = rng.uniform(low, high)
                if threshold[k] <= low:
                    threshold[k] = high
        if level < depth:
            inner = np.isfinite(threshold[node]) & (node >= 2**level - 1)
            node = np.where(inner, 2 * node + 1 + (x[np.arange(len(x)), feature[node]] >= threshold[node]), node)
    return feature, threshold, path


def fit(rows: DataFrame, features: list[str], key: list[str], trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Rows to a table of trees. At most trees * sample rows are used; with fewer, rows serve several trees."""
    wanted = rows.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.xxhash64(*key).alias("h")).na.drop()
    picked = wanted.orderBy("h", *[f"x{i}" for i in range(len(features))]).limit(trees * sample)
    n = max(1, picked.count())
    times = -(-trees * sample // n)
    dealt = picked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("tree", F.pmod(F.xxhash64("h", "copy"), F.lit(trees)).cast("int"))

    def build(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        columns = [f"x{i}" for i in range(len(features))]
        part = part.sort_values(["h", "copy", *columns]).drop_duplicates(["h", *columns]).head(sample)
        f, t, p = grow(part[columns].to_numpy(), int(group[0]))
        return pd.DataFrame({"tree": [group[0]], "feature": [f.tolist()], "threshold": [t.tolist()], "path": [p.tolist()], "sampled": [len(part)]})

    return dealt.groupBy("tree").applyInPandas(build, MODEL)


class Forest:
    """All trees as arrays. Leaves above the greatest depth of these trees are led to its leftmost node, so every walk has
    equal length."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["tree"])
        self.feature = np.array([r["feature"] for r in rows], dtype=np.int64)
        self.threshold = np.array([r["threshold"] for r in rows])
        self.path = np.array([r["path"] for r in rows])
        for k in range(NODES // 2):
            self.path[:, 2 * k + 1] = np.where(np.isfinite(self.threshold[:, k]), self.path[:, 2 * k + 1], self.path[:, k])
        inner = np.flatnonzero(np.isfinite(self.threshold).any(axis=0))
        self.depth = int(inner[-1] + 1).bit_length() if len(inner) else 0
        self.norm = float(np.mean([average_path(r["sampled"]) for r in rows])) or 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """-2^(-E[path] / c): near -1 for outliers."""
        out = np.empty(len(x))
        for a in range(0, len(x), SCORED):
            part = np.ascontiguousarray(x[a : a + SCORED].T)
            n, flat, row = part.shape[1], part.ravel(), np.arange(part.shape[1])
            total = np.zeros(n)
            for feature, threshold, path in zip(self.feature * n, self.threshold, self.path, strict=True):
                node = np.zeros(n, dtype=np.int64)
                for _ in range(self.depth):
                    value = flat.take(feature.take(node) + row)
                    value = value >= threshold.take(node)
                    node *= 2
                    node += 1
                    node += value
                total += path.take(node)
            out[a : a + n] = -(2.0 ** (-(total / len(self.path)) / self.norm))
        return out


def forest(model: DataFrame) -> Forest:
    return Forest(model.collect())


def score(rows: DataFrame, features: list[str], model: Forest | Broadcast, out: str = "raw_score") -> DataFrame:
    """Add the score; null where a feature is null."""
    shared = model if isinstance(model, Broadcast) else rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            x = np.stack([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in columns], axis=1)
            bad = np.isnan(x).any(axis=1)
            yield pd.Series(shared.value.score(np.where(bad[:, None], 0.0, x))).mask(bad)

    udf = F.pandas_udf(run, "double", functionType=F.PandasUDFType.SCALAR_ITER)
    return rows.withColumn(out, udf(*[F.col(c).cast("double") for c in features]))


def decision(scored: DataFrame, contamination: float = CONTAMINATION) -> tuple[DataFrame, float]:
    """Scores relative to their quantile at `contamination`, and that quantile."""
    offset = exact_quantiles(scored, "raw_score", [contamination])[0]
    return scored.withColumn("score", F.col("raw_score") - F.lit(offset)).drop("raw_score"), offset
