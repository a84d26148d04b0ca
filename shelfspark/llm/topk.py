"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Components are quantised to floor(64 x). A tile of candidates keeps its postings (dimension, candidate, value) in segments
by the octave of the value's size, and within an octave quantised to quarters of it. Segments are processed by descending
impact for a block of queries at once. After each, the rest of a candidate's vector that hasn't been processed bounds its
score from both sides (Cauchy-Schwarz). Candidates whose upper bound is below the k-th lower bound are out by proof;
processing stops when the possible members are few, or nothing is left, and these are rescored exactly.

Edge cases: vectors that are null, hold null or non-finite components, or have no id take no part; shorter vectors count
as padded with zeros; repeated rows are candidates (and queries) each by itself; all rows with the query's id are its own;
fewer candidates than k give them all; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import materialise

K, QUERY_EVERY, SCALE = 20, 20, 64
CANDIDATE_ROWS, QUERY_ROWS = 8_192, 512
#: Possible members of a query that are few enough to be rescored.
FEW = 64


def quantised(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and the integer vector of the rows that take part."""
    x = F.col(f"`{vector}`")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    return df.filter(F.col(f"`{vec_id}`").isNotNull() & x.isNotNull()).filter(fine).select(F.col(f"`{vec_id}`").alias("vec_id"), ints.alias("v"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def segments(v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By descending impact: the quantised postings of a segment as a matrix, and what is then left of the vectors."""
    rest, size = v.copy(), np.abs(v)
    level = 1 << int(size.max()).bit_length() >> 1 if size.size and size.max() else 0
    while level:
        held = np.where(np.abs(rest) >= level, rest, 0)
        step = max(1, level // 4)
        held = np.sign(held) * (np.abs(held) // step * step)
        rest = rest - held
        yield held, rest
        level //= 2


def search_tile(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, row of the candidate and exact score of each query's k best candidates in the tile."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    kind = np.float32 if bound < 1 << 22 else np.float64 if bound < 1 << 51 else np.int64
    if kind is np.int64 or k >= len(ids):
        possible = np.ones((len(q), len(ids)), dtype=bool)
    else:
        qf, score = q.astype(kind), np.zeros((len(q), len(ids)), dtype=kind)
        q_size = np.sqrt((qf.astype(np.float64) ** 2).sum(axis=1))
        own, possible = q_ids[:, None] == ids[None, :], None
        for held, rest in segments(v):
            score += qf @ held.T.astype(kind)
            slack = np.outer(q_size, np.sqrt((rest.astype(np.float64) ** 2).sum(axis=1))).astype(kind) * kind(1.0001)
            low = np.where(own, -np.inf, score - slack)
            least = -np.partition(-low, k - 1, axis=1)[:, k - 1 : k]
            possible = score + slack >= least
            if possible.sum() <= FEW * len(q):
                break
        if possible is None:  # nothing but zeros
            possible = np.ones((len(q), len(ids)), dtype=bool)
        possible &= ~own
    possible &= q_ids[:, None] != ids[None, :]
    out = []
    for i in range(len(q)):
        at = np.flatnonzero(possible[i])
        exact = v[at] @ q[i]
        best = np.lexsort((ids[at], -exact))[:k]
        out.append((np.full(len(best), i), at[best], exact[best]))
    return tuple(np.concatenate(x) if out else np.zeros(0, dtype=np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 3


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Quantised vectors to query_id, rank, vec_id, score. Queries (ids divisible by `every`) in blocks meet candidates in
    tiles; each pair of a block and a tile is one bounded group, and its k best rows of each query go on."""
    rows = materialise(vectors)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    shape = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    tiles, blocks, width = max(1, -(-shape[0] // candidate_rows)), max(1, -(-shape[1] // query_rows)), shape[2]
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    queries = rows.filter(F.col("vec_id") % every == 0).select("row", "vec_id", "v", part(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    candidates = rows.select("row", "vec_id", "v", part(tiles).alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b, s = search_tile(left["vec_id"].to_numpy(), _matrix(left["v"], width), right["vec_id"].to_numpy(), _matrix(right["v"], width), k)
        return pd.DataFrame({"row": left["row"].to_numpy()[a], "query_id": left["vec_id"].to_numpy()[a], "vec_id": right["vec_id"].to_numpy()[b], "score": s})

    found = queries.groupBy("block", "tile").cogroup(candidates.groupBy("block", "tile")).applyInPandas(search, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
