"""Hard-negative mining with exact scores from Kronecker-packed products.

Components are quantised to floor(256 x). A tile of candidates is packed once and written: for each dimension, the
candidates' components, biased so that none is negative, stand in separated fields of one wide integer. An anchor's
components are biased too; each multiplies its dimension's wide integer once, and the sum of the products has the inner
products of all candidates in its fields, which are wide enough that none runs into the next. What the biases add is known
and taken off after unpacking, so scores are exact.

Anchors are dealt to blocks and tiles to strips, all of bounded size and by hash of the row, so no label is a group of its
own. A first pass over pairs of a block and a strip finds each anchor's positives: its best rows of the same label. A second
one finds for each positive the best rows of other labels whose score lies between `margin` of the positive's and all of it.
A pair of block and strip gives at most k rows for each anchor (and positive), which are merged by ordinary windows. Scores
are computed once in each pass; keeping them instead would take a row for each pair of an anchor and a candidate.

Edge cases: rows with a null id, a null label, a null vector or a null or non-finite component take no part; shorter
vectors count as padded with zeros; repeated rows are anchors and candidates each by itself, and rows with the anchor's id
are never its positives or negatives; fewer rows than asked for give what there is, and an anchor without positives or a
positive without negatives gives no row; a positive of negative score has no negatives, one of score 0 those of score 0;
ties go to the smaller id. Components and scores beyond 64 bits count as the nearest number of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import materialise

SCALE, ANCHOR_EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 5
#: A negative's score is at least so many hundredths of the positive's.
MARGIN = 80
#: Candidates of a tile, tiles of a strip, and anchors of a block, on average.
TILE, STRIP, BLOCK = 2_048, 16, 2_048
#: Bytes of a field, and the inner products that it holds. Up to 8 bytes numpy reads them at once, and with signs.
WIDTHS = {2: 1 << 16, 4: 1 << 32, 8: 1 << 61, 16: 1 << 128, 32: 1 << 256}
LONG = (-(1 << 63), (1 << 63) - 1)


def field_width(low: int, high: int, dims: int) -> int:
    """Bytes that hold the inner product of `dims` biased components from 0 to high - low each."""
    most = dims * (high - low) ** 2
    return next(w for w, limit in WIDTHS.items() if most < limit)


def pack(v: np.ndarray, low: int, width: int) -> list[bytes]:
    """For each dimension the biased components of all rows of `v`, in fields of `width` bytes."""
    if width <= 8:
        return [(column - low).astype(f"<u{width}").tobytes() for column in v.T]
    return [b"".join((int(x) - low).to_bytes(width, "little") for x in column) for column in v.T]


class Tile:
    """Candidates whose components stand in wide integers, one for each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, packed: list[bytes], low: int, width: int):
        self.ids, self.labels, self.low, self.width = ids, labels, low, width
        self.wide = [int.from_bytes(x, "little") for x in packed]
        #: Of each candidate the sum of its biased components.
        self.sums = self._unpacked(sum(self.wide))

    def _unpacked(self, wide: int) -> np.ndarray:
        data = wide.to_bytes(len(self.ids) * self.width, "little")
        if self.width <= 8:
            return np.frombuffer(data, dtype=f"<u{self.width}").astype(np.int64)
        return np.array([int.from_bytes(data[i : i + self.width], "little") for i in range(0, len(data), self.width)], dtype=object)

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Exact inner products of `anchor` with all candidates. With a + A and c + B as the biased components, the fields hold
        the sums of (a + A)(c + B), which exceed those of a * c by A times the sum of (c + B) and B times the sum of a."""
        bias = -self.low
        total = sum((a + bias) * w for a, w in zip(anchor, self.wide, strict=True))
        out = self._unpacked(total) - bias * self.sums - bias * sum(anchor)
        return out if out.dtype != object else np.array([min(max(x, LONG[0]), LONG[1]) for x in out], dtype=np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores and their ids, ties by smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = scores >= least
        scores, ids = scores[kept], ids[kept]
    order = np.lexsort((ids, ~scores))[:k]
    return scores[order], ids[order]


def quantised(df: DataFrame, vec_id: str, label: Column, vector: str, scale: int) -> DataFrame:
    """vec_id, label and the integer vector of the rows that take part."""
    x = F.col(f"`{vector}`")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"), whole.alias("whole"))
    return rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND whole").drop("whole")


def _dealt(row: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(parts)).cast("int")


def _tiles(group: pd.DataFrame, low: int, width: int) -> Iterator[Tile]:
    for r in group.itertuples(index=False):
        yield Tile(np.array(r.ids, dtype=np.int64), np.array(r.labels, dtype=np.int64), list(r.packed), low, width)


class Search:
    """Packed tiles of all rows that take part, and the anchors among them."""

    def __init__(self, vectors: DataFrame, every: int, tile: int = TILE, strip: int = STRIP, block: int = BLOCK):
        """`vectors`: vec_id, label (long) and v (array of long)."""
        rows = materialise(vectors.withColumn("row", F.monotonically_increasing_id()))
        anchor = F.col("vec_id") % every == 0
        low, high, n, anchors, dims = rows.agg(
            F.coalesce(F.min(F.array_min("v")), F.lit(0)), F.coalesce(F.max(F.array_max("v")), F.lit(0)), F.count("*"), F.count_if(anchor), F.coalesce(F.max(F.size("v")), F.lit(0))
        ).first()
        # Shorter vectors are padded with zeros, so 0 must have its place between the bounds.
        low, high = min(low, 0), max(high, 0)
        tiles, blocks = max(1, -(-n // tile)), max(1, -(-anchors // block))
        strips = max(1, -(-tiles // strip))
        width = field_width(low, high, max(1, dims))

        def packed(key: tuple[int], group: pd.DataFrame) -> pd.DataFrame:
            v = np.zeros((len(group), dims), dtype=np.int64)
            for i, r in enumerate(group["v"]):
                v[i, : len(r)] = r
            wide = pack(v if width <= 8 else v.astype(object), low, width)
            return pd.DataFrame({"strip": [key[0] % strips], "ids": [group["vec_id"].to_numpy()], "labels": [group["label"].to_numpy()], "packed": [wide]})

        self.low, self.width, self.dims = low, width, dims
        self.tiles = materialise(rows.groupBy(_dealt("row", tiles).alias("tile")).applyInPandas(packed, "strip int, ids array<long>, labels array<long>, packed array<binary>"))
        self.tiles = self.tiles.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        self.anchors = rows.filter(anchor).withColumn("block", _dealt("row", blocks))
        self.every_strip = F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))

    def _met(self, anchors: DataFrame, meet, schema: str) -> DataFrame:
        left = anchors.withColumn("strip", self.every_strip)
        return left.groupBy("block", "strip").cogroup(self.tiles.groupBy("block", "strip")).applyInPandas(meet, schema)

    def positives(self, k: int) -> DataFrame:
        """row (of the anchor), place (from 1), positive_id, positive_score."""
        low, width, dims = self.low, self.width, self.dims

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = []
            for tile in _tiles(right, low, width):
                for row, own, label, v in zip(left["row"], left["vec_id"], left["label"], left["v"], strict=True):
                    at = np.flatnonzero((tile.labels == label) & (tile.ids != own))
                    if len(at):
                        found.append((row, *best(tile.scores(_padded(v, dims))[at], tile.ids[at], k)))
            return _rows(found, ["row"], ["positive_score", "positive_id"])

        met = self._met(self.anchors.select("row", "vec_id", "label", "v", "block"), meet, "row long, positive_id long, positive_score long")
        order = Window.partitionBy("row").orderBy(F.col("positive_score").desc(), "positive_id")
        return met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)

    def negatives(self, positives: DataFrame, k: int, margin: int) -> DataFrame:
        """row, place (of the positive), rank (from 1), negative_id, negative_score."""
        low, width, dims = self.low, self.width, self.dims

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = []
            for tile in _tiles(right, low, width):
                for row, own, label, v, places, tops in zip(left["row"], left["vec_id"], left["label"], left["v"], left["places"], left["tops"], strict=True):
                    ranges = [(place, -(-margin * int(p) // 100), int(p)) for place, p in zip(places, tops, strict=True) if p >= 0]
                    if not ranges:
                        continue
                    scores = tile.scores(_padded(v, dims))
                    other = (tile.labels != label) & (tile.ids != own)
                    at = np.flatnonzero(other & (scores >= min(r[1] for r in ranges)) & (scores <= max(r[2] for r in ranges)))
                    for place, least, most in ranges:
                        held = at[(scores[at] >= least) & (scores[at] <= most)]
                        if len(held):
                            found.append((row, place, *best(scores[held], tile.ids[held], k)))
            return _rows(found, ["row", "place"], ["negative_score", "negative_id"])

        each = positives.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("found"))
        asked = self.anchors.select("row", "vec_id", "label", "v", "block").join(each, "row").withColumns({"places": F.col("found.place"), "tops": F.col("found.positive_score")}).drop("found")
        met = self._met(asked, meet, "row long, place int, negative_id long, negative_score long")
        order = Window.partitionBy("row", "place").orderBy(F.col("negative_score").desc(), "negative_id")
        return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _padded(v: np.ndarray, dims: int) -> list[int]:
    return [int(x) for x in v] + [0] * (dims - len(v))


def _rows(found: list[tuple], keys: list[str], values: list[str]) -> pd.DataFrame:
    """Tuples of keys followed by arrays of equal length, as rows."""
    number = [len(x[-1]) for x in found]
    out = {k: np.repeat(np.array([x[i] for x in found], dtype=np.int64), number) for i, k in enumerate(keys)}
    for i, k in enumerate(values, len(keys)):
        out[k] = np.concatenate([x[i] for x in found]) if found else np.zeros(0, dtype=np.int64)
    return pd.DataFrame(out)


def mine(
    df: DataFrame, vec_id: str = "vec_id", label: str | Column = "label", vector: str = "embedding", scale: int = SCALE, every: int = ANCHOR_EVERY,
    positives: int = POSITIVES, negatives: int = NEGATIVES, margin: int = MARGIN, tile: int = TILE, strip: int = STRIP, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the anchors, rows whose id is divisible by
    `every`: for each of its `positives` best rows of the same label, the `negatives` best rows of other labels."""
    kind = F.col(f"`{label}`") if isinstance(label, str) else label
    search = Search(quantised(df, vec_id, kind, vector, scale), every, tile, strip, block)
    found = materialise(search.positives(positives))
    mined = search.negatives(found, negatives, margin)
    ids = search.anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return mined.join(found, ["row", "place"]).join(ids, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
