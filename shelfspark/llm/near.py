"""Near-dedup of the pipeline: word shingles, Jaccard similarity of at least 4/5, every link verified.

A document is the set of its shingles of five words (A-Z lower-cased, split at ASCII white space), as 64-bit hashes. Rows
with equal sets are merged. Sets that agree in a band of MinHash values share a bucket. In buckets of at most SMALL sets
all pairs are candidates. In larger ones each set is first paired with one chosen by hash (by one of two, so that bands
with the same sets give few different pairs), which joins most near copies into one class. Where a bucket then still holds several classes, its sets are dealt to blocks of
bounded size, by class, and in each pair of blocks that aren't of one class alone, sets of different classes are compared
until none is left: the classes are those that all pairs of the bucket would give. Every link is verified by the exact
Jaccard similarity of the sets. A pair with similarity s shares a bucket with probability 1 - (1 - s^ROWS)^BANDS, which is
0.998 at 0.8; nothing else is lost.

Why not fingerprints: at similarity 0.8 SimHash fingerprints of 64 bits differ in about 10 bits, and at a radius of 14 or
more population counts rule out next to no tile pairs.

Edge cases: texts with fewer words than a shingle are one shingle; null and blank texts have the empty set and are copies
of each other; null ids come last; of equal ids an earlier row stays; all columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import materialise, small_batches
from shelfspark.llm.components import components
from shelfspark.llm.simhash import shingle_hashes

SHINGLE = 5
#: Least Jaccard similarity, as a fraction.
NUM, DEN = 4, 5
BANDS, ROWS = 16, 5
#: Sets in a bucket up to which all pairs are candidates.
SMALL = 32
#: A block of a larger bucket has at most so many sets, and (but for its last set) bytes of shingles.
BLOCK_SETS, BLOCK_BYTES = 128, 4 << 20
#: Numbers of rows (8 bytes each) are broadcast up to so many, and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: Shingles of which MinHash values are taken at once.
HASH_ROWS = 1 << 13

_draw = np.random.default_rng(42)
FACTORS, TERMS = _draw.integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """The bucket of a set in each band; the empty set has buckets of its own."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), HASH_ROWS):
        mixed = hashes[at : at + HASH_ROWS, None] * FACTORS + TERMS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0))
    return [xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def add_sets(df: DataFrame, text: str) -> DataFrame:
    """Add __row (in the order of the rows), __set (a hash of the set), __shingles (its sorted hashes) and __keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            names, sets, keys = [], [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                hashes = np.unique(shingle_hashes(t, SHINGLE))
                sets.append(hashes.tobytes())
                names.append(xxhash.xxh64_intdigest(sets[-1]) - (1 << 63))
                keys.append(band_keys(hashes))
            rows = np.arange(number, number + batch.num_rows)
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows), pa.array(names, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "__row", "__set", "__shingles", "__keys"])

    schema = T.StructType([*df.schema.fields, T.StructField("__row", T.LongType()), T.StructField("__set", T.LongType()), T.StructField("__shingles", T.BinaryType()), T.StructField("__keys", T.ArrayType(T.LongType()))])
    return df.select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * shared >= NUM * (len(x) + len(y) - shared)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets with `near`: whether they have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similar(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], names=["a", "b", "near"])

    left, right = sets.select(F.col("__set").alias("a"), F.col("__shingles").alias("x")), sets.select(F.col("__set").alias("b"), F.col("__shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, near boolean")


def _small(numbers: DataFrame) -> DataFrame:
    """Numbers of rows, to be broadcast if they are few."""
    return F.broadcast(numbers) if numbers.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else numbers


def _between(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """Links between sets of different classes in a pair of blocks (or within one block), enough to join what is linked."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in part["x"]]
    names, side = part["node"].to_numpy(), part["side"].to_numpy()
    _, root = np.unique(part["root"].to_numpy(), return_inverse=True)
    own, other = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if (side == 1).any() else (np.arange(len(sets)),) * 2
    sizes, found = np.array([len(x) for x in sets]), []
    for i in own:
        # The larger of two similar sets has at most DEN / NUM times the shingles of the smaller one.
        fits = (NUM * sizes[other] <= DEN * sizes[i]) & (NUM * sizes[i] <= DEN * sizes[other])
        for j in other[fits]:
            if root[i] == root[j]:
                continue
            shared = np.searchsorted(sets[j], sets[i])
            shared = int((sets[j][np.minimum(shared, sizes[j] - 1)] == sets[i]).sum()) if sizes[j] else 0
            if DEN * shared >= NUM * (sizes[i] + sizes[j] - shared):
                found.append((min(names[i], names[j]), max(names[i], names[j])))
                root[root == root[j]] = root[i]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _rest(many: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """The links that classes `roots` lack to join what is similar within the large buckets `many` (key, node, bytes)."""
    held = many.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kinds = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.min("node").alias("least"))
    # Bands often put the same sets together; each such bucket is gone through once.
    mixed = kinds.filter("low < high").groupBy("n", "sum", "least").agg(F.min("key").alias("key")).select("key")
    order = Window.partitionBy("key").orderBy("root", "node").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.greatest(F.col("bytes"), F.lit(BLOCK_BYTES // BLOCK_SETS)).cast("long")
    placed = held.join(mixed, "key", "left_semi").withColumn("block", F.floor(F.coalesce(F.sum(weight).over(order), F.lit(0)) / BLOCK_BYTES)).select("key", "node", "root", "block")
    placed = materialise(placed)
    blocks = placed.groupBy("key", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    other = blocks.select("key", F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = materialise(blocks.join(other, "key").filter("block <= block2 AND least(low, low2) < greatest(high, high2)").select("key", "block", "block2"))
    left = pairs.join(placed, ["key", "block"]).select("key", "block", "block2", "node", "root", F.lit(0).alias("side"))
    right = pairs.filter("block < block2").join(placed.withColumnRenamed("block", "block2"), ["key", "block2"]).select("key", "block", "block2", "node", "root", F.lit(1).alias("side"))
    rows = left.unionByName(right).join(sets.select(F.col("__set").alias("node"), F.col("__shingles").alias("x")), "node")
    return rows.groupBy("key", "block", "block2").applyInPandas(_between, "a long, b long")


def links(rows: DataFrame) -> DataFrame:
    """Rows (__row, __set, __shingles, __keys), a written table, to pairs (a, b) of sets that join exactly those which verified
    links within buckets join."""
    one = rows.groupBy("__set").agg(F.min("__row").alias("__row"))
    members = rows.join(one.select("__row"), "__row", "left_semi").select(F.col("__set").alias("node"), F.length("__shingles").alias("bytes"), F.posexplode("__keys").alias("band", "key"))
    crowd = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = materialise(members.join(crowd, "key"))
    wanted = materialise(members.select(F.col("node").alias("__set")).distinct().join(one, "__set").select("__row"))
    sets = materialise(rows.select("__row", "__set", "__shingles").join(_small(wanted), "__row", "left_semi").drop("__row"))
    few = members.filter(F.col("size") <= SMALL).select("key", F.col("node").alias("a"))
    all_pairs = few.join(few.select("key", F.col("a").alias("b")), "key").filter("a < b").select("a", "b")
    many = members.filter(F.col("size") > SMALL).select("key", "node", "band", "bytes")
    chosen = many.groupBy("key").agg(F.min_by("node", F.struct(F.xxhash64("node", F.col("band") % 2), "node")).alias("chosen"))
    starred = many.join(chosen, "key").filter("node != chosen").select(F.least("node", "chosen").alias("a"), F.greatest("node", "chosen").alias("b"))
    checked = verify(all_pairs.unionByName(starred).distinct(), sets)
    found = materialise(checked.filter("near").select("a", "b"))
    if many.isEmpty():
        return found
    roots = components(found)
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a != b").unionByName(materialise(_rest(many, roots, sets)))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` without those whose class of near copies holds a row with a smaller id."""
    rows = materialise(add_sets(small_batches(df), text))
    roots = components(links(rows.select("__row", "__set", "__shingles", "__keys")))
    place = F.struct(F.col(f"`{doc_id}`").isNull().alias("unknown"), F.col(f"`{doc_id}`").alias("id"), F.col("__row").alias("row"))
    slim = rows.select("__row", "__set", place.alias("place"))
    within = materialise(slim.join(roots, F.col("__set") == F.col("node"), "left").select("__row", F.coalesce("root", "__set").alias("root"), "place"))
    stays = within.groupBy("root").agg(F.min("place").alias("first"))
    gone = materialise(within.join(stays, "root").filter(F.col("__row") != F.col("first.row")).select("__row"))
    return rows.join(_small(gone), "__row", "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
