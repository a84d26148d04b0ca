"""Exact dedup by a log-structured merge index of text digests.

Inserting a batch: each task keeps a memtable (digest -> best row, count) and flushes it as a run sorted by digest when it
is full. Runs lie in the shared scratch folder as Parquet, dealt over shards by digest. Of each run and shard a Bloom
filter is kept. Compaction merges runs: of each digest the best row stays (most code points, then smallest identifier) and
counts add up; digests of a new run that the old run's filter rules out skip the merge. A lookup joins rows with the
merged run; rows of digests that occur more than once are hits, whose bytes are compared with the text of the row that
stays, and texts that differ in spite of equal digests are grouped by their bytes.

Edge cases: a null text counts as empty; texts of white space alone equal the empty text; null ids are larger than all
others; repeated rows are copies of each other; an empty table gives an empty result; of the input's columns only the id is
in the result, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import SPACES, materialise, parallelism

MEMTABLE_ROWS = 100_000
#: Bits a digest, and bits set for each.
FILTER_BITS, FILTER_HASHES = 12, 6
#: Digests with copies are broadcast up to so many rows (of 32 bytes), and joined by shuffle beyond.
BROADCAST_DIGESTS = 100_000

RUN = "shard int, digest binary, points long, doc_id long, copies long"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACES, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _better(a: tuple, b: tuple) -> bool:
    """Whether row a stays rather than b; rows are (code points, id)."""
    return (-a[0], a[1] is None, a[1] or 0) < (-b[0], b[1] is None, b[1] or 0)


def flush_memtables(rows: DataFrame, shards: int, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Rows (digest, points, doc_id) to sorted runs: one row a digest and memtable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list] = {}

        def flush() -> pa.RecordBatch:
            items = sorted(table.items())
            table.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int.from_bytes(k[:4], "big") % shards for k, _ in items], pa.int32()),
                    pa.array([k for k, _ in items], pa.binary()),
                    pa.array([v[0] for _, v in items], pa.int64()),
                    pa.array([v[1] for _, v in items], pa.int64()),
                    pa.array([v[2] for _, v in items], pa.int64()),
                ],
                names=["shard", "digest", "points", "doc_id", "copies"],
            )

        for batch in batches:
            for digest, points, doc_id in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held = table.get(digest)
                if held is None:
                    table[digest] = [points, doc_id, 1]
                    if len(table) >= memtable_rows:
                        yield flush()
                    continue
                held[2] += 1
                if _better((points, doc_id), held):
                    held[:2] = points, doc_id
        if table:
            yield flush()

    return rows.select("digest", F.col("points").cast("long").alias("points"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, RUN)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Of each digest the best row and the sum of the counts."""
    best = F.min(F.struct((-F.col("points")).alias("fewer"), F.col("doc_id").isNull().alias("unknown"), "doc_id"))
    merged = runs.groupBy("shard", "digest").agg(best.alias("best"), F.sum("copies").alias("copies"))
    return merged.select("shard", "digest", (-F.col("best.fewer")).alias("points"), F.col("best.doc_id").alias("doc_id"), "copies")


def _positions(digests: list[bytes], bits: int) -> np.ndarray:
    """Bit positions of each digest, from its own bytes: they are evenly spread already."""
    words = np.frombuffer(b"".join(d[:16].ljust(16, b"\0") for d in digests), dtype="<u8").reshape(-1, 2)
    steps = np.arange(FILTER_HASHES, dtype=np.uint64)
    return ((words[:, :1] + steps * (words[:, 1:] | np.uint64(1))) % np.uint64(bits)).astype(np.int64)


def build_filters(run: DataFrame) -> DataFrame:
    """shard, bits: the Bloom filter of a run in each shard. A shard's part of a run is bounded by the number of shards."""

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        bits = max(64, -(-len(part) * FILTER_BITS // 64) * 64)
        held = np.zeros(bits, dtype=bool)
        held[_positions(list(part["digest"]), bits).ravel()] = True
        return pd.DataFrame({"shard": [key[0]], "bits": [np.packbits(held).tobytes()]})

    return run.select("shard", "digest").groupBy("shard").applyInPandas(build, "shard int, bits binary")


def may_hold(run: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows of `run` with `maybe`: False where the filter of the other run rules the digest out."""

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.copy()
        left["maybe"] = False
        if len(left) and len(right):
            held = np.unpackbits(np.frombuffer(right["bits"].iloc[0], dtype=np.uint8)).astype(bool)
            left["maybe"] = held[_positions(list(left["digest"]), len(held))].all(axis=1)
        return left

    return run.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe, f"{RUN}, maybe boolean")


class DigestIndex:
    """The index over all inserted batches: one merged run and its filters."""

    def __init__(self, memtable_rows: int = MEMTABLE_ROWS):
        self.memtable_rows, self.shards = memtable_rows, 0
        self.run: DataFrame | None = None
        self.filters: DataFrame | None = None
        #: Of each batch that dedup_exact inserted: its rows, and the frame that its texts are read from.
        self.batches: list[tuple[DataFrame, DataFrame]] = []

    def insert(self, rows: DataFrame) -> None:
        """Rows: digest, points, doc_id."""
        self.shards = self.shards or parallelism(rows.sparkSession)
        fresh = merge_runs(flush_memtables(rows, self.shards, self.memtable_rows))
        if self.run is not None:
            if self.filters is None:
                self.seal()
            probed = materialise(may_hold(fresh, self.filters))
            old = self.run
            maybe = probed.filter("maybe").drop("maybe")
            touched = old.join(maybe.select("shard", "digest"), ["shard", "digest"], "left_semi")
            fresh = old.join(maybe.select("shard", "digest"), ["shard", "digest"], "left_anti").unionByName(merge_runs(touched.unionByName(maybe))).unionByName(probed.filter("not maybe").drop("maybe"))
        self.run = materialise(fresh.repartition("shard").sortWithinPartitions("shard", "digest"))
        self.filters = None

    def seal(self) -> None:
        """Write the filters of the merged run; only a later insert reads them."""
        self.filters = materialise(build_filters(self.run))


def dedup_exact(df: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, index: DigestIndex | None = None) -> DataFrame:
    """One row for each of `df`, dropped ones too: the id, keep_id, group_size, kept and text_sha256.

    With an index, `df` is its next batch and is compared with all batches that were inserted through this function; what
    is returned holds as of this batch. Frames of earlier batches are read again, so they must stay readable. Of rows that repeat both the id and the number of code points of the row that stays, one is kept.
    """
    base = df
    body = normalised(F.col(f"`{text}`"))
    keyed = base.select(F.col(f"`{doc_id}`").alias("doc_id"), digest(body).alias("digest"), F.length(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).cast("long").alias("points"), F.sha2(body.cast("binary"), 256).alias("text_sha256"))
    slim = materialise(keyed.withColumn("row", F.monotonically_increasing_id()))
    index = index or DigestIndex()
    index.insert(slim)
    earlier = index.batches[:]
    twice = index.run.filter("copies > 1").select("digest", F.col("points").alias("best_points"), F.col("doc_id").alias("best_id"))
    few = len(twice.select("best_points").limit(BROADCAST_DIGESTS + 1).collect()) <= BROADCAST_DIGESTS
    hits = base.select(F.col(f"`{doc_id}`").alias("doc_id"), digest(body).alias("digest"), F.length(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).cast("long").alias("points"), body.alias("body"))
    index.batches.append((slim, hits))
    if earlier:
        asked = materialise(slim.select("digest").distinct())
        past = reduce(DataFrame.unionByName, [x for x, _ in earlier]).join(asked, "digest", "left_semi")
        hits = reduce(DataFrame.unionByName, [x for _, x in earlier], hits).join(asked, "digest", "left_semi")
    hits = hits.join(F.broadcast(twice) if few else twice, "digest")
    stays = hits.filter((F.col("points") == F.col("best_points")) & F.col("doc_id").eqNullSafe(F.col("best_id")))
    stays = stays.groupBy("digest").agg(F.min("body").alias("kept_body"))
    # Bytes are compared; what differs in spite of its digest is grouped by its bytes.
    differs = materialise(hits.join(stays, "digest").filter(F.col("body") != F.col("kept_body")).select("digest").distinct())
    odd = hits.join(F.broadcast(differs) if len(differs.limit(1001).collect()) <= 1000 else differs, "digest", "left_semi")
    by_bytes = odd.groupBy("digest", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), "body").agg(F.min(F.struct((-F.col("points")).alias("fewer"), F.col("doc_id").isNull().alias("unknown"), "doc_id")).alias("best"), F.count("*").alias("copies"))
    exact = by_bytes.select("digest", "text_sha256", (-F.col("best.fewer")).alias("points"), F.col("best.doc_id").alias("best_id"), "copies")
    plain = index.run.join(differs, "digest", "left_anti").select("digest", F.lit(None).cast("string").alias("text_sha256"), "points", F.col("doc_id").alias("best_id"), "copies")
    groups = plain.unionByName(exact).select("digest", F.col("text_sha256").alias("of_text"), F.col("points").alias("best_points"), "best_id", F.col("copies").alias("group_size"))
    found = slim.join(groups, "digest").filter(F.col("of_text").isNull() | (F.col("of_text") == F.col("text_sha256")))
    best = (F.col("points") == F.col("best_points")) & F.col("doc_id").eqNullSafe(F.col("best_id"))
    # Several rows may have the id and length of the row that stays; the first of them is kept.
    firsts = found.filter(best).groupBy("digest", "text_sha256").agg(F.min("row").alias("first_row"))
    if earlier:
        # Where an earlier batch has the row that stays, none of this batch is kept.
        held = past.join(groups, "digest").filter((F.col("of_text").isNull() | (F.col("of_text") == F.col("text_sha256"))) & best)
        firsts = firsts.join(held.select("digest", "text_sha256"), ["digest", "text_sha256"], "left_anti")
    out = found.join(firsts, ["digest", "text_sha256"], "left")
    kept = F.coalesce(F.col("row") == F.col("first_row"), F.lit(False))
    return out.select(F.col("doc_id").alias(doc_id), F.col("best_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")
