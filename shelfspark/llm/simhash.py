"""SimHash near-dedup by tiled exact comparison.

A document's fingerprint has 64 bits; a bit is 1 if it is set in more than half of the hashes of the document's word
shingles, repeats included. Distinct fingerprints are dealt into tiles by their population count. As two fingerprints
differ in at least as many bits as their population counts do, tile pairs whose counts differ beyond the radius are
skipped; the others are compared exactly, by exclusive-or and bit counts over whole blocks. Within a tile pair the same
rule is applied to small blocks and to the population counts of the four 16-bit quarters. Each tile pair returns a
spanning forest of its links, which keeps all components and is no larger than its rows.

Edge cases: a null or empty text has no words and fingerprint zero; texts with fewer words than a shingle are one
shingle; equal texts, repeated rows and ties share their fingerprint and class; rows with a null id belong to classes but
never name one, unless all ids of a class are null (component_id null). keep_one returns all columns unchanged;
near_duplicates returns its own columns alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import materialise
from shelfspark.llm.components import components, local_roots

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints in a tile, and in a block within it.
TILE_ROWS, BLOCK_ROWS = 16_384, 256
#: Hashes of which bits are counted at once.
COUNT_ROWS = 1 << 15


def shingle_hashes(text: str | None, words_in_shingle: int = SHINGLE) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change case, only ASCII space splits
    if not words:
        return np.zeros(0, dtype="<u8")
    n = min(words_in_shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in spans], dtype="<u8")


def fingerprint(text: str | None, words_in_shingle: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, words_in_shingle)
    if not len(hashes):
        return 0
    set_in = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), COUNT_ROWS):
        set_in += np.unpackbits(hashes[at : at + COUNT_ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def add_fingerprints(df: DataFrame, text: str = "text", out: str = "simhash", words_in_shingle: int = SHINGLE) -> DataFrame:
    """Add `out` (long, the 64 bits) to each row."""
    keep = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            prints = np.array([fingerprint(t, words_in_shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(prints)], names=[*keep, out])

    rows = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.LongType())])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def _blocks(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of similar quarter counts: rows, fingerprints, least and greatest count of each quarter."""
    quarters = np.bitwise_count(np.ascontiguousarray(prints).view(np.uint16).reshape(-1, 4)).astype(np.int16)
    order = np.lexsort(quarters.T[::-1])
    cuts = range(0, len(order), BLOCK_ROWS)
    return [(o, prints[o], quarters[o].min(axis=0), quarters[o].max(axis=0)) for o in (order[c : c + BLOCK_ROWS] for c in cuts)]


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles of distinct fingerprints, or within one (right None)."""
    nodes = left if right is None else np.concatenate((left, right))
    root = np.arange(len(nodes))
    rows = _blocks(left)
    cols = rows if right is None else [(o + len(left), *rest) for o, *rest in _blocks(right)]
    if not rows or not cols:
        return nodes[:0], nodes[:0]
    low, high = np.array([c[2] for c in cols]), np.array([c[3] for c in cols])
    held_a, held_b, held = [], [], 0
    for i, (at, prints, least, most) in enumerate(rows):
        gap = np.maximum(np.maximum(low - most, least - high), 0).sum(axis=1)
        for j in np.flatnonzero(gap <= radius):
            if right is None and j < i:
                continue
            a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ cols[j][1][None, :]) <= radius)
            held_a.append(at[a])
            held_b.append(cols[j][0][b])
            held += len(a)
            if held > 500_000:
                root = local_roots(len(nodes), np.concatenate(held_a), np.concatenate(held_b), root)
                held_a, held_b, held = [], [], 0
    if held:
        root = local_roots(len(nodes), np.concatenate(held_a), np.concatenate(held_b), root)
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def links(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Distinct fingerprints (simhash: long) to a table of links (a, b) that has the same components as all links."""
    ones = F.bit_count("simhash")
    sizes = {r[0]: r[1] for r in prints.groupBy(ones.alias("ones")).count().collect()}  # 65 rows at most
    tiles, number = {}, count()
    for k, n in sorted(sizes.items()):
        tiles[k] = [next(number) for _ in range(-(-n // tile_rows))]
    spark = prints.sparkSession
    by_ones = spark.createDataFrame([(k, v[0], len(v)) for k, v in tiles.items()] or [(0, 0, 1)], "ones int, first int, parts int")
    # Tile pairs that may hold links; their number depends on the number of tiles alone.
    near = by_ones.alias("x").join(by_ones.alias("y"), F.expr(f"y.ones between x.ones and x.ones + {int(radius)}"))
    pairs = near.select(F.explode(F.expr("sequence(x.first, x.first + x.parts - 1)")).alias("p"), F.col("y.first").alias("f"), F.col("y.parts").alias("n"))
    pairs = pairs.select("p", F.explode(F.expr("sequence(f, f + n - 1)")).alias("q")).filter("p <= q")
    dealt = prints.withColumn("ones", ones).join(F.broadcast(by_ones), "ones")
    dealt = dealt.select("simhash", (F.col("first") + F.pmod(F.xxhash64("simhash"), F.col("parts"))).cast("int").alias("tile"))
    # On the left of each pair its first tile, on the right its second.
    left = dealt.join(pairs, F.col("tile") == F.col("p")).select("p", "q", F.lit(0).alias("side"), "simhash")
    right = dealt.join(pairs.filter("p < q"), F.col("tile") == F.col("q")).select("p", "q", F.lit(1).alias("side"), "simhash")

    def compare(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        bits, side = tile["simhash"].to_numpy().astype(np.int64).view(np.uint64), tile["side"].to_numpy()
        a, b = tile_links(bits[side == 0], bits[side == 1] if key[0] != key[1] else None, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return left.unionByName(right).groupBy("p", "q").applyInPandas(compare, "a long, b long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, simhash (long) and component_id (smallest id of the class) of each row; other columns aren't kept."""
    rows = materialise(add_fingerprints(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text").select("doc_id", "simhash"))
    return rows.join(classes(rows, radius), "simhash").select("doc_id", "simhash", "component_id")


def classes(rows: DataFrame, radius: int = RADIUS, name: str = "component_id") -> DataFrame:
    """Rows (doc_id, simhash), a written table, to (simhash, component_id), one row a fingerprint; with name "root" to
    (simhash, root), the smallest fingerprint of the class."""
    distinct = materialise(rows.groupBy("simhash").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("simhash"), radius))
    named = distinct.join(roots, distinct["simhash"] == roots["node"], "left").select("simhash", "least", F.coalesce("root", "simhash").alias("root"))
    if name == "root":
        return named.select("simhash", "root")
    named = materialise(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("simhash", "component_id")




def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of `df` without those whose class holds a row with a smaller id (of equal ids, an earlier row)."""
    rows = materialise(add_fingerprints(df, text, "__simhash")).withColumn("__row", F.monotonically_increasing_id())
    named = classes(rows.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col("__simhash").alias("simhash")), radius, "root")
    slim = rows.select("__simhash", "__row", F.struct(F.col(f"`{doc_id}`").isNull().alias("unknown"), F.col(f"`{doc_id}`").alias("id"), F.col("__row").alias("row")).alias("place"))
    within = materialise(slim.join(named, F.col("__simhash") == F.col("simhash")).select("__row", "root", "place"))
    stays = within.groupBy("root").agg(F.min("place").alias("first"))
    gone = within.join(stays, "root").filter(F.col("__row") != F.col("first.row")).select("__row")
    return rows.join(gone, "__row", "left_anti").drop("__row", "__simhash")
