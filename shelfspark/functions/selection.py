"""Exact quantiles of whole columns, without a buffer of all their values.

Each round counts the rows of all columns in ranges and keeps those ranges that hold a wanted rank, by their least and
greatest value. The first round's ranges are fixed on a logarithmic scale; later ones cut a kept range evenly, so its least
and greatest value part in any case. A range of a single value is a result. Once few rows are left, their distinct values with
counts are all that is fetched.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are few enough to be fetched as distinct values with counts.
FEW = 10_000
#: Ranges of the first round for each unit of the logarithm, few enough that a task adds up most of its rows, and of a later
#: round.
FIRST, RANGES = 256, 4096


def _counted(rows: DataFrame) -> DataFrame:
    """Rows (slot, place, x) to their ranges: rows inside and up to their end, least and greatest value."""
    found = rows.groupBy("slot", "place").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    return found.withColumn("upto", F.sum("n").over(Window.partitionBy("slot").orderBy("place")))


def exact_quantiles_of(df: DataFrame, wanted: dict[str, list[float]], few: int = FEW, persisted: bool = False) -> dict[str, list[float | None]]:
    """The quantiles of several columns at once, linear between neighbours; null and NaN count as missing, and without a value
    they are None. The columns are persisted meanwhile, unless `df` already is."""
    spark, names = df.sparkSession, list(wanted)
    wide = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(names)])
    held = [] if persisted else [wide.persist(StorageLevel.MEMORY_AND_DISK)]
    try:
        totals = wide.agg(*[F.count(c).alias(c) for c in wide.columns]).first()
        places = {i: [f * (totals[i] - 1) for f in wanted[c]] for i, c in enumerate(names) if totals[i]}
        values: dict[tuple[int, int], float] = {}
        # Ranks that are sought: slot and rank within it, and for which column and rank of it.
        sought = {(i, k): [(i, k)] for i, at in places.items() for p in at for k in (math.floor(p), math.ceil(p))}
        rows = wide.select(F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"x{i}").alias("x")) for i in range(len(names))])).alias("r")).select("r.*").filter("x IS NOT NULL")
        # The logarithm of a double lies between -745 and 710, or is infinite; 0 has none and is a range of its own.
        size = F.coalesce(F.least(F.log(F.abs("x")), F.lit(800.0)) + F.lit(800.0), F.lit(0.0))
        rows = rows.withColumn("place", F.floor(F.signum("x") * size * FIRST))
        while sought:
            asked = spark.createDataFrame(list(sought), "slot int, rank long")
            got = _counted(rows).join(F.broadcast(asked), "slot").filter("rank < upto AND rank >= upto - n").collect()
            left, kept = {}, {}
            for r in got:
                meant = sought[r["slot"], r["rank"]]
                if r["least"] == r["most"]:
                    values.update(dict.fromkeys(meant, r["least"]))
                    continue
                slot = kept.setdefault((r["slot"], r["place"]), (len(kept), r["least"], r["most"], r["n"]))[0]
                left[slot, r["rank"] - (r["upto"] - r["n"])] = meant
            sought = left
            if not kept:
                break
            slots = spark.createDataFrame([(*at, *to[:3]) for at, to in kept.items()], "slot int, place long, new int, low double, high double")
            part = (F.col("x") - F.col("low")) / (F.col("high") - F.col("low"))
            rows = rows.join(F.broadcast(slots), ["slot", "place"]).select(F.col("new").alias("slot"), "x", F.floor(part * RANGES).alias("place"))
            held.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
            if sum(to[3] for to in kept.values()) <= few:
                counts: dict[int, list[tuple[float, int]]] = {}
                for slot, x, n in sorted(map(tuple, rows.groupBy("slot", "x").count().collect())):
                    counts.setdefault(slot, []).append((x, n))
                for (slot, rank), meant in sought.items():
                    at = 0
                    for x, n in counts[slot]:
                        at += n
                        if rank < at:
                            values.update(dict.fromkeys(meant, x))
                            break
                break
        between = lambda i, p: values[i, math.floor(p)] + (values[i, math.ceil(p)] - values[i, math.floor(p)]) * (p - math.floor(p)) if p % 1 else values[i, int(p)]
        return {c: [between(i, p) for p in places[i]] if i in places else [None] * len(wanted[c]) for i, c in enumerate(names)}
    finally:
        for frame in held:
            frame.unpersist()


def exact_quantiles(df: DataFrame, value: str | Column, fractions: list[float], few: int = FEW, persisted: bool = False) -> list[float | None]:
    """The quantiles of one column."""
    column = F.col(value) if isinstance(value, str) else value
    return exact_quantiles_of(df.select(column.alias("x")), {"x": fractions}, few, persisted)["x"]
