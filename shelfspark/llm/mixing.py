"""Mixing sources to target sizes by Pareto order sampling.

Longer documents are likelier to be taken: how many copies of a document are expected is level * (TILT + bits), where bits
is the number of binary digits of its size and the level is set for each source so that the expected words add up to the
source's target; no document expects more than `most` copies, and what this cuts off goes to the source's other documents.
The whole part of that number is allocated for certain, as whole copies. The fractional part is the inclusion probability
p of one more copy: each document draws a uniform u from a hash of its id and text, and documents are ranked by their
random odds over their inclusion odds, u/(1-u) / (p/(1-p)). The extra copies go to the first documents in that order, as
far as the words that are still missing, so a source's sample has a fixed size.

Edge cases: a null text has size 0; null sources are one source, the last; an empty table gives an empty mix; documents
of size 0 take nothing; rows that agree in id, source and text are interchangeable; other columns pass through, and an
input column with the name of a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import WORD, materialise

#: Fixed values of the production mix.
WEIGHTS, SHARE, MOST_COPIES, SEED = (5, 2, 1), 1.5, 2, 17
#: A document of one binary digit of words weighs TILT + 1, one of twice the words one more. A large TILT treats all alike.
TILT = 8
#: The order within a source is cut in so many slices of its odds; only the slice with the cut is sorted.
SLICES, DRAW_BITS = 1 << 12, 52
#: A table of sources and lengths is broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_CELLS = 50_000


def measure(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add `size` (words) and `draw` (uniform in 0 .. 2^52-1, the same in every run)."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    key = F.concat_ws(":", F.lit(str(SEED)), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), body)
    return df.withColumns({"size": F.regexp_count(body, F.lit(WORD)).cast("long"), "draw": F.conv(F.substring(F.md5(key.cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("long")})


def targets(measured: DataFrame, source: str, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """One row a source: source, source_size, target. Targets fill up by weight to `share` of all words; none exceeds
    `most` times its source. With the first k sources, in the order in which they reach their caps, held at their caps, the
    others share a level; it rises as long as the next source is above its cap, so the greatest level is the final one."""
    sizes = measured.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.lit(share) * F.sum("source_size").over(all_rows) - F.col("full")) / F.col("rest"))
        .withColumn("reached", F.max("level").over(all_rows))
    )
    return level.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("reached") * F.col("weight")).alias("target"))


def inclusion(measured: DataFrame, source: str, weights: tuple[int, ...], share: float, most: int, tilt: int) -> DataFrame:
    """One row a source and length (binary digits of the size): __source, __bits, source_size, target, __whole copies for
    certain, __p (the probability of one more, null if there is none) and __missing (the source's words that they leave)."""
    bits = F.length(F.bin("size"))
    cells = measured.groupBy(F.col(f"`{source}`").alias("__source"), bits.alias("__bits")).agg(F.sum("size").alias("words"))
    plan = targets(measured, source, weights, share, most)
    cells = cells.join(plan, F.col("__source").eqNullSafe(F.col("source"))).drop("source").withColumn("weight", F.col("__bits") + tilt)
    # The heaviest lengths reach `most` first; with the first k held there, the level of the others rises as in `targets`.
    of_source = Window.partitionBy("__source")
    before = of_source.orderBy(F.col("__bits").desc()).rowsBetween(Window.unboundedPreceding, -1)
    weighed = F.col("weight") * F.col("words")
    rest = F.sum(weighed).over(of_source) - F.coalesce(F.sum(weighed).over(before), F.lit(0))
    level = F.try_divide(F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0)), rest)
    reached = cells.withColumn("level", level).withColumn("level", F.max("level").over(of_source))
    full = F.col("target") >= most * F.col("source_size")
    expected = F.when(full, F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))))
    sure = reached.withColumn("expected", expected).withColumn("__whole", F.floor("expected").cast("long"))
    left = F.col("target") - F.sum(F.col("__whole") * F.col("words")).over(of_source)
    return sure.select("__source", "__bits", "source_size", "target", "__whole", F.nullif(F.col("expected") - F.col("__whole"), F.lit(0.0)).alias("__p"), left.alias("__missing"))


def allocate(measured: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, tilt: int = TILT) -> DataFrame:
    """Add source_size, target, odds, copies and taken to measured rows; odds (null for documents that can't have one more
    copy) is the rank's ratio. `measured` is read several times: pass a written table."""
    new = ["source_size", "target", "odds", "copies", "taken"]
    rows = measured.drop(*new)
    plan = materialise(inclusion(rows, source, weights, share, most, tilt))
    few = plan.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    small = F.broadcast if few else lambda df: df
    u = (F.col("draw") + F.lit(0.5)) / F.lit(float(1 << DRAW_BITS))
    odds = F.when(F.col("size") > 0, (u / (1 - u)) * ((1 - F.col("__p")) / F.col("__p")))
    # Rounded arithmetic keeps the order of this form, so slices are runs of the order by odds.
    slice_of: Column = F.floor((1 - 1 / (1 + F.col("odds"))) * SLICES).cast("int")
    joined = rows.join(small(plan), F.col(f"`{source}`").eqNullSafe(F.col("__source")) & (F.length(F.bin("size")) == F.col("__bits")))
    joined = joined.withColumn("odds", odds).withColumn("__slice", slice_of)
    sums = joined.filter("__slice is not null").groupBy("__source", "__slice", "__missing").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("__source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)
    cut = sums.withColumn("after", F.sum("words").over(upto)).filter((F.col("after") - F.col("words") < F.col("__missing")) & (F.col("__missing") <= F.col("after")))
    cut = materialise(cut.select(F.col("__source").alias("__of"), F.col("__slice").alias("__cut"), (F.col("after") - F.col("words")).alias("__cut_words")))
    joined = joined.join(small(cut), F.col("__source").eqNullSafe(F.col("__of")), "left")
    in_cut = F.coalesce(F.col("__slice") == F.col("__cut"), F.lit(False))
    # Without a cut, nothing is missing, or by rounding no less than all.
    first = F.when(F.col("__missing") > 0, F.col("__slice") < F.coalesce("__cut", F.lit(SLICES + 1)))
    sure = joined.filter(~in_cut).withColumn("__extra", F.coalesce(first, F.lit(False)).cast("long"))
    order = Window.partitionBy("__source").orderBy("odds", F.col("draw"), F.col(f"`{doc_id}`"), F.col("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_cut = joined.filter(in_cut).withColumn("__before", F.col("__cut_words") + F.sum("size").over(order) - F.col("size"))
    at_cut = at_cut.withColumn("__extra", ((2 * F.col("__before") + F.col("size")).cast("double") <= 2 * F.col("__missing")).cast("long")).drop("__before")
    copies = F.when(F.col("size") > 0, F.col("__whole") + F.col("__extra")).otherwise(0)
    both = sure.unionByName(at_cut).withColumn("copies", copies)
    return both.withColumn("taken", F.col("copies") * F.col("size")).select(*[F.col(f"`{c}`") for c in rows.columns], *new)


def mix_sources(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """`df` with size, draw, source_size, target, odds, copies and taken."""
    return allocate(materialise(measure(df.drop("size", "draw"), doc_id, text)), doc_id, source, **how)


def expand(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    return mixed.withColumn("__copy", F.explode(F.expr("sequence(1, greatest(copies, 1))"))).filter(F.col("copies") > 0).drop("__copy")
