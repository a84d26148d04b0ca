"""Features of competitor prices, rule-based findings and explanations of model findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.selection import exact_quantiles
from shelfspark.functions.semantics import latest_per_group, ratio
from shelfspark.functions.texts import ANOMALY, NOT_OK, SHOCK, TOO_LOW, reason, say

FEATURES = ["log_ratio", "delta_pct", "gap_hours", "status_bad"]


def _series(prices: DataFrame, order: list[str]) -> DataFrame:
    """Previous price and time of the same product and competitor. A null status counts as bad."""
    w = Window.partitionBy("product_id", "competitor_id").orderBy(*order)
    return (
        prices.withColumn("status_bad", (~F.col("status").eqNullSafe("OK")).cast("int"))
        .withColumns({"prev_price": F.lag("competitor_price").over(w), "prev_time": F.lag("collected_at").over(w)})
        .withColumn("delta_pct", F.coalesce(ratio(F.col("competitor_price") - F.col("prev_price"), F.col("prev_price")), F.lit(0.0)))
        .withColumn("gap_hours", (F.unix_timestamp(F.col("collected_at").cast("timestamp")) - F.unix_timestamp(F.col("prev_time").cast("timestamp"))) / F.lit(3600.0))
    )


def _log(r) -> F.Column:
    return F.ln(F.least(F.greatest(r, F.lit(1e-6)), F.lit(1e6)))


def training_dataset(prices: DataFrame, products: DataFrame, order: list[str]) -> DataFrame:
    """Rows for the model: those without any null, so no first observation of a pair; a ratio to price 0 is 1."""
    joined = prices.join(products.select("product_id", "current_price"), "product_id", "left")
    rows = _series(joined, order).withColumn("log_ratio", _log(F.coalesce(ratio(F.col("competitor_price"), F.col("current_price")), F.lit(1.0))))
    return rows.na.drop("any")


def serving_rows(prices: DataFrame, products: DataFrame, order: list[str]) -> DataFrame:
    """Rows to score: gaps of first observations are the product's median gap (else 0); the ratio's divisor is 1e-6 at
    least. Rows without a price have a null ratio."""
    joined = prices.join(products.select("product_id", "current_price"), "product_id")
    rows = _series(joined, order).withColumn("log_ratio", F.when(F.col("competitor_price").isNotNull(), _log(F.col("competitor_price") / F.greatest("current_price", F.lit(1e-6)))))
    gaps = F.median("gap_hours").over(Window.partitionBy("product_id"))
    return rows.withColumn("gap_hours", F.coalesce("gap_hours", gaps, F.lit(0.0)))


def fill_gaps(rows: DataFrame) -> DataFrame:
    """gap_hours of first observations become the median over all rows, or 0 where there is none."""
    median = exact_quantiles(rows, "gap_hours", [0.5])[0]
    return rows.withColumn("gap_hours", F.coalesce("gap_hours", F.lit(0.0 if median is None else median)))


def statistics(rows: DataFrame) -> DataFrame:
    """One row: mean and population deviation of each feature."""
    return rows.agg(*[F.avg(c).alias(f"{c}_mean") for c in FEATURES], *[F.stddev_pop(c).alias(f"{c}_std") for c in FEATURES])


def scaled(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Features as z-scores; a deviation of 0 counts as 1. `stats` is one row."""
    joined = rows.crossJoin(F.broadcast(stats))
    return joined.withColumns({f"{c}_scaled": (F.col(c) - F.col(f"{c}_mean")) / F.coalesce(F.nullif(F.col(f"{c}_std"), F.lit(0.0)), F.lit(1.0)) for c in FEATURES})


def most_unusual(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """`top_feature`: the feature farthest from its mean in deviations (of the unscaled values), the first of equal ones."""
    z = F.array(*[F.abs((F.col(c) - F.col(f"{c}_mean")) / (F.col(f"{c}_std") + F.lit(1e-9))) for c in FEATURES])
    joined = rows.crossJoin(F.broadcast(stats)).withColumn("z", z)
    at = F.array_position("z", F.array_max("z")).cast("int")
    return joined.withColumn("top_feature", F.element_at(F.array(*map(F.lit, FEATURES)), at)).drop("z", *[f"{c}_{s}" for c in FEATURES for s in ("mean", "std")])


def explain_scores(scored: DataFrame, stats: DataFrame, threshold: DataFrame, order: list[str]) -> DataFrame:
    """The latest row of each competitor whose score is below the threshold, by product as an array of findings. Products
    without findings have an empty array; a latest row without a score (it has no price) gives no finding."""
    latest = latest_per_group(scored, ["product_id", "competitor_id"], order)
    rows = most_unusual(latest, stats).crossJoin(F.broadcast(threshold))
    low = F.col("score") < F.col("threshold")
    severity = F.when(F.col("score") < F.col("threshold") - F.lit(0.05), "HIGH").otherwise("MEDIUM")
    finding = F.struct(F.lit("ML_ANOMALY").alias("type"), severity.alias("severity"), say(ANOMALY, F.col("score"), reason(F.col("top_feature"))).alias("detail"))
    return rows.groupBy("product_id").agg(F.transform(F.array_sort(F.collect_list(F.when(low, F.struct("competitor_id", finding.alias("f"))))), lambda x: x["f"]).alias("anomalies"))


def rule_findings(prices: DataFrame, products: DataFrame, order: list[str], low_vs_cost: float = 0.90, jump: float = 0.30) -> DataFrame:
    """By rules on the latest row of each competitor, one row a finding: product_id, place (1..3), type, severity, detail."""
    latest = latest_per_group(prices, ["product_id", "competitor_id"], order).join(products.select("product_id", "cost_price", "current_price"), "product_id")
    sums = latest.groupBy("product_id").agg(
        F.count_if(F.col("competitor_price") < F.col("cost_price") * F.lit(low_vs_cost)).alias("n_low"),
        F.median("competitor_price").alias("med"),
        F.count_if(~F.col("status").eqNullSafe("OK")).alias("n_bad"),
        F.first("current_price").alias("cur"),
    )
    pct = F.when(F.col("med") > 0, F.abs(F.col("cur") - F.col("med")) / F.col("med"))
    part = lambda n, kind, severity, detail: F.struct(F.lit(n).alias("place"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), detail.alias("detail"))
    found = F.array(
        F.when(F.col("n_low") > 0, part(1, "SUSPECT_COMPETITOR_PRICE_TOO_LOW", "HIGH", say(TOO_LOW, F.col("n_low"), F.lit(low_vs_cost * 100)))),
        F.when(pct >= jump, part(2, "COMPETITIVE_SHOCK", "MEDIUM", say(SHOCK, pct * 100, F.col("cur"), F.col("med")))),
        F.when(F.col("n_bad") > 0, part(3, "SCRAPING_STATUS_NOT_OK", "LOW", say(NOT_OK, F.col("n_bad")))),
    )
    return sums.select("product_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("product_id", "f.*")
