"""Weekly series: demand, prices, competitors, promotions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.semantics import week_start


def weekly_sales(sales: DataFrame) -> DataFrame:
    """product_id, week, qty. Weeks without sales don't exist; rows without product or time are left out."""
    rows = sales.filter(F.col("product_id").isNotNull() & F.col("timestamp").isNotNull())
    return rows.groupBy("product_id", week_start(F.col("timestamp")).alias("week")).agg(F.coalesce(F.sum("qty"), F.lit(0)).alias("qty"))


def weekly_sales_price(sales: DataFrame) -> DataFrame:
    """product_id, week, qty and the mean unit price, not weighted by quantity."""
    rows = sales.filter(F.col("product_id").isNotNull() & F.col("timestamp").isNotNull())
    return rows.groupBy("product_id", week_start(F.col("timestamp")).alias("week")).agg(F.coalesce(F.sum("qty"), F.lit(0)).alias("qty"), F.avg("unit_price").alias("price_week"))


def competitor_week_median(prices: DataFrame) -> DataFrame:
    """product_id, week and the exact median over all competitors and statuses."""
    rows = prices.filter(F.col("product_id").isNotNull() & F.col("collected_at").isNotNull())
    rows = rows.select("product_id", week_start(F.col("collected_at")).alias("week"), F.col("competitor_price").cast("double").alias("price"))
    return rows.withColumn("middle", middle("price", "product_id", "week")).groupBy("product_id", "week").agg(F.avg("middle").alias("comp_median"))


def by_product(weekly: DataFrame, competitor_prices: DataFrame, promotions: DataFrame) -> DataFrame:
    """Rows of `weekly` (sold: true) with those of competitor prices (price) and of the weeks of promotions (promo_flag), other
    columns null, dealt by product in one exchange. What is worked out for products or their weeks then needs no other."""
    known = lambda c: F.col("product_id").isNotNull() & F.col(c).isNotNull()
    prices = competitor_prices.filter(known("collected_at")).select("product_id", week_start(F.col("collected_at")).alias("week"), F.col("competitor_price").cast("double").alias("price"))
    promos = _promo_weeks(promotions).filter(known("week")).withColumn("promo_flag", F.lit(1))
    rows = weekly.withColumn("sold", F.lit(True)).unionByName(prices, allowMissingColumns=True).unionByName(promos, allowMissingColumns=True)
    return rows.repartition("product_id")


def middle(value: str, *keys: str) -> Column:
    """The value where it is the middle one of its group, or one of the two; null elsewhere. The mean of a group's is its exact
    median. Spark's own median makes a table for each group, which costs far more than a sort where groups are small."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    n = F.count(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(F.abs(2 * F.row_number().over(w) - n - 1) <= 1, F.col(value))


def promo_weeks(promotions: DataFrame) -> DataFrame:
    """product_id, week, promo_flag 1: each Monday from the start's week to the end's, whatever the promotion's status."""
    return _promo_weeks(promotions).distinct().withColumn("promo_flag", F.lit(1))


def _promo_weeks(promotions: DataFrame) -> DataFrame:
    first, last = week_start(F.col("start_date")), week_start(F.col("end_date"))
    weeks = F.when(last >= first, F.sequence(first, last, F.expr("interval 7 days")))
    return promotions.select("product_id", F.explode(weeks).alias("week"))
