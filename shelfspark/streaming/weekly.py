"""Weekly demand from a stream of sales: the batch aggregate with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_demand(sales: DataFrame, lateness: str = "14 days") -> DataFrame:
    """A stream of (timestamp, product_id, qty) to product_id, week, qty. Windows start on Mondays, as in batch: the epoch
    was a Thursday, so they are shifted by four days."""
    rows = sales.filter(F.col("product_id").isNotNull() & F.col("timestamp").isNotNull()).withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", lateness)
    weekly = rows.groupBy(F.window("timestamp", "7 days", "7 days", "4 days"), "product_id").agg(F.coalesce(F.sum("qty"), F.lit(0)).alias("qty"))
    return weekly.select("product_id", F.col("window.start").cast("date").alias("week"), "qty")
