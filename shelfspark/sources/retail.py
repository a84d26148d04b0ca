"""The given star-schema tables seen as the retail tables.

Each view exists twice: as a frame here, and as SQL in RETAIL_CTES for the second engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What fixes the order of competitor prices that were collected at the same time.
TIES = ["collected_at", "o_key", "o_line", "supplier", "extended"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    cost = F.col("p_retailprice") * F.lit(0.7)
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("current_price"),
        cost.alias("cost_price"),
        F.lit(0.15).alias("min_margin"),
        (cost * F.lit(1.15)).alias("min_price"),
        F.col("p_size").cast("int").alias("threshold_min"),
        (F.col("p_size") * 5 + 40).cast("int").alias("threshold_max"),
        ((F.col("p_partkey") * 37) % 250).cast("int").alias("current_stock"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_shipdate").alias("timestamp"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("bigint").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))


def event_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sales of many short histories: the user stands for the product."""
    e = _read(spark, sf_dir, "events")
    return e.select(F.col("ts").alias("timestamp"), F.col("user_id").alias("product_id"), F.col("value").alias("qty"))


def competitor_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    returned = F.col("l_returnflag") == "R"
    price = F.col("l_extendedprice") / F.col("l_quantity") / 5
    return li.select(
        F.col("l_partkey").alias("product_id"),
        (F.col("l_suppkey") % 5).alias("competitor_id"),
        F.col("l_shipdate").alias("collected_at"),
        F.when(returned & (F.col("l_linenumber") == 1), None).otherwise(price).alias("competitor_price"),
        F.when(returned & (F.col("l_linenumber") <= 2), "ERROR").otherwise("OK").alias("status"),
        F.col("l_orderkey").alias("o_key"),
        F.col("l_linenumber").alias("o_line"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_extendedprice").alias("extended"),
    )


def product_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return li.select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("supplier_id"), (2 + F.col("l_suppkey") % 20).cast("int").alias("lead_time_days"), (F.col("l_suppkey") % 7 == 0).alias("is_preferred"))


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").filter(F.col("l_discount") >= 0.095)
    start = F.col("l_shipdate").cast("date")
    return li.select(F.col("l_partkey").alias("product_id"), start.alias("start_date"), F.date_add(start, (F.col("l_linenumber") * 4).cast("int")).alias("end_date"), F.col("l_linestatus").alias("status"))


RETAIL_CTES = """
products AS (
  SELECT p_partkey AS product_id, p_brand AS brand, p_type AS category, p_retailprice AS current_price,
    p_retailprice * 0.7E0 AS cost_price, 0.15E0 AS min_margin, p_retailprice * 0.7E0 * 1.15E0 AS min_price,
    CAST(p_size AS INTEGER) AS threshold_min, CAST(p_size * 5 + 40 AS INTEGER) AS threshold_max,
    CAST((p_partkey * 37) % 250 AS INTEGER) AS current_stock
  FROM part),
sales AS (
  SELECT l_shipdate AS "timestamp", l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS qty, l_extendedprice / l_quantity AS unit_price
  FROM lineitem),
competitor_prices AS (
  SELECT l_partkey AS product_id, l_suppkey % 5 AS competitor_id, l_shipdate AS collected_at,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN NULL ELSE l_extendedprice / l_quantity / 5 END AS competitor_price,
    CASE WHEN l_returnflag = 'R' AND l_linenumber <= 2 THEN 'ERROR' ELSE 'OK' END AS status,
    l_orderkey AS o_key, l_linenumber AS o_line, l_suppkey AS supplier, l_extendedprice AS extended
  FROM lineitem),
product_suppliers AS (
  SELECT DISTINCT l_partkey AS product_id, l_suppkey AS supplier_id, CAST(2 + l_suppkey % 20 AS INTEGER) AS lead_time_days, l_suppkey % 7 = 0 AS is_preferred
  FROM lineitem),
promotions AS (
  SELECT l_partkey AS product_id, CAST(l_shipdate AS DATE) AS start_date, CAST(l_shipdate AS DATE) + CAST(l_linenumber * 4 AS INTEGER) AS end_date, l_linestatus AS status
  FROM lineitem WHERE l_discount >= 0.095E0)
"""
