"""Baseline demand, rule tables, and decisions that follow from them by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions.semantics import first_per_group, latest_per_group
from shelfspark.functions.texts import NO_RULE, OVERSTOCK, PRICE_COMPETITOR, PRICE_NO_COMPETITOR, RESTOCK_RULES, STOCK_OK, STOCKOUT, say

DEFAULT_LEAD_DAYS = 7
BASELINE_WEEKS = 8


def trailing_weeks(weekly: DataFrame, weeks: int = BASELINE_WEEKS) -> DataFrame:
    """The last `weeks` rows of each product."""
    w = Window.partitionBy("product_id").orderBy(F.col("week").desc())
    return weekly.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= weeks).drop("n")


def demand_baseline(weekly: DataFrame, horizon_weeks: int = 4) -> DataFrame:
    """product_id, p10, p50, p90, history_weeks, last_week, horizon_weeks. p50 is the mean of the last eight weeks; p10 and
    p90 are the percentiles (linear) of these weeks around it, 0 at least."""
    recent = F.when(F.row_number().over(Window.partitionBy("product_id").orderBy(F.col("week").desc())) <= BASELINE_WEEKS, F.col("qty").cast("double"))
    # One exchange by product: both the last weeks and the whole history come from the same rows.
    found = weekly.withColumn("recent", recent).groupBy("product_id").agg(F.avg("recent").alias("p50"), F.expr("percentile(recent, array(0.1D, 0.9D))").alias("pct"), F.count("*").cast("int").alias("history_weeks"), F.max("week").alias("last_week"))
    return found.select("product_id", F.greatest(F.lit(0.0), F.col("pct")[0]).alias("p10"), "p50", F.greatest(F.lit(0.0), F.col("pct")[1]).alias("p90"), "history_weeks", "last_week", F.lit(horizon_weeks).alias("horizon_weeks"))


def latest_competitor_median(prices: DataFrame, order: list[str]) -> DataFrame:
    """product_id, competitor_median over the latest row of each competitor; latest rows without price count as missing."""
    latest = latest_per_group(prices, ["product_id", "competitor_id"], order)
    return latest.groupBy("product_id").agg(F.median("competitor_price").alias("competitor_median"))


def price_rules(products: DataFrame, prices: DataFrame, order: list[str]) -> DataFrame:
    return products.select("product_id", "min_price", "cost_price", "current_price", "min_margin").join(latest_competitor_median(prices, order), "product_id", "left")


def preferred_lead_times(suppliers: DataFrame, order: tuple[str, ...] = ("supplier_id", "lead_time_days")) -> DataFrame:
    """product_id, lead_time_days of the first preferred supplier by `order`."""
    preferred = suppliers.filter(F.col("is_preferred"))
    return first_per_group(preferred, ["product_id"], list(order)).select("product_id", "lead_time_days")


def restock_rules(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    joined = products.select("product_id", "threshold_min", "threshold_max", "current_stock").join(preferred_lead_times(suppliers), "product_id", "left")
    return joined.withColumn("lead_time_days", F.coalesce("lead_time_days", F.lit(DEFAULT_LEAD_DAYS)))


def anomaly_rules(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(0.30).alias("competitor_price_jump_pct"), F.lit(0.90).alias("competitor_price_too_low_vs_cost"), F.lit(3.0).alias("sales_spike_z"))


def stock_risk(requested: DataFrame, demand: DataFrame, rules: DataFrame) -> DataFrame:
    """For each requested product_id: risk (STOCKOUT, OVERSTOCK, OK), probability, the inputs and an explanation. Without
    demand p50 and p90 are 0; without a rule the answer is OK with probability 0."""
    rows = requested.select("product_id").join(demand.select("product_id", "p50", "p90"), "product_id", "left").join(rules, "product_id", "left")
    known = F.col("threshold_min").isNotNull()
    rows = rows.withColumns({"p50": F.when(known, F.coalesce("p50", F.lit(0.0))).otherwise(0.0), "p90": F.when(known, F.coalesce("p90", F.lit(0.0))).otherwise(0.0)})
    need = F.col("p90") * (F.col("lead_time_days") / F.lit(7.0))
    after = F.col("current_stock") - need
    low, high = F.col("threshold_min").cast("double"), F.col("threshold_max").cast("double")
    short, long = after < low, F.col("current_stock") > high + F.col("p50") * 4
    risk = F.when(short, "STOCKOUT").when(long, "OVERSTOCK").otherwise("OK")
    probability = (
        F.when(~known, 0.0)
        .when(short, F.least(F.lit(0.95), F.lit(0.50) + (low - after) / F.greatest(F.lit(1.0), low)))
        .when(long, F.least(F.lit(0.90), F.lit(0.45) + (F.col("current_stock") - high) / F.greatest(F.lit(1.0), high)))
        .otherwise(0.10)
    )
    text = (
        F.when(~known, NO_RULE)
        .when(short, say(STOCKOUT, F.col("current_stock"), need, after, F.col("threshold_min")))
        .when(long, say(OVERSTOCK, F.col("current_stock"), F.col("threshold_max"), F.col("p50") * 4))
        .otherwise(say(STOCK_OK, F.col("current_stock"), F.col("threshold_min"), F.col("threshold_max"), need))
    )
    zero = lambda c, d=0: F.coalesce(F.col(c), F.lit(d)).cast("int").alias(c)
    return rows.select("product_id", risk.alias("risk"), probability.alias("probability"), zero("current_stock"), zero("threshold_min"), zero("threshold_max"), F.col("p50").alias("demand_weekly_p50"), F.col("p90").alias("demand_weekly_p90"), zero("lead_time_days", DEFAULT_LEAD_DAYS), text.alias("explanation"))


def price_recommendation(rules: DataFrame, demand: DataFrame) -> DataFrame:
    """2 % below the competitors' median, or else the least margin; never below the least price; an interval of 5 % around."""
    rows = rules.join(demand.select("product_id", F.col("p50").alias("expected_qty")), "product_id", "left").withColumn("expected_qty", F.coalesce("expected_qty", F.lit(0.0)))
    comp = F.col("competitor_median")
    target = F.when(comp.isNotNull(), comp * F.lit(0.98)).otherwise(F.greatest(F.col("min_price"), F.col("cost_price") * (F.lit(1.0) + F.col("min_margin"))))
    rows = rows.withColumn("recommended_price", F.greatest("min_price", target))
    rec, cur = F.col("recommended_price"), F.col("current_price")
    direction = F.when(rec > cur, "INCREASE").when(rec < cur, "DECREASE").otherwise("KEEP")
    impact = (rec - F.col("cost_price")) * F.col("expected_qty") - (cur - F.col("cost_price")) * F.col("expected_qty")
    text = F.when(comp.isNull(), say(PRICE_NO_COMPETITOR, direction)).otherwise(say(PRICE_COMPETITOR, comp, direction))
    return rows.select("product_id", "recommended_price", F.greatest(F.col("min_price"), rec * F.lit(0.95)).alias("low"), (rec * F.lit(1.05)).alias("high"), direction.alias("direction"), impact.alias("estimated_margin_impact_week"), text.alias("explanation"))


def restock_recommendation(rules: DataFrame, demand: DataFrame) -> DataFrame:
    """Fill up to the need of the lead time above the least stock."""
    rows = rules.join(demand.select("product_id", "p50", "p90"), "product_id", "left").withColumns({"p50": F.coalesce("p50", F.lit(0.0)), "p90": F.coalesce("p90", F.lit(0.0))})
    lead, least, stock = F.col("lead_time_days") / F.lit(7.0), F.col("threshold_min"), F.col("current_stock")
    need50, need90, zero = F.col("p50") * lead, F.col("p90") * lead, F.lit(0).cast("bigint")
    target = F.greatest(least.cast("bigint"), F.ceil(need50 + least))
    qty = F.greatest(zero, target - stock)
    low = F.greatest(zero, F.floor(F.greatest(least.cast("double"), need50) - stock))
    high = F.greatest(qty, F.ceil(F.greatest(least.cast("double"), need90 + least) - stock))
    text = say(RESTOCK_RULES, stock, least, F.col("lead_time_days"), F.col("p50"), F.col("p90"))
    return rows.select("product_id", qty.alias("recommended_qty"), low.alias("low"), high.alias("high"), "lead_time_days", F.when(stock < least, "HIGH").otherwise("MEDIUM").alias("stockout_risk_reduction"), need50.alias("estimated_units_covered"), text.alias("explanation"))
