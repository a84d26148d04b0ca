"""Price, promotion and restock decisions as searches over candidates, for all products at once.

Candidates are exploded once, demand is a column (of a model or of the baseline), and the best candidate is an aggregate.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.semantics import argmax_first, argmin_first, nearest
from shelfspark.functions.texts import NO_SALES, PRICE_ML, PROMO_BY, PROMO_ML, PROMO_NONE, RESTOCK_ML, say
from shelfspark.operators.features import history_error

PRICE_STEPS = 25
DISCOUNTS = [0.0, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30]
DRAWS, SEED = 5000, 42
STOCKOUT_COST, HOLDING_COST, OVER_COST = 15.0, 1.0, 2.0

#: Takes candidate rows and adds q10, q50 and q90.
Demand = Callable[[DataFrame], DataFrame]


def baseline_demand(demand: DataFrame) -> Demand:
    """The baseline whatever the price; products without one have demand 0."""
    d = demand.select("product_id", F.col("p10").alias("q10"), F.col("p50").alias("q50"), F.col("p90").alias("q90"))
    return lambda rows: rows.join(d, "product_id", "left").na.fill(0.0, ["q10", "q50", "q90"])


def price_candidates(context: DataFrame) -> DataFrame:
    """25 evenly spaced prices a product, and its current price as candidate -1. Needs current_price, min_price, comp_median."""
    low = F.greatest(F.col("min_price"), F.col("current_price") * F.lit(0.80))
    rows = context.withColumn("low", low).withColumn("high", F.greatest(F.col("low") + F.lit(1.0), F.col("current_price") * F.lit(1.20), F.col("comp_median") * F.lit(1.10)))
    step = (F.col("high") - F.col("low")) / F.lit(float(PRICE_STEPS - 1))
    grid = rows.withColumn("candidate", F.explode(F.sequence(F.lit(-1), F.lit(PRICE_STEPS - 1))))
    price = F.when(F.col("candidate") < 0, F.col("current_price")).when(F.col("candidate") == PRICE_STEPS - 1, F.col("high")).otherwise(F.col("low") + F.col("candidate") * step)
    return grid.withColumn("price", price)


def _with_error(context: DataFrame, model: str) -> DataFrame:
    return context.withColumn("error", history_error(model) if {"week", "last_weeks"} <= set(context.columns) else F.lit(None).cast("string"))


def optimise_price(context: DataFrame, demand: Demand) -> DataFrame:
    """The candidate with the greatest profit, the lowest of equal ones, against the current price. Products without enough
    weeks of sales have the error, and null in all else."""
    rows = demand(price_candidates(_with_error(context, "pricing"))).withColumn("profit", (F.col("price") - F.col("cost_price")) * F.col("q50"))
    grid = F.col("candidate") >= 0
    at = F.when(grid, F.struct("price", "q10", "q50", "q90", "profit"))
    best = rows.groupBy("product_id").agg(
        F.max_by(at, F.when(grid, F.struct("profit", -F.col("candidate")))).alias("best"),
        F.max(F.when(~grid, F.struct("q50", "profit"))).alias("now"),
        *[F.first(c).alias(c) for c in ("low", "high", "current_price", "comp_median", "promo_flag", "error")],
    )
    price, cur = F.col("best.price"), F.col("current_price")
    direction = F.when(price > cur, "INCREASE").when(price < cur, "DECREASE").otherwise("KEEP")
    impact = F.col("best.profit") - F.col("now.profit")
    price_pct = (price - cur) / F.greatest(cur, F.lit(1e-6)) * 100
    demand_pct = (F.col("best.q50") - F.col("now.q50")) / F.greatest(F.col("now.q50"), F.lit(1e-6)) * 100
    text = say(PRICE_ML, cur, price, direction, price_pct, F.col("comp_median"), F.col("promo_flag"), F.col("now.q50"), F.col("best.q50"), demand_pct, F.col("now.profit"), F.col("best.profit"), impact)
    answer = {
        "demand_weekly": F.struct(F.col("best.q10").alias("p10"), F.col("best.q50").alias("p50"), F.col("best.q90").alias("p90")),
        "recommended_price": nearest(price, 2),
        "interval": F.struct(nearest(F.col("low"), 2).alias("low"), nearest(F.col("high"), 2).alias("high")),
        "direction": direction,
        "estimated_margin_impact_week": nearest(impact, 4),
        "explanation": text,
    }
    return best.select("product_id", *[F.when(F.col("error").isNull(), v).alias(k) for k, v in answer.items()], "error")


def promo_candidates(context: DataFrame) -> DataFrame:
    """The discounts whose price isn't below the least price; the flag is 1 for each of them, for 0 too. A product without any
    has one row, whose candidate is null."""
    price = lambda discount: F.col("current_price") * (F.lit(1.0) - F.lit(discount))
    tried = [F.struct(F.lit(i).alias("candidate"), F.lit(d).alias("discount"), price(d).alias("promo_price")) for i, d in enumerate(DISCOUNTS)]
    feasible = F.filter(F.array(*tried), lambda c: c["promo_price"] >= F.col("min_price"))
    rows = context.withColumn("tried", F.explode_outer(feasible))
    return rows.select(*context.columns, "tried.*").withColumn("promo_flag", F.lit(1))


def optimise_promo(context: DataFrame, demand: Demand) -> DataFrame:
    """The discount that sells most (if stock is above its limit) or earns most. Products without a feasible one keep their
    price; for them demand_weekly is null and estimated_margin_week is 0. Products without sales, or with a feasible discount
    but too few weeks of sales, have the error, and null in all else."""
    rows = demand(promo_candidates(_with_error(context, "promo"))).withColumn("margin", (F.col("promo_price") - F.col("cost_price")) * F.col("q50"))
    over = F.col("current_stock") > F.col("threshold_max")
    rows = rows.withColumn("score", F.when(over, F.col("q50")).otherwise(F.col("margin")))
    tried = F.when(F.col("candidate").isNotNull(), F.struct("discount", "promo_price", "q10", "q50", "q90", "margin"))
    kept = {"current_price": F.col("current_price"), "min_price": F.col("min_price"), "over": over, "error": F.col("error")}
    out = rows.groupBy("product_id").agg(argmax_first(tried, F.col("score"), F.col("candidate")).alias("b"), *[F.first(c).alias(k) for k, c in kept.items()])
    none = F.col("b").isNull()
    error = F.when(~none | (F.col("error") == NO_SALES), F.col("error"))
    price = F.coalesce("b.promo_price", "current_price")
    low = F.when(none, F.col("current_price")).otherwise(nearest(F.greatest(F.col("min_price"), price * F.lit(0.95)), 2))
    high = F.when(none, F.col("current_price")).otherwise(nearest(price * F.lit(1.05), 2))
    by = F.when(F.col("over"), PROMO_BY[0]).otherwise(PROMO_BY[1])
    text = F.when(none, PROMO_NONE).otherwise(say(PROMO_ML, by, F.col("b.discount") * 100, F.col("b.promo_price"), F.col("min_price"), F.col("b.q50"), F.col("b.margin")))
    answer = {
        "should_promote": F.coalesce(F.col("b.discount") > 0, F.lit(False)),
        "recommended_discount": F.coalesce(nearest(F.col("b.discount"), 4), F.lit(0.0)),
        "promo_price": F.when(none, F.col("current_price")).otherwise(nearest(price, 2)),
        "interval": F.struct(low.alias("low"), high.alias("high")),
        "demand_weekly": F.when(~none, F.struct(F.col("b.q10").alias("p10"), F.col("b.q50").alias("p50"), F.col("b.q90").alias("p90"))),
        "estimated_margin_week": F.coalesce(nearest(F.col("b.margin"), 4), F.lit(0.0)),
        "explanation": text,
    }
    return out.select("product_id", *[F.when(error.isNull(), v).alias(k) for k, v in answer.items()], error.alias("error"))


@lru_cache(maxsize=1)
def draws() -> tuple[np.ndarray, np.ndarray]:
    """The standard normal draws that all products share, ascending, and the sums from each of them on."""
    z = np.sort(np.random.default_rng(SEED).standard_normal(DRAWS))
    return z, np.append(np.cumsum(z[::-1])[::-1], 0.0)


def mean_above(t: np.ndarray) -> np.ndarray:
    """Mean of max(0, z - t) over the draws."""
    z, sums = draws()
    at = np.searchsorted(z, t)
    return (sums[at] - (DRAWS - at) * t) / DRAWS


@F.pandas_udf(T.DoubleType())
def _shortage(x: pd.Series, mu: pd.Series, sigma: pd.Series) -> pd.Series:
    """Expected demand, cut at 0, above the level x >= 0."""
    level = x.to_numpy(dtype=float)
    return pd.Series(sigma.to_numpy(dtype=float) * mean_above((level - mu.to_numpy(dtype=float)) / sigma.to_numpy(dtype=float)))


def lead_demand(products: DataFrame, demand: DataFrame, lead_days: int = 7) -> DataFrame:
    """stock, least, most, p10, p50, p90, and mu and sigma of the demand over the lead time; without demand it is 0."""
    d = demand.select("product_id", "p10", "p50", "p90")
    rows = products.select("product_id", F.col("current_stock").cast("double").alias("stock"), F.col("threshold_min").cast("double").alias("least"), F.col("threshold_max").cast("double").alias("most")).join(d, "product_id", "left").na.fill(0.0, ["p10", "p50", "p90"])
    lead = F.lit(lead_days / 7.0)
    return rows.withColumns({"mu": F.col("p50") * lead, "sigma": F.greatest(F.lit(1e-6), (F.col("p90") - F.col("p10")) / F.lit(2.56)) * lead})


def simulated(rows: DataFrame) -> DataFrame:
    """Add the means of the shortage and the surplus over the simulated demand, for a stock of x."""
    rows = rows.withColumn("short", _shortage("x", "mu", "sigma")).withColumn("mean_demand", _shortage(F.lit(0.0), "mu", "sigma"))
    return rows.withColumn("over", F.greatest(F.lit(0.0), F.col("x") - F.col("mean_demand") + F.col("short")))


def optimise_restock(products: DataFrame, demand: DataFrame, lead_days: int = 7) -> DataFrame:
    """The order quantity with the least expected cost over simulated demand.

    All products share the same standard normal draws, so expectations are sums over a sorted table. The cost is convex in
    the stock level: its least value lies at one of two order statistics of the draws, depending on the stock limit, and the
    whole quantities on either side of it are compared.
    """
    z, _ = draws()
    rank = lambda a: float(z[-(-a * DRAWS // 16) - 1])
    lead = lead_days / 7.0
    rows = lead_demand(products, demand, lead_days)
    q_max = F.greatest(F.lit(0).cast("bigint"), F.ceil(F.col("mu") + 3 * F.col("sigma") + F.col("least") + 10))
    free, tight = (F.greatest(F.lit(0.0), F.col("mu") + F.col("sigma") * F.lit(rank(a))) for a in (15, 13))
    level = F.when(free <= F.col("most"), free).otherwise(F.greatest(tight, F.col("most")))
    rows = rows.withColumns({"q_max": q_max, "level": level - F.col("stock")})
    clamp = lambda q: F.greatest(F.lit(0).cast("bigint"), F.least(q, F.col("q_max")))
    tried = rows.withColumn("q", F.explode(F.array_distinct(F.array(clamp(F.floor("level")), clamp(F.ceil("level"))))))
    tried = simulated(tried.withColumn("x", F.col("stock") + F.col("q")))
    tried = tried.withColumn("cost", STOCKOUT_COST * F.col("short") + HOLDING_COST * F.col("over") + OVER_COST * F.greatest(F.lit(0.0), F.col("x") - F.col("most")))
    keep = ["stock", "least", "mu", "p10", "p90"]
    best = tried.groupBy("product_id").agg(argmin_first(F.struct("q", "short", "over", "cost"), F.col("cost"), F.col("q")).alias("b"), *[F.first(c).alias(c) for c in keep])
    zero = F.lit(0).cast("bigint")
    low = F.greatest(zero, F.floor(F.greatest(F.col("least"), F.col("p10") * F.lit(lead) + F.col("least")) - F.col("stock")))
    high = F.greatest(F.col("b.q"), F.ceil(F.greatest(F.col("least"), F.col("p90") * F.lit(lead) + F.col("least")) - F.col("stock")))
    impact = F.struct(*[nearest(F.col(f"b.{c}"), 4).alias(k) for k, c in (("expected_stockout_units", "short"), ("expected_overstock_units", "over"), ("expected_cost", "cost"))])
    text = say(RESTOCK_ML, F.col("stock"), F.lit(lead_days), F.col("mu"), F.col("b.q"), F.col("b.short"), F.col("b.over"))
    return best.select("product_id", F.col("b.q").alias("recommended_qty"), F.struct(low.alias("low"), high.alias("high")).alias("interval"), F.lit(lead_days).alias("lead_time_days"), impact.alias("estimated_impact"), text.alias("explanation"))

