"""The registered queries over the given tables, with the SQL that a second engine checks them with."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions import texts
from shelfspark.functions.selection import exact_quantiles, exact_quantiles_of
from shelfspark.functions.semantics import argmax_first, argmin_first, latest_per_group, nearest, rounded
from shelfspark.operators import anomaly, boosting, features, isolation, optimize, rules
from shelfspark.operators.weekly import competitor_week_median, promo_weeks, weekly_sales, weekly_sales_price
from shelfspark.plans import registry
from shelfspark.plans.api import QUANTILES, demand_cascade
from shelfspark.sources import retail
from shelfspark.sources.retail import RETAIL_CTES, TIES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Common table expressions that several oracles build on, by name, in an order in which each needs earlier ones only.
CTES = {
    "weekly": """SELECT product_id, CAST(date_trunc('week', "timestamp") AS DATE) AS week, CAST(sum(qty) AS BIGINT) AS qty, avg(unit_price) AS price_week FROM sales GROUP BY ALL""",
    "comp": """SELECT product_id, CAST(date_trunc('week', collected_at) AS DATE) AS week, median(competitor_price) AS comp_median FROM competitor_prices GROUP BY ALL""",
    "promo": """SELECT DISTINCT product_id, CAST(unnest(generate_series(date_trunc('week', start_date), date_trunc('week', end_date), INTERVAL 7 DAY)) AS DATE) AS week, 1 AS promo_flag FROM promotions""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY week DESC) AS n FROM weekly""",
    "last8": """SELECT * FROM ranked WHERE n <= 8""",
    "baseline": """SELECT product_id, greatest(0.0E0, quantile_cont(CAST(qty AS DOUBLE), 0.1)) AS p10, avg(CAST(qty AS DOUBLE)) AS p50, greatest(0.0E0, quantile_cont(CAST(qty AS DOUBLE), 0.9)) AS p90 FROM last8 GROUP BY ALL""",
    "history": """SELECT product_id, CAST(count(*) AS INTEGER) AS history_weeks, max(week) AS last_week FROM weekly GROUP BY ALL""",
    "lagged": """SELECT *, CAST(lag(qty, 1) OVER w AS DOUBLE) AS lag_1, CAST(lag(qty, 2) OVER w AS DOUBLE) AS lag_2, CAST(lag(qty, 3) OVER w AS DOUBLE) AS lag_3, CAST(lag(qty, 4) OVER w AS DOUBLE) AS lag_4 FROM weekly WINDOW w AS (PARTITION BY product_id ORDER BY week) QUALIFY lag_4 IS NOT NULL""",
    "rolled": """SELECT *, (lag_1 + lag_2 + lag_3 + lag_4) / 4.0E0 AS roll_mean_4 FROM lagged""",
    "trained": """SELECT *, sqrt(((lag_1 - roll_mean_4) * (lag_1 - roll_mean_4) + (lag_2 - roll_mean_4) * (lag_2 - roll_mean_4) + (lag_3 - roll_mean_4) * (lag_3 - roll_mean_4) + (lag_4 - roll_mean_4) * (lag_4 - roll_mean_4)) / 3.0E0) AS roll_std_4 FROM rolled""",
    "last4": """SELECT product_id, max(CASE WHEN n = 1 THEN CAST(qty AS DOUBLE) END) AS lag_1, max(CASE WHEN n = 2 THEN CAST(qty AS DOUBLE) END) AS lag_2, max(CASE WHEN n = 3 THEN CAST(qty AS DOUBLE) END) AS lag_3, max(CASE WHEN n = 4 THEN CAST(qty AS DOUBLE) END) AS lag_4, max(week) AS week, count(*) AS weeks FROM ranked WHERE n <= 4 GROUP BY product_id""",
    "served": """SELECT *, (lag_1 + lag_2 + lag_3 + lag_4) / 4.0E0 AS roll_mean_4 FROM last4""",
    "latest": """SELECT * FROM competitor_prices QUALIFY row_number() OVER (PARTITION BY product_id, competitor_id ORDER BY collected_at DESC, o_key DESC, o_line DESC, supplier DESC, extended DESC) = 1""",
    "latest_median": """SELECT product_id, median(competitor_price) AS competitor_median FROM latest GROUP BY ALL""",
    "lead": """SELECT product_id, lead_time_days FROM product_suppliers WHERE is_preferred QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY supplier_id, lead_time_days) = 1""",
    "restock": """SELECT p.product_id, threshold_min, threshold_max, current_stock, coalesce(lead_time_days, 7) AS lead_time_days FROM products p LEFT JOIN lead USING (product_id)""",
    "series": """SELECT c.*, p.current_price, CASE WHEN status IS NOT DISTINCT FROM 'OK' THEN 0 ELSE 1 END AS status_bad, lag(competitor_price) OVER w AS prev_price, lag(collected_at) OVER w AS prev_time FROM competitor_prices c LEFT JOIN products p USING (product_id) WINDOW w AS (PARTITION BY c.product_id, competitor_id ORDER BY collected_at, o_key, o_line, supplier, extended)""",
    "moves": """SELECT *, coalesce((competitor_price - prev_price) / nullif(prev_price, 0), 0.0E0) AS delta_pct, (epoch(collected_at) - epoch(prev_time)) / 3600.0E0 AS gap_hours FROM series""",
    "observed": """SELECT *, ln(least(greatest(coalesce(competitor_price / nullif(current_price, 0), 1.0E0), 1e-6), 1e6)) AS log_ratio FROM moves WHERE competitor_price IS NOT NULL AND prev_price IS NOT NULL AND prev_time IS NOT NULL""",
    "context": """SELECT s.product_id, s.week, coalesce(c.comp_median, p.current_price) AS comp_median, coalesce(f.promo_flag, 0) AS promo_flag, p.current_price, p.cost_price, p.min_price, p.current_stock, p.threshold_max FROM last4 s JOIN products p USING (product_id) LEFT JOIN comp c ON c.product_id = s.product_id AND c.week = s.week LEFT JOIN promo f ON f.product_id = s.product_id AND f.week = s.week WHERE s.weeks = 4""",
}


def sql(select: str, before: str = "") -> str:
    more = f",\n{before}" if before else ""
    return "WITH " + RETAIL_CTES.strip() + ",\n" + ",\n".join(f"{name} AS ({body})" for name, body in CTES.items()) + more + "\n" + select


def query(name: str, oracle: str | None = None, before: str = ""):
    """Register a query with its SQL, which may use CTES and those in `before`."""

    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = sql(oracle, before)
        return f

    return register


def r4(name: str) -> str:
    return f"floor({name} * 1e4 + 0.5) / 1e4"


def py(name: str, digits: int) -> str:
    """Rounded as Python does: printing a double takes its exact value."""
    return f"CAST(format('{{:.{digits}f}}', {name}) AS DOUBLE)"


def printed(template: str, *values: str) -> str:
    quoted = template.replace("'", "''")
    return f"printf('{quoted}', {', '.join(values)})"


def _weekly(spark: SparkSession, d: str) -> DataFrame:
    return weekly_sales_price(retail.sales(spark, d))


def _baseline(spark: SparkSession, d: str) -> DataFrame:
    return rules.demand_baseline(weekly_sales(retail.sales(spark, d)))


@query("train_report_counts", "SELECT 'products' AS name, count(*) AS n FROM products UNION ALL SELECT 'sales', count(*) FROM sales UNION ALL SELECT 'competitor_prices', count(*) FROM competitor_prices")
def _(spark, d):
    return registry.counts({"products": retail.products(spark, d), "sales": retail.sales(spark, d), "competitor_prices": retail.competitor_prices(spark, d)})


@query("weekly_sales", "SELECT product_id, week, qty FROM weekly")
def _(spark, d):
    return weekly_sales(retail.sales(spark, d))


@query("weekly_sales_price", f"SELECT product_id, week, qty, {r4('price_week')} AS price_week FROM weekly")
def _(spark, d):
    return _weekly(spark, d).withColumn("price_week", rounded(F.col("price_week")))


@query("weekly_sales_short_histories", """SELECT user_id AS product_id, CAST(date_trunc('week', ts) AS DATE) AS week, floor(sum("value") * 1e4 + 0.5) / 1e4 AS qty FROM events GROUP BY ALL""")
def _(spark, d):
    return weekly_sales(retail.event_sales(spark, d)).withColumn("qty", rounded(F.col("qty")))


@query("competitor_week_median", "SELECT product_id, week, comp_median FROM comp")
def _(spark, d):
    return competitor_week_median(retail.competitor_prices(spark, d))


@query("competitor_latest_median", "SELECT product_id, competitor_median FROM latest_median")
def _(spark, d):
    return rules.latest_competitor_median(retail.competitor_prices(spark, d), TIES)


@query("promo_week_explode", "SELECT product_id, week, promo_flag FROM promo")
def _(spark, d):
    return promo_weeks(retail.promotions(spark, d))


@query("demand_baseline", f"SELECT product_id, {r4('p10')} AS p10, {r4('p50')} AS p50, {r4('p90')} AS p90, history_weeks, last_week, 4 AS horizon_weeks FROM baseline JOIN history USING (product_id)")
def _(spark, d):
    return _baseline(spark, d).withColumns({c: rounded(F.col(c)) for c in ("p10", "p50", "p90")})


@query("percentile_linear", f"SELECT product_id, {r4('quantile_cont(CAST(qty AS DOUBLE), 0.1)')} AS low, {r4('quantile_cont(CAST(qty AS DOUBLE), 0.9)')} AS high FROM weekly GROUP BY ALL")
def _(spark, d):
    pct = F.expr("percentile(cast(qty as double), array(0.1D, 0.9D))")
    return weekly_sales(retail.sales(spark, d)).groupBy("product_id").agg(pct.alias("p")).select("product_id", rounded(F.col("p")[0]).alias("low"), rounded(F.col("p")[1]).alias("high"))


@query("trailing_8_weeks", "SELECT product_id, week, qty FROM last8")
def _(spark, d):
    return rules.trailing_weeks(weekly_sales(retail.sales(spark, d)))


@query("last_week_per_product", "SELECT product_id, last_week FROM history")
def _(spark, d):
    return weekly_sales(retail.sales(spark, d)).groupBy("product_id").agg(F.max("week").alias("last_week"))


@query("lag_features", "SELECT product_id, week, qty, lag_1, lag_2, lag_3, lag_4 FROM lagged")
def _(spark, d):
    return features.lag_features(weekly_sales(retail.sales(spark, d)))


@query("demand_training_features", "SELECT product_id, week, qty, lag_1, lag_2, lag_3, lag_4, roll_mean_4, roll_std_4 FROM trained")
def _(spark, d):
    return features.training_features(weekly_sales(retail.sales(spark, d)))


@query("supervised_counts", "SELECT count(*) AS n_rows, count(DISTINCT product_id) AS n_products FROM trained")
def _(spark, d):
    return features.training_features(weekly_sales(retail.sales(spark, d))).agg(F.count("*").alias("n_rows"), F.count_distinct("product_id").alias("n_products"))


@query("serve_features_last4", "SELECT product_id, lag_1, lag_2, lag_3, lag_4, roll_mean_4, sqrt(((lag_1 - roll_mean_4) * (lag_1 - roll_mean_4) + (lag_2 - roll_mean_4) * (lag_2 - roll_mean_4) + (lag_3 - roll_mean_4) * (lag_3 - roll_mean_4) + (lag_4 - roll_mean_4) * (lag_4 - roll_mean_4)) / 4.0E0) AS roll_std_4, week AS last_week FROM served")
def _(spark, d):
    return features.serving_features(weekly_sales(retail.sales(spark, d))).drop("last_weeks")


_DATASET = f"SELECT t.product_id, t.week, t.qty, {r4('t.price_week')} AS price_week, {r4('coalesce(c.comp_median, t.price_week)')} AS comp_median, coalesce(f.promo_flag, 0) AS promo_flag, lag_1, lag_2, lag_3, lag_4, roll_mean_4, roll_std_4, CAST(weekofyear(t.week) AS INTEGER) AS weekofyear{{more}} FROM trained t LEFT JOIN comp c ON c.product_id = t.product_id AND c.week = t.week LEFT JOIN promo f ON f.product_id = t.product_id AND f.week = t.week"


@query("price_dataset", _DATASET.format(more=""))
def _(spark, d):
    rows = features.price_dataset(retail.sales(spark, d), retail.competitor_prices(spark, d), retail.promotions(spark, d))
    return rows.withColumns({c: rounded(F.col(c)) for c in ("price_week", "comp_median")})


@query("promo_dataset", _DATASET.format(more=", 0.0E0 AS discount"))
def _(spark, d):
    rows = features.promo_dataset(retail.sales(spark, d), retail.competitor_prices(spark, d), retail.promotions(spark, d))
    return rows.withColumns({c: rounded(F.col(c)) for c in ("price_week", "comp_median")})


@query("serving_context", f"SELECT product_id, week, {r4('comp_median')} AS comp_median, promo_flag, CAST(weekofyear(week) AS INTEGER) AS weekofyear FROM context")
def _(spark, d):
    return features.serving_context(_weekly(spark, d), retail.products(spark, d), retail.competitor_prices(spark, d), retail.promotions(spark, d)).filter("last_weeks = 4").select("product_id", "week", rounded(F.col("comp_median")).alias("comp_median"), "promo_flag", "weekofyear")


@query("prev_price_delta", "SELECT product_id, competitor_id, collected_at, o_key, o_line, supplier, prev_price, delta_pct FROM moves")
def _(spark, d):
    return anomaly._series(retail.competitor_prices(spark, d), TIES).select("product_id", "competitor_id", "collected_at", "o_key", "o_line", "supplier", "prev_price", "delta_pct")


@query("gap_hours", "SELECT product_id, competitor_id, collected_at, o_key, o_line, supplier, gap_hours FROM moves")
def _(spark, d):
    return anomaly._series(retail.competitor_prices(spark, d), TIES).select("product_id", "competitor_id", "collected_at", "o_key", "o_line", "supplier", "gap_hours")


@query("latest_per_group", "SELECT product_id, competitor_id, collected_at, competitor_price, status, o_key, o_line, supplier FROM latest")
def _(spark, d):
    return latest_per_group(retail.competitor_prices(spark, d), ["product_id", "competitor_id"], TIES).drop("extended")


@query("first_per_group", "SELECT product_id, lead_time_days FROM lead")
def _(spark, d):
    return rules.preferred_lead_times(retail.product_suppliers(spark, d))


@query("status_bad_flag", "SELECT status_bad, count(*) AS n FROM series GROUP BY ALL")
def _(spark, d):
    return retail.competitor_prices(spark, d).groupBy((~F.col("status").eqNullSafe("OK")).cast("int").alias("status_bad")).agg(F.count("*").alias("n"))


@query("count_bad_low", "SELECT l.product_id, count(*) FILTER (competitor_price < cost_price * 0.90E0) AS n_low, count(*) FILTER (status IS DISTINCT FROM 'OK') AS n_bad FROM latest l JOIN products USING (product_id) GROUP BY ALL")
def _(spark, d):
    rows = latest_per_group(retail.competitor_prices(spark, d), ["product_id", "competitor_id"], TIES).join(retail.products(spark, d).select("product_id", "cost_price"), "product_id")
    return rows.groupBy("product_id").agg(F.count_if(F.col("competitor_price") < F.col("cost_price") * F.lit(0.90)).alias("n_low"), F.count_if(~F.col("status").eqNullSafe("OK")).alias("n_bad"))


@query("anomaly_dataset", f"SELECT product_id, competitor_id, collected_at, o_key, o_line, supplier, status_bad, {r4('log_ratio')} AS log_ratio, {r4('delta_pct')} AS delta_pct, gap_hours FROM observed")
def _(spark, d):
    rows = anomaly.training_dataset(retail.competitor_prices(spark, d), retail.products(spark, d), TIES)
    return rows.select("product_id", "competitor_id", "collected_at", "o_key", "o_line", "supplier", "status_bad", rounded(F.col("log_ratio")).alias("log_ratio"), rounded(F.col("delta_pct")).alias("delta_pct"), "gap_hours")


@query("anomaly_serving_rows", f"SELECT product_id, competitor_id, collected_at, o_key, o_line, supplier, status_bad, {r4('ln(least(greatest(competitor_price / greatest(current_price, 1e-6), 1e-6), 1e6))')} AS log_ratio, {r4('delta_pct')} AS delta_pct, gap_hours FROM (SELECT * REPLACE (coalesce(gap_hours, median(gap_hours) OVER (PARTITION BY product_id), 0.0E0) AS gap_hours) FROM moves) WHERE competitor_price IS NOT NULL")
def _(spark, d):
    rows = anomaly.serving_rows(retail.competitor_prices(spark, d), retail.products(spark, d), TIES).filter("competitor_price IS NOT NULL")
    return rows.select("product_id", "competitor_id", "collected_at", "o_key", "o_line", "supplier", "status_bad", rounded(F.col("log_ratio")).alias("log_ratio"), rounded(F.col("delta_pct")).alias("delta_pct"), "gap_hours")


@query("global_mean_std", "SELECT " + ", ".join(f"{r4(f'avg({c})')} AS {c}_mean, {r4(f'stddev_pop({c})')} AS {c}_std" for c in anomaly.FEATURES) + " FROM observed")
def _(spark, d):
    stats = anomaly.statistics(anomaly.training_dataset(retail.competitor_prices(spark, d), retail.products(spark, d), TIES))
    return stats.select(*[rounded(F.col(c)).alias(c) for c in stats.columns])


@query("standard_scale", "SELECT product_id, competitor_id, collected_at, o_key, o_line, supplier, " + ", ".join(f"floor((({c}) - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) * 1e3 + 0.5) / 1e3 AS {c}_scaled" for c in anomaly.FEATURES) + " FROM observed")
def _(spark, d):
    rows = anomaly.training_dataset(retail.competitor_prices(spark, d), retail.products(spark, d), TIES)
    z = anomaly.scaled(rows, anomaly.statistics(rows))
    return z.select("product_id", "competitor_id", "collected_at", "o_key", "o_line", "supplier", *[rounded(F.col(f"{c}_scaled"), 3).alias(f"{c}_scaled") for c in anomaly.FEATURES])


_Z = ", ".join(f"abs(({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-9)) AS z{i}" for i, c in enumerate(anomaly.FEATURES))


@query("argmax_feature", f"SELECT product_id, competitor_id, collected_at, o_key, o_line, supplier, CASE WHEN z0 >= greatest(z1, z2, z3) THEN 'log_ratio' WHEN z1 >= greatest(z2, z3) THEN 'delta_pct' WHEN z2 >= z3 THEN 'gap_hours' ELSE 'status_bad' END AS top_feature FROM (SELECT *, {_Z} FROM observed)")
def _(spark, d):
    rows = anomaly.training_dataset(retail.competitor_prices(spark, d), retail.products(spark, d), TIES)
    return anomaly.most_unusual(rows, anomaly.statistics(rows)).select("product_id", "competitor_id", "collected_at", "o_key", "o_line", "supplier", "top_feature")


@query("price_rules", "SELECT product_id, min_price, cost_price, current_price, min_margin, competitor_median FROM products LEFT JOIN latest_median USING (product_id)")
def _(spark, d):
    return rules.price_rules(retail.products(spark, d), retail.competitor_prices(spark, d), TIES)


@query("restock_rules", "SELECT product_id, threshold_min, threshold_max, current_stock, lead_time_days FROM restock")
def _(spark, d):
    return rules.restock_rules(retail.products(spark, d), retail.product_suppliers(spark, d))


_RISK = f"""SELECT product_id, risk, floor(probability * 1e4 + 0.5) / 1e4 AS probability, current_stock, threshold_min, threshold_max, floor(p50 * 1e4 + 0.5) / 1e4 AS demand_weekly_p50, floor(p90 * 1e4 + 0.5) / 1e4 AS demand_weekly_p90, lead_time_days,
  CASE risk WHEN 'STOCKOUT' THEN {printed(texts.STOCKOUT, 'current_stock', 'p90 * (lead_time_days / 7.0E0)', 'after', 'threshold_min')} WHEN 'OVERSTOCK' THEN {printed(texts.OVERSTOCK, 'current_stock', 'threshold_max', 'p50 * 4')} ELSE {printed(texts.STOCK_OK, 'current_stock', 'threshold_min', 'threshold_max', 'p90 * (lead_time_days / 7.0E0)')} END AS explanation
FROM (
  SELECT *, CASE WHEN after < threshold_min THEN 'STOCKOUT' WHEN current_stock > threshold_max + p50 * 4 THEN 'OVERSTOCK' ELSE 'OK' END AS risk,
    CASE WHEN after < threshold_min THEN least(0.95E0, 0.50E0 + (threshold_min - after) / greatest(1.0E0, CAST(threshold_min AS DOUBLE)))
      WHEN current_stock > threshold_max + p50 * 4 THEN least(0.90E0, 0.45E0 + (CAST(current_stock AS DOUBLE) - threshold_max) / greatest(1.0E0, CAST(threshold_max AS DOUBLE))) ELSE 0.10E0 END AS probability
  FROM (SELECT *, current_stock - p90 * (lead_time_days / 7.0E0) AS after FROM (SELECT r.*, coalesce({r4('p50')}, 0.0E0) AS p50, coalesce({r4('p90')}, 0.0E0) AS p90 FROM restock r LEFT JOIN baseline USING (product_id))))"""


@query("stock_risk", _RISK)
def stock_risk(spark, d):
    """Flagship: sales to weekly demand to baseline, with the restock rules to a risk for each product."""
    products = retail.products(spark, d)
    # Engines differ in the last bit of percentiles, which decides a tie of the probability's rounding, so they are rounded first.
    demand = _baseline(spark, d).withColumns({c: rounded(F.col(c)) for c in ("p50", "p90")})
    out = rules.stock_risk(products, demand, rules.restock_rules(products, retail.product_suppliers(spark, d)))
    return out.withColumns({c: rounded(F.col(c)) for c in ("probability", "demand_weekly_p50", "demand_weekly_p90")})


@query("lookup_missing_rule", "SELECT s.product_id, CASE WHEN r.product_id IS NULL THEN 'OK' ELSE 'known' END AS risk, coalesce(r.current_stock, 0) AS current_stock, coalesce(r.lead_time_days, 7) AS lead_time_days FROM (SELECT DISTINCT user_id AS product_id FROM events) s LEFT JOIN restock r USING (product_id)")
def _(spark, d):
    """Users stand for requested products; one that has no rule gets the default answer by a left join."""
    known = rules.restock_rules(retail.products(spark, d), retail.product_suppliers(spark, d))
    asked = retail.event_sales(spark, d).select("product_id").distinct()
    none = asked.join(known.select("product_id"), "product_id", "left_anti").withColumn("missing", F.lit(True))
    out = rules.stock_risk(asked, _baseline(spark, d), known).join(none, "product_id", "left")
    return out.select("product_id", F.when(F.col("missing"), F.col("risk")).otherwise("known").alias("risk"), "current_stock", "lead_time_days")


_MOVE = "CASE WHEN rec > current_price THEN 'INCREASE' WHEN rec < current_price THEN 'DECREASE' ELSE 'KEEP' END"


@query("price_rec_rules", f"""SELECT product_id, {r4('rec')} AS recommended_price, {r4('greatest(min_price, rec * 0.95E0)')} AS low, {r4('rec * 1.05E0')} AS high, CASE WHEN rec > current_price THEN 'INCREASE' WHEN rec < current_price THEN 'DECREASE' ELSE 'KEEP' END AS direction, floor(((rec - cost_price) * q - (current_price - cost_price) * q) * 1e2 + 0.5) / 1e2 AS estimated_margin_impact_week,
  CASE WHEN competitor_median IS NULL THEN {printed(texts.PRICE_NO_COMPETITOR, _MOVE)} ELSE {printed(texts.PRICE_COMPETITOR, 'competitor_median', _MOVE)} END AS explanation
FROM (SELECT p.*, competitor_median, coalesce(b.p50, 0.0E0) AS q, greatest(min_price, CASE WHEN competitor_median IS NOT NULL THEN competitor_median * 0.98E0 ELSE greatest(min_price, cost_price * (1.0E0 + min_margin)) END) AS rec FROM products p LEFT JOIN latest_median USING (product_id) LEFT JOIN baseline b USING (product_id))""")
def _(spark, d):
    out = rules.price_recommendation(rules.price_rules(retail.products(spark, d), retail.competitor_prices(spark, d), TIES), _baseline(spark, d))
    return out.withColumns({c: rounded(F.col(c)) for c in ("recommended_price", "low", "high")}).withColumn("estimated_margin_impact_week", rounded(F.col("estimated_margin_impact_week"), 2))


@query("restock_rec_rules", f"""SELECT product_id, qty AS recommended_qty, greatest(0, CAST(floor(greatest(CAST(threshold_min AS DOUBLE), need50) - current_stock) AS BIGINT)) AS low, greatest(qty, CAST(ceil(greatest(CAST(threshold_min AS DOUBLE), need90 + threshold_min) - current_stock) AS BIGINT)) AS high, lead_time_days, CASE WHEN current_stock < threshold_min THEN 'HIGH' ELSE 'MEDIUM' END AS stockout_risk_reduction, {r4('need50')} AS estimated_units_covered,
  {printed(texts.RESTOCK_RULES, 'current_stock', 'threshold_min', 'lead_time_days', 'q50', 'q90')} AS explanation
FROM (SELECT *, greatest(CAST(0 AS BIGINT), greatest(CAST(threshold_min AS BIGINT), CAST(ceil(need50 + threshold_min) AS BIGINT)) - current_stock) AS qty FROM (SELECT *, q50 * (lead_time_days / 7.0E0) AS need50, q90 * (lead_time_days / 7.0E0) AS need90 FROM (SELECT r.*, coalesce(floor(p50 * 1e4 + 0.5) / 1e4, 0.0E0) AS q50, coalesce(floor(p90 * 1e4 + 0.5) / 1e4, 0.0E0) AS q90 FROM restock r LEFT JOIN baseline USING (product_id))))""")
def _(spark, d):
    # Quantities are rounded up, so percentiles that differ in their last bit between engines are rounded first.
    demand = _baseline(spark, d).withColumns({c: rounded(F.col(c)) for c in ("p50", "p90")})
    out = rules.restock_recommendation(rules.restock_rules(retail.products(spark, d), retail.product_suppliers(spark, d)), demand)
    return out.withColumn("estimated_units_covered", rounded(F.col("estimated_units_covered")))


@query("anomaly_rules_detect", f"""SELECT product_id, place, type, severity,
  CASE place WHEN 1 THEN {printed(texts.TOO_LOW, 'n_low', '90.0E0')} WHEN 2 THEN {printed(texts.SHOCK, 'abs(cur - med) / med * 100', 'cur', 'med')} ELSE {printed(texts.NOT_OK, 'n_bad')} END AS detail FROM (
  SELECT l.product_id, count(*) FILTER (competitor_price < cost_price * 0.90E0) AS n_low, median(competitor_price) AS med, count(*) FILTER (status IS DISTINCT FROM 'OK') AS n_bad, any_value(current_price) AS cur FROM latest l JOIN products USING (product_id) GROUP BY l.product_id) s,
  (VALUES (1, 'SUSPECT_COMPETITOR_PRICE_TOO_LOW', 'HIGH'), (2, 'COMPETITIVE_SHOCK', 'MEDIUM'), (3, 'SCRAPING_STATUS_NOT_OK', 'LOW')) t(place, type, severity)
  WHERE (place = 1 AND n_low > 0) OR (place = 2 AND med > 0 AND abs(cur - med) / med >= 0.30E0) OR (place = 3 AND n_bad > 0)""")
def _(spark, d):
    return anomaly.rule_findings(retail.competitor_prices(spark, d), retail.products(spark, d), TIES)


@query("anomaly_rules", "SELECT CAST(0.30 AS DOUBLE) AS competitor_price_jump_pct, CAST(0.90 AS DOUBLE) AS competitor_price_too_low_vs_cost, CAST(3.0 AS DOUBLE) AS sales_spike_z, count(*) AS n FROM competitor_prices")
def _(spark, d):
    """The limits, beside the number of prices that they apply to."""
    return rules.anomaly_rules(spark).crossJoin(retail.competitor_prices(spark, d).agg(F.count("*").alias("n")))


@query("argmin_first", "SELECT product_id, week AS worst_week FROM weekly QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY qty, week) = 1")
def _(spark, d):
    """The week with the fewest units, the earliest of equal ones."""
    return weekly_sales(retail.sales(spark, d)).groupBy("product_id").agg(argmin_first(F.col("week"), F.col("qty"), F.unix_date("week")).alias("worst_week"))


@query("fillna_global_median", f"SELECT product_id, competitor_id, collected_at, o_key, o_line, supplier, {r4('coalesce(gap_hours, median(gap_hours) OVER (), 0.0E0)')} AS gap_hours FROM moves")
def _(spark, d):
    rows = anomaly.fill_gaps(anomaly._series(retail.competitor_prices(spark, d), TIES))
    return rows.select("product_id", "competitor_id", "collected_at", "o_key", "o_line", "supplier", rounded(F.col("gap_hours")).alias("gap_hours"))


_ROUNDED = ("unit_price / 7", "unit_price * qty", "unit_price / 8 - 100", "qty / 8.0E0")


@query("round", "SELECT " + ", ".join(f"""sum(CAST(round({py(x, k)} * 1e4) AS BIGINT)) AS s{i}_{k}""" for i, x in enumerate(_ROUNDED) for k in (0, 1, 2, 4)) + " FROM sales")
def _(spark, d):
    """Sums over all sales of amounts that were rounded as Python does, in ten-thousandths."""
    rows = retail.sales(spark, d)
    amounts = [F.expr(x.replace("E0", "D")) for x in _ROUNDED]
    return rows.agg(*[F.sum(F.round(nearest(x.cast("double"), k) * F.lit(1e4)).cast("bigint")).alias(f"s{i}_{k}") for i, x in enumerate(amounts) for k in (0, 1, 2, 4)])


_GRID = "SELECT *, CASE WHEN candidate < 0 THEN current_price WHEN candidate = 24 THEN high ELSE low + candidate * ((high - low) / 24.0E0) END AS price FROM (SELECT *, greatest(low + 1.0E0, current_price * 1.20E0, comp_median * 1.10E0) AS high FROM (SELECT *, greatest(min_price, current_price * 0.80E0) AS low FROM context)), (SELECT CAST(unnest(generate_series(-1, 24)) AS INTEGER) AS candidate)"


def _context(spark, d) -> DataFrame:
    return features.serving_context(_weekly(spark, d), retail.products(spark, d), retail.competitor_prices(spark, d), retail.promotions(spark, d))


@query("price_candidates", f"SELECT product_id, candidate, {r4('price')} AS price FROM ({_GRID})")
def _(spark, d):
    return optimize.price_candidates(_context(spark, d)).select("product_id", "candidate", rounded(F.col("price")).alias("price"))


@query("price_optimize_baseline", f"""SELECT product_id, {py('price', 2)} AS recommended_price, {py('low', 2)} AS low, {py('high', 2)} AS high, CASE WHEN price > current_price THEN 'INCREASE' WHEN price < current_price THEN 'DECREASE' ELSE 'KEEP' END AS direction, {py('profit - (current_price - cost_price) * p50', 4)} AS estimated_margin_impact_week
FROM (SELECT g.*, b.p50, (price - cost_price) * p50 AS profit FROM ({_GRID}) g JOIN baseline b USING (product_id) WHERE candidate >= 0) QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY profit DESC, candidate) = 1""")
def _(spark, d):
    out = optimize.optimise_price(_context(spark, d), optimize.baseline_demand(_baseline(spark, d)))
    return out.select("product_id", "recommended_price", "interval.low", "interval.high", "direction", "estimated_margin_impact_week").filter("recommended_price IS NOT NULL")


_PROMO = "SELECT c.*, i AS candidate, disc AS discount, current_price * (1.0E0 - disc) AS promo_price FROM context c, (VALUES (0, 0.0E0), (1, 0.05E0), (2, 0.10E0), (3, 0.15E0), (4, 0.20E0), (5, 0.25E0), (6, 0.30E0)) t(i, disc) WHERE current_price * (1.0E0 - disc) >= min_price"


@query("promo_optimize_baseline", f"""SELECT c.product_id, coalesce(b.discount > 0, false) AS should_promote, coalesce(b.discount, 0.0E0) AS recommended_discount, CASE WHEN b.promo_price IS NULL THEN c.current_price ELSE {py('b.promo_price', 2)} END AS promo_price, {py('coalesce(b.margin, 0.0E0)', 4)} AS estimated_margin_week
FROM context c LEFT JOIN (SELECT *, (promo_price - cost_price) * p50 AS margin, CASE WHEN current_stock > threshold_max THEN p50 ELSE (promo_price - cost_price) * p50 END AS score FROM ({_PROMO}) JOIN baseline USING (product_id) QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY score DESC, candidate) = 1) b USING (product_id)""")
def _(spark, d):
    out = optimize.optimise_promo(_context(spark, d), optimize.baseline_demand(_baseline(spark, d)))
    return out.filter("error IS NULL").select("product_id", "should_promote", "recommended_discount", "promo_price", "estimated_margin_week")


@query("argmax_first", "SELECT product_id, week AS best_week FROM weekly QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY qty DESC, week) = 1")
def _(spark, d):
    """The week with the most units, the earliest of equal ones."""
    return weekly_sales(retail.sales(spark, d)).groupBy("product_id").agg(argmax_first(F.col("week"), F.col("qty"), F.unix_date("week")).alias("best_week"))


#: The draws that all products share, as a table of both engines.
_DRAWS = "SELECT z, row_number() OVER (ORDER BY z) AS r, sum(z) OVER (ORDER BY z DESC ROWS UNBOUNDED PRECEDING) AS above FROM (SELECT CAST(unnest([" + ", ".join(f"'{z!r}'" for z in optimize.draws()[0].tolist()) + "]) AS DOUBLE) AS z)"
_NEEDS = "SELECT product_id, CAST(current_stock AS DOUBLE) AS stock, CAST(threshold_min AS DOUBLE) AS least, CAST(threshold_max AS DOUBLE) AS most, p10, p90, p50 AS mu, greatest(1e-6, (p90 - p10) / 2.56E0) AS sigma FROM products LEFT JOIN (SELECT product_id, " + ", ".join(f"coalesce({r4(c)}, 0.0E0) AS {c}" for c in ("p10", "p50", "p90")) + " FROM products LEFT JOIN baseline USING (product_id)) USING (product_id)"


@query("mc_mean", f"SELECT product_id, {py('avg(greatest(0.0E0, greatest(0.0E0, mu + sigma * z) - stock))', 4)} AS short, {py('avg(greatest(0.0E0, stock - greatest(0.0E0, mu + sigma * z)))', 4)} AS over FROM ({_NEEDS}), ({_DRAWS}) GROUP BY product_id")
def _(spark, d):
    """Mean shortage and surplus over the simulated demand of a week, at the current stock."""
    # Percentiles that differ in their last bit between engines are rounded first; so below.
    demand = _baseline(spark, d).withColumns({c: rounded(F.col(c)) for c in ("p10", "p50", "p90")})
    rows = optimize.lead_demand(retail.products(spark, d), demand).withColumn("x", F.col("stock"))
    return optimize.simulated(rows).select("product_id", nearest(F.col("short"), 4).alias("short"), nearest(F.col("over"), 4).alias("over"))


_TRIED = f"""SELECT n.*, q, stock + q AS x, CASE WHEN d.r IS NULL THEN 0 ELSE sigma * (d.above - (5001 - d.r) * t) / 5000 END AS short, CASE WHEN e.r IS NULL THEN 0 ELSE sigma * (e.above - (5001 - e.r) * t0) / 5000 END AS mean_demand
  FROM (SELECT *, (stock + q - mu) / sigma AS t, (0 - mu) / sigma AS t0 FROM (SELECT *, CAST(unnest(generate_series(0, greatest(0, CAST(ceil(mu + 3 * sigma + least + 10) AS BIGINT)))) AS BIGINT) AS q FROM ({_NEEDS}))) n
  ASOF LEFT JOIN ({_DRAWS}) d ON n.t <= d.z ASOF LEFT JOIN ({_DRAWS}) e ON n.t0 <= e.z"""


@query("restock_optimize", f"""SELECT product_id, q AS recommended_qty, greatest(0, CAST(floor(greatest(least, p10 + least) - stock) AS BIGINT)) AS low, greatest(q, CAST(ceil(greatest(least, p90 + least) - stock) AS BIGINT)) AS high, 7 AS lead_time_days,
  {py('short', 4)} AS expected_stockout_units, {py('x - mean_demand + short', 4)} AS expected_overstock_units, {py('cost', 4)} AS expected_cost
FROM (SELECT *, 15 * short + (x - mean_demand + short) + 2 * greatest(0, x - most) AS cost FROM ({_TRIED})) QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY cost, q) = 1""")
def _(spark, d):
    demand = _baseline(spark, d).withColumns({c: rounded(F.col(c)) for c in ("p10", "p50", "p90")})
    return optimize.optimise_restock(retail.products(spark, d), demand).select("product_id", "recommended_qty", "interval.*", "lead_time_days", "estimated_impact.*")


def _histories(spark, d) -> DataFrame:
    """Weekly units of products of which some have no sales at all and some few weeks: events, by user as product."""
    rows = retail.event_sales(spark, d).withColumn("qty", F.floor("qty").cast("bigint"))
    return weekly_sales(rows.filter(F.pmod("product_id", F.lit(3)) > 0).unionByName(rows.filter((F.pmod("product_id", F.lit(3)) == 0) & (F.dayofyear("timestamp") <= 20))))


_HISTORIES = """h AS (SELECT user_id AS product_id, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(sum(CAST(floor("value") AS BIGINT)) AS BIGINT) AS qty FROM events WHERE user_id % 3 > 0 OR dayofyear(ts) <= 20 GROUP BY ALL),
  hn AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY week DESC) AS n FROM h),
  hb AS (SELECT product_id, avg(CAST(qty AS DOUBLE)) AS p50 FROM hn WHERE n <= 8 GROUP BY ALL),
  hl AS (SELECT product_id, max(week) AS week, least(4, count(*)) AS weeks FROM hn GROUP BY ALL),
  hc AS (SELECT p.*, l.week, l.weeks, coalesce(b.p50, 0.0E0) AS p50, coalesce(c.comp_median, p.current_price) AS comp_median, coalesce(f.promo_flag, 0) AS promo_flag,
    CASE WHEN l.week IS NULL THEN '""" + texts.NO_SALES + """' WHEN l.weeks < 4 THEN '{short}' END AS error
    FROM products p LEFT JOIN hl l USING (product_id) LEFT JOIN hb b USING (product_id) LEFT JOIN comp c ON c.product_id = l.product_id AND c.week = l.week LEFT JOIN promo f ON f.product_id = l.product_id AND f.week = l.week)"""
_PERCENT = "(b.price - b.current_price) / greatest(b.current_price, 1e-6) * 100"


def _history_context(spark, d) -> DataFrame:
    return features.serving_context(_histories(spark, d), retail.products(spark, d), retail.competitor_prices(spark, d), retail.promotions(spark, d))


def _history_demand(spark, d):
    return optimize.baseline_demand(rules.demand_baseline(_histories(spark, d)))


@query("price_answers", f"""SELECT c.product_id, {py('b.price', 2)} AS recommended_price, {py('b.low', 2)} AS low, {py('b.high', 2)} AS high, b.direction, {py('b.impact', 4)} AS estimated_margin_impact_week,
  CASE WHEN b.product_id IS NOT NULL THEN {printed(texts.PRICE_ML, 'b.current_price', 'b.price', 'b.direction', _PERCENT, 'b.comp_median', 'b.promo_flag', 'b.p50', 'b.p50', '(b.p50 - b.p50) / greatest(b.p50, 1e-6) * 100', '(b.current_price - b.cost_price) * b.p50', 'b.profit', 'b.impact')} END AS explanation, c.error
FROM hc c LEFT JOIN (SELECT *, CASE WHEN price > current_price THEN 'INCREASE' WHEN price < current_price THEN 'DECREASE' ELSE 'KEEP' END AS direction, profit - (current_price - cost_price) * p50 AS impact
  FROM (SELECT *, (price - cost_price) * p50 AS profit FROM ({_GRID.replace("FROM context", "FROM hc WHERE error IS NULL")}) WHERE candidate >= 0) QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY profit DESC, candidate) = 1) b USING (product_id)""", before=_HISTORIES.format(short=texts.SHORT_HISTORY % "pricing"))
def _(spark, d):
    """Every product has an answer: a price, or why there is none."""
    out = optimize.optimise_price(_history_context(spark, d), _history_demand(spark, d))
    return out.select("product_id", "recommended_price", "interval.low", "interval.high", "direction", "estimated_margin_impact_week", "explanation", "error")


@query("promo_answers", f"""SELECT c.product_id, CASE WHEN c.error IS NULL THEN coalesce(b.discount > 0, false) END AS should_promote, CASE WHEN c.error IS NULL THEN coalesce(b.discount, 0.0E0) END AS recommended_discount,
  CASE WHEN c.error IS NULL THEN {py('b.promo_price', 2)} END AS promo_price, CASE WHEN c.error IS NULL THEN {py('greatest(b.min_price, b.promo_price * 0.95E0)', 2)} END AS low, CASE WHEN c.error IS NULL THEN {py('b.promo_price * 1.05E0', 2)} END AS high, CASE WHEN c.error IS NULL THEN {py('b.margin', 4)} END AS estimated_margin_week,
  CASE WHEN c.error IS NULL THEN {printed(texts.PROMO_ML, f"CASE WHEN b.current_stock > b.threshold_max THEN '{texts.PROMO_BY[0]}' ELSE '{texts.PROMO_BY[1]}' END", 'b.discount * 100', 'b.promo_price', 'b.min_price', 'b.p50', 'b.margin')} END AS explanation, c.error
FROM hc c LEFT JOIN (SELECT *, (promo_price - cost_price) * p50 AS margin, CASE WHEN current_stock > threshold_max THEN p50 ELSE (promo_price - cost_price) * p50 END AS score FROM ({_PROMO.replace("FROM context", "FROM hc")}) QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY score DESC, candidate) = 1) b USING (product_id)""", before=_HISTORIES.format(short=texts.SHORT_HISTORY % "promo"))
def _(spark, d):
    out = optimize.optimise_promo(_history_context(spark, d), _history_demand(spark, d))
    return out.select("product_id", "should_promote", "recommended_discount", "promo_price", "interval.low", "interval.high", "estimated_margin_week", "explanation", "error")


# Trees by rule, over exact quantiles of the given tables: scoring has a second engine even where fitting has none.
_STEPS, _TREES = 9, 12


def _cuts(rows: DataFrame, columns: list[str], medians: tuple[str, ...] = (), persisted: bool = False) -> tuple[list[list[float]], list[float]]:
    """The rounded tenths of each column, and the medians of others, all in the same scans."""
    found = exact_quantiles_of(rows, {c: [k / 10 for k in range(1, _STEPS + 1)] for c in columns} | {c: [0.5] for c in medians}, persisted=persisted)
    return [[math.floor(q * 1e6 + 0.5) / 1e6 for q in found[c]] for c in columns], [found[c][0] for c in medians]


def _rule_nodes(width: int, rows: str) -> str:
    """SQL: nodes t, k, f, threshold, of rows with a list x of `width` features."""
    tenths = ", ".join(f"{k / 10}E0" for k in range(1, _STEPS + 1))
    return f"""cuts AS (SELECT f, quantile_cont(x[f + 1], [{tenths}]) AS q FROM {rows}, (SELECT CAST(unnest(range({width})) AS INTEGER) AS f) GROUP BY f),
  nodes AS (SELECT t, k, f, floor(q[(5 * t + 7 * k) % {_STEPS} + 1] * 1e6 + 0.5) / 1e6 AS threshold FROM (SELECT *, CAST((t + 3 * k) % {width} AS INTEGER) AS f FROM (SELECT unnest(range({_TREES})) AS t), (SELECT unnest(range(7)) AS k)) JOIN cuts USING (f))"""


def _walk(rows: str, keys: str, comparison: str) -> str:
    """SQL: the leaf (k from 7) of each row and tree, by a join with the nodes for each level."""
    out = f"SELECT {keys}, x, t, 0 AS k FROM {rows}, (SELECT unnest(range({_TREES})) AS t)"
    for _ in range(3):
        out = f"SELECT {keys}, x, t, 2 * k + 1 + CASE WHEN x[f + 1] {comparison} threshold THEN 1 ELSE 0 END AS k FROM ({out}) JOIN nodes USING (t, k)"
    return out


def _leaf(t: int, k: int) -> float:
    return (t * 8 + k) * 37 % 101 / 8 - 6


_X = "[CAST(product_id AS DOUBLE), lag_1, lag_2, lag_3, lag_4, roll_mean_4, roll_std_4]"


@query(
    "quantile_gbr_score",
    f"SELECT product_id, week, {r4('greatest(0.0E0, (SELECT median(qty) FROM trained) + sum((t * 8 + k - 7) * 37 % 101 / 8.0E0 - 6))')} AS q50 FROM ({_walk('fx', 'product_id, week', '>')}) GROUP BY product_id, week",
    before=f"fx AS (SELECT product_id, week, {_X} AS x FROM trained), {_rule_nodes(7, 'fx')}",
)
def _(spark, d):
    rows = features.training_features(weekly_sales(retail.sales(spark, d)))
    cuts, middle = _cuts(rows, features.DEMAND_FEATURES, ("qty",))
    trees = [{"tree": -1, "value": middle}]
    for t in range(_TREES):
        f = [(t + 3 * k) % 7 for k in range(boosting.NODES)]
        trees.append({"tree": t, "feature": f, "threshold": [cuts[f[k]][(5 * t + 7 * k) % _STEPS] for k in range(boosting.NODES)], "value": [_leaf(t, k) for k in range(8)]})
    scored = boosting.score(rows, features.DEMAND_FEATURES, {0.5: boosting.Ensemble(trees)}, {0.5: "q50"})
    return scored.select("product_id", "week", rounded(F.col("q50")).alias("q50"))


_OBSERVED = "ox AS (SELECT product_id, competitor_id, collected_at, o_key, o_line, supplier, [" + r4("log_ratio") + ", " + r4("delta_pct") + ", gap_hours, CAST(status_bad AS DOUBLE)] AS x FROM observed)"
_KEYS = "product_id, competitor_id, collected_at, o_key, o_line, supplier"
_PATHS = f"SELECT {_KEYS}, -power(2.0E0, -avg(3 + (t * 8 + k) * 29 % 17 / 4.0E0) / {float(isolation.average_path(256))!r}) AS score FROM ({_walk('ox', _KEYS, '>=')}) GROUP BY {_KEYS}"


def _rule_forest(rows: DataFrame, persisted: bool = False) -> isolation.Forest:
    (cuts, _), trees = _cuts(rows, anomaly.FEATURES, persisted=persisted), []
    for t in range(_TREES):
        f, threshold, path = np.zeros(isolation.NODES, dtype=int), np.full(isolation.NODES, np.inf), np.zeros(isolation.NODES)
        for k in range(7):
            f[k] = (t + 3 * k) % 4
            threshold[k] = cuts[f[k]][(5 * t + 7 * k) % _STEPS]
        path[7:15] = [3 + (t * 8 + k) * 29 % 17 / 4 for k in range(7, 15)]
        trees.append({"tree": t, "feature": f, "threshold": threshold, "path": path, "sampled": 256})
    return isolation.Forest(trees)


def _rule_rows(spark, d) -> DataFrame:
    rows = anomaly.training_dataset(retail.competitor_prices(spark, d), retail.products(spark, d), TIES)
    return rows.withColumns({c: rounded(F.col(c)) for c in ("log_ratio", "delta_pct")})


@contextmanager
def _held(rows: DataFrame) -> Iterator[DataFrame]:
    """The rows, worked out once for all jobs of the block."""
    own = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield own
    finally:
        own.unpersist()


def _rule_scores(spark, d) -> DataFrame:
    rows = _rule_rows(spark, d)
    return isolation.score(rows, anomaly.FEATURES, _rule_forest(rows), "score")


@query("iforest_score", f"SELECT {_KEYS}, {r4('score')} AS score FROM ({_PATHS})", before=f"{_OBSERVED}, {_rule_nodes(4, 'ox')}")
def _(spark, d):
    return _rule_scores(spark, d).select(*_KEYS.split(", "), rounded(F.col("score")).alias("score"))


@query("score_quantile", f"SELECT {r4('quantile_cont(score, 0.05E0)')} AS threshold, count(*) FILTER (score < (SELECT quantile_cont(score, 0.05E0) - 1e-9 FROM ({_PATHS}))) AS n_below FROM ({_PATHS})", before=f"{_OBSERVED}, {_rule_nodes(4, 'ox')}")
def _(spark, d):
    with _held(_rule_rows(spark, d).select(*anomaly.FEATURES)) as rows:
        with _held(isolation.score(rows, anomaly.FEATURES, _rule_forest(rows, persisted=True), "score").select("score")) as scored:
            threshold = exact_quantiles(scored, "score", [isolation.CONTAMINATION], persisted=True)[0]
            below = scored.filter(F.col("score") < F.lit(threshold - 1e-9)).count()
    return spark.range(1).select(rounded(F.lit(threshold)).alias("threshold"), F.lit(below).cast("bigint").alias("n_below"))


_SCORED = f"""{_OBSERVED}, {_rule_nodes(4, 'ox')},
  os AS (SELECT {_KEYS}, floor(score * 1e6 + 0.5) / 1e6 AS score FROM ({_PATHS})),
  cut AS (SELECT {r4('quantile_cont(score, 0.05E0)')} AS threshold FROM os),
  spread AS (SELECT """ + ", ".join(f"avg(x[{i}]) AS m{i}, stddev_pop(x[{i}]) + 1e-9 AS s{i}" for i in (1, 2, 3, 4)) + """ FROM ox),
  far AS (SELECT o.*, s.score, c.threshold, """ + ", ".join(f"abs((o.x[{i}] - m{i}) / s{i}) AS z{i}" for i in (1, 2, 3, 4)) + f""" FROM ox o JOIN os s USING ({_KEYS}), cut c, spread
    QUALIFY row_number() OVER (PARTITION BY product_id, competitor_id ORDER BY collected_at DESC, o_key DESC, o_line DESC, supplier DESC) = 1)"""
_REASON = "CASE WHEN z1 >= greatest(z2, z3, z4) THEN '{log_ratio}' WHEN z2 >= greatest(z3, z4) THEN '{delta_pct}' WHEN z3 >= z4 THEN '{gap_hours}' ELSE '{status_bad}' END".format(**{k: v.replace("'", "''") for k, v in texts.REASONS.items()})


@query("anomaly_explain", f"SELECT product_id, 'ML_ANOMALY' AS type, CASE WHEN score < threshold - 0.05E0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, {printed(texts.ANOMALY, 'score', _REASON)} AS detail FROM far WHERE score < threshold", before=_SCORED)
def _(spark, d):
    """What is said of the unusual latest prices, with scores of trees by rule."""
    rows = _rule_rows(spark, d)
    with _held(rows.select(*anomaly.FEATURES)) as own:
        forest = _rule_forest(own, persisted=True)
        scores = isolation.score(own, anomaly.FEATURES, forest, "score").select(rounded(F.col("score"), 6).alias("score"))
        threshold = math.floor(exact_quantiles(scores, "score", [isolation.CONTAMINATION])[0] * 1e4 + 0.5) / 1e4
        found = anomaly.statistics(own)
        stats = spark.createDataFrame(found.collect(), found.schema)
    # Only the latest row of each competitor is explained, so only these are scored again.
    latest = isolation.score(latest_per_group(rows, ["product_id", "competitor_id"], TIES), anomaly.FEATURES, forest, "score")
    latest = latest.withColumn("score", rounded(F.col("score"), 6))
    found = anomaly.explain_scores(latest, stats, spark.range(1).select(F.lit(threshold).alias("threshold")), TIES)
    return found.select("product_id", F.explode("anomalies").alias("a")).select("product_id", "a.*")


@query("sort_multi_key", "SELECT product_id, collected_at, o_key, o_line, CAST(row_number() OVER (PARTITION BY product_id ORDER BY status DESC NULLS FIRST, competitor_price NULLS LAST, collected_at DESC, o_key, o_line) AS INTEGER) AS place FROM competitor_prices")
def _(spark, d):
    """The order of a product's observed prices: by state, then price with missing ones last, then the latest first."""
    order = [F.col("status").desc_nulls_first(), F.col("competitor_price").asc_nulls_last(), F.col("collected_at").desc(), "o_key", "o_line"]
    place = F.row_number().over(Window.partitionBy("product_id").orderBy(*order))
    return retail.competitor_prices(spark, d).select("product_id", "collected_at", "o_key", "o_line", place.alias("place"))


@query("to_datetime", """SELECT date_trunc('hour', strptime(strftime(ts, '%d/%m/%Y %H:%M:%S'), '%d/%m/%Y %H:%M:%S')) AS hour, count(*) AS n FROM events GROUP BY ALL""")
def _(spark, d):
    """Texts read as times, by hour."""
    written = F.date_format(F.col("timestamp"), "dd/MM/yyyy HH:mm:ss")
    hour = F.date_trunc("hour", F.to_timestamp(written, "dd/MM/yyyy HH:mm:ss"))
    return retail.event_sales(spark, d).groupBy(hour.cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))


@query("strftime", """SELECT strftime(ts, '%Y%m%d_%H%M%S') AS stamp, count(*) AS n FROM events GROUP BY ALL""")
def _(spark, d):
    """Time stamps as artifacts carry them."""
    return retail.event_sales(spark, d).groupBy(F.date_format("timestamp", "yyyyMMdd_HHmmss").alias("stamp")).agg(F.count("*").alias("n"))


def _demand_models(spark, d, trees: int = boosting.DEMAND_TREES):
    rows = features.training_features(weekly_sales(retail.sales(spark, d)))
    return boosting.ensembles(boosting.fit(rows, features.DEMAND_FEATURES, "qty", trees))


@query("quantile_gbr_fit")
def _(spark, d):
    return boosting.fit(features.training_features(weekly_sales(retail.sales(spark, d))), features.DEMAND_FEATURES, "qty", boosting.DEMAND_TREES)


_LAGS = [f"lag_{i}" for i in (1, 2, 3, 4)]
_FIRST = """fx AS (SELECT [lag_1, lag_2, lag_3, lag_4] AS x, CAST(qty AS DOUBLE) AS y FROM trained),
  total AS (SELECT count(*) AS rows FROM fx),
  sorted AS (SELECT f, x[f + 1] AS v, row_number() OVER (PARTITION BY f ORDER BY x[f + 1]) - 1 AS r FROM fx, (SELECT CAST(unnest(range(4)) AS INTEGER) AS f)),
  edges AS (SELECT DISTINCT f, v AS edge FROM sorted, total, (SELECT unnest(range(1, 64)) AS k) WHERE r = CAST(floor(k / 64.0E0 * (rows - 1)) AS BIGINT)),
  guess AS (SELECT y AS first_guess FROM (SELECT y, row_number() OVER (ORDER BY y) - 1 AS r FROM fx), total WHERE r = CAST(floor(0.5E0 * (rows - 1)) AS BIGINT)),
  level0 AS (SELECT x, y <= first_guess AS low, 0 AS node FROM fx, guess)""" + "".join(
    f""",
  split{k} AS (SELECT node, f, edge FROM (
    SELECT *, s * s / n + (sa - s) * (sa - s) / (na - n) - sa * sa / na AS gain FROM (
      SELECT node, f, edge, CAST(n AS DOUBLE) AS n, CAST(na AS DOUBLE) AS na, 0.5E0 * n - d AS s, 0.5E0 * na - da AS sa FROM (
        SELECT node, f, edge, count(*) FILTER (x[f + 1] <= edge) AS n, count(*) FILTER (low AND x[f + 1] <= edge) AS d, count(*) AS na, count(*) FILTER (low) AS da FROM level{k}, edges GROUP BY node, f, edge)
      WHERE n > 0 AND n < na)) WHERE gain > 1e-12 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, edge) = 1),
  level{k + 1} AS (SELECT x, low, 2 * node + 1 + CASE WHEN x[f + 1] > edge THEN 1 ELSE 0 END AS node FROM level{k} LEFT JOIN split{k} USING (node))"""
    for k in range(boosting.DEPTH)
)


@query("quantile_gbr_first_tree", " UNION ALL ".join(f"SELECT node, f AS feature, edge AS threshold FROM split{k}" for k in range(boosting.DEPTH)), before=_FIRST)
def _(spark, d):
    """The splits of a median's first tree over the four lags, whose bins are whole numbers."""
    model = boosting.fit(features.training_features(weekly_sales(retail.sales(spark, d))), _LAGS, "qty", 1, alphas=(0.5,))
    nodes = model.filter("tree = 0").select(F.posexplode(F.arrays_zip("feature", "threshold")).alias("node", "split"))
    return nodes.select("node", "split.*").filter(F.col("threshold") < float("inf"))


@query("demand_predict")
def _(spark, d):
    return demand_cascade(retail.products(spark, d), weekly_sales(retail.sales(spark, d)), _baseline(spark, d), _demand_models(spark, d))


@query("price_optimize")
def _(spark, d):
    rows = features.price_dataset(retail.sales(spark, d), retail.competitor_prices(spark, d), retail.promotions(spark, d))
    models = boosting.ensembles(boosting.fit(rows, features.PRICE_FEATURES, "qty", boosting.PRICE_TREES))
    columns = [F.col("price") if c == "price_week" else c for c in features.PRICE_FEATURES]
    return optimize.optimise_price(_context(spark, d), lambda r: boosting.score(r, columns, models, QUANTILES))


@query("promo_optimize")
def _(spark, d):
    rows = features.promo_dataset(retail.sales(spark, d), retail.competitor_prices(spark, d), retail.promotions(spark, d))
    models = boosting.ensembles(boosting.fit(rows, features.PROMO_FEATURES, "qty", boosting.PRICE_TREES))
    columns = [F.col("promo_price") if c == "price_week" else c for c in features.PROMO_FEATURES]
    return optimize.optimise_promo(_context(spark, d), lambda r: boosting.score(r, columns, models, QUANTILES))


@query("restock_optimize_ml")
def _(spark, d):
    demand = demand_cascade(retail.products(spark, d), weekly_sales(retail.sales(spark, d)), _baseline(spark, d), _demand_models(spark, d))
    return optimize.optimise_restock(retail.products(spark, d), demand)


@query("anomaly_detect_ml")
def _(spark, d):
    prices, products = retail.competitor_prices(spark, d), retail.products(spark, d)
    rows = anomaly.training_dataset(prices, products, TIES)
    stats = anomaly.statistics(rows)
    columns = [f"{c}_scaled" for c in anomaly.FEATURES]
    z = anomaly.scaled(rows, stats)
    model = isolation.forest(isolation.fit(z, columns, ["product_id", "competitor_id", *TIES]))
    offset = exact_quantiles(isolation.score(z, columns, model), "raw_score", [isolation.CONTAMINATION])[0]
    # Only the latest row of each competitor is explained, so only these are scored.
    latest = latest_per_group(anomaly.serving_rows(prices, products, TIES), ["product_id", "competitor_id"], TIES)
    served = anomaly.scaled(latest, stats).drop(*stats.columns)
    scored = isolation.score(served, columns, model).withColumn("score", F.col("raw_score") - F.lit(offset))
    threshold = spark.range(1).select(F.lit(0.0).alias("threshold"))
    return anomaly.explain_scores(scored, stats, threshold, TIES)


