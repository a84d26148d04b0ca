"""What a service built on this engine calls: training jobs, and answers for one product or for all.

Answers are frames over all products; `product_id` filters them, and the filter reaches the scans.
"""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.selection import exact_quantiles
from shelfspark.functions.texts import BASELINE, DEMAND, NO_DATA, say
from shelfspark.operators import anomaly, boosting, features, isolation, optimize, rules
from shelfspark.operators.weekly import weekly_sales, weekly_sales_price
from shelfspark.plans.registry import Registry, counts

QUANTILES = {0.1: "q10", 0.5: "q50", 0.9: "q90"}


class ProductNotFound(LookupError):
    pass


def health() -> dict[str, str]:
    return {"status": "ok"}


class Training:
    """The training jobs. Each releases its tables and a report together, under one time stamp."""

    def __init__(self, spark: SparkSession, registry: Registry, order: list[str] | None = None):
        self.spark, self.registry, self.order = spark, registry, order or ["collected_at", "competitor_price", "status"]

    def train_all(self, t: dict[str, DataFrame], horizon_weeks: int = 4) -> str:
        with self.registry.release() as out:
            out.save("demand_weekly", rules.demand_baseline(weekly_sales(t["sales"]), horizon_weeks))
            out.save("price_rules", rules.price_rules(t["products"], t["competitor_prices"], self.order))
            out.save("restock_rules", rules.restock_rules(t["products"], t["product_suppliers"]))
            out.save("anomaly_rules", rules.anomaly_rules(self.spark))
            out.report("train", **{r["name"]: r["n"] for r in counts(t).collect()}, horizon_weeks=horizon_weeks)
        return out.trained_at

    def _boosted(self, kind: str, rows: DataFrame, columns: list[str], trees: int) -> str:
        with self.registry.release() as out:
            out.save(kind, boosting.fit(rows, columns, "qty", trees))
            n = rows.agg(F.count("*").alias("n"), F.count_distinct("product_id").alias("p")).first()
            out.report(kind, feature_cols=columns, n_rows=n["n"], n_products=n["p"], lags=4)
        return out.trained_at

    def train_demand(self, t: dict[str, DataFrame], trees: int = boosting.DEMAND_TREES) -> str:
        return self._boosted("demand_ml", features.training_features(weekly_sales(t["sales"])), features.DEMAND_FEATURES, trees)

    def train_price(self, t: dict[str, DataFrame], trees: int = boosting.PRICE_TREES) -> str:
        return self._boosted("price_ml", features.price_dataset(t["sales"], t["competitor_prices"], t["promotions"]), features.PRICE_FEATURES, trees)

    def train_promo(self, t: dict[str, DataFrame], trees: int = boosting.PRICE_TREES) -> str:
        return self._boosted("promo_ml", features.promo_dataset(t["sales"], t["competitor_prices"], t["promotions"]), features.PROMO_FEATURES, trees)

    def train_anomaly(self, t: dict[str, DataFrame], trees: int = isolation.TREES) -> str:
        rows = anomaly.training_dataset(t["competitor_prices"], t["products"], self.order)
        columns = [f"{c}_scaled" for c in anomaly.FEATURES]
        with self.registry.release() as out:
            stats = out.save("anomaly_stats", anomaly.statistics(rows))
            z = anomaly.scaled(rows, stats)
            model = out.save("anomaly_forest", isolation.fit(z, columns, ["product_id", "competitor_id", *self.order], trees))
            offset = exact_quantiles(isolation.score(z, columns, isolation.forest(model)), "raw_score", [isolation.CONTAMINATION])[0]
            out.report("anomaly_ml", feature_cols=anomaly.FEATURES, n_rows=rows.count(), offset=offset, score_threshold=0.0)
        return out.trained_at


def demand_cascade(products: DataFrame, weekly: DataFrame, baseline: DataFrame | None, models: dict[float, boosting.Ensemble] | Broadcast | None) -> DataFrame:
    """product_id, p10, p50, p90, source, explanation: of the model with four weeks of sales at least, or else of the
    baseline, or else zeros."""
    names = {0.1: "m10", 0.5: "m50", 0.9: "m90"}
    rows = products.select("product_id").join(features.serving_features(weekly), "product_id", "left")
    if models is not None:
        rows = boosting.score(rows, features.DEMAND_FEATURES, models, names)
    else:
        rows = rows.withColumns({n: F.lit(None).cast("double") for n in names.values()})
    if baseline is None:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("p10", "p50", "p90")}).withColumn("history_weeks", F.lit(None).cast("int"))
    else:
        rows = rows.join(baseline.select("product_id", "p10", "p50", "p90", "history_weeks"), "product_id", "left")
    ml, base = F.col("m50").isNotNull(), F.col("p50").isNotNull()
    pick = lambda m, p: F.when(ml, F.col(m)).when(base, F.col(p)).otherwise(0.0).alias(p)
    text = F.when(ml, say(DEMAND, F.col("m50"), F.col("m10"), F.col("m90"))).when(base, say(BASELINE, F.col("history_weeks"))).otherwise(NO_DATA)
    source = F.when(ml, "ML_QUANTILE_GBR").when(base, "BASELINE").otherwise("NO_DATA")
    return rows.select("product_id", pick("m10", "p10"), pick("m50", "p50"), pick("m90", "p90"), source.alias("source"), text.alias("explanation"))


class Inference:
    """The answers, from the latest artifacts and the live tables."""

    def __init__(self, spark: SparkSession, registry: Registry, order: list[str] | None = None):
        self.spark, self.registry, self.order = spark, registry, order or ["collected_at", "competitor_price", "status"]

    def _models(self, kind: str) -> Broadcast:
        return self.registry.load(kind, boosting.ensembles)

    @staticmethod
    def _only(df: DataFrame, product_id: int | None) -> DataFrame:
        return df if product_id is None else df.filter(F.col("product_id") == product_id)

    def _known(self, t: dict[str, DataFrame], product_id: int | None) -> DataFrame:
        found = self._only(t["products"], product_id)
        if product_id is not None and not found.limit(1).collect():
            raise ProductNotFound(product_id)
        return found

    def _requested(self, products: DataFrame, product_id: int | None) -> DataFrame:
        return products.select("product_id") if product_id is None else self.spark.createDataFrame([(product_id,)], "product_id bigint")

    def demand(self, t: dict[str, DataFrame], product_id: int | None = None) -> DataFrame:
        requested = self._requested(t["products"], product_id)
        models = self._models("demand_ml") if self.registry.has("demand_ml") else None
        baseline = self.registry.latest("demand_weekly") if self.registry.has("demand_weekly") else None
        return demand_cascade(requested, weekly_sales(self._only(t["sales"], product_id)), baseline, models)

    def stock_risk(self, product_id: int | None = None) -> DataFrame:
        """From artifacts alone: stock is as of training."""
        rule = self.registry.latest("restock_rules")
        return rules.stock_risk(self._requested(rule, product_id), self._only(self.registry.latest("demand_weekly"), product_id), self._only(rule, product_id))

    def price(self, t: dict[str, DataFrame], product_id: int | None = None) -> DataFrame:
        """Products without four weeks of sales have the reason as error; so in promo."""
        products = self._known(t, product_id)
        parts = [self._only(t[n], product_id) for n in ("sales", "competitor_prices", "promotions")]
        context = features.serving_context(weekly_sales_price(parts[0]), products, parts[1], parts[2])
        models = self._models("price_ml")
        columns = [F.col("price") if c == "price_week" else c for c in features.PRICE_FEATURES]
        return optimize.optimise_price(context, lambda rows: boosting.score(rows, columns, models, QUANTILES))

    def promo(self, t: dict[str, DataFrame], product_id: int | None = None) -> DataFrame:
        products = self._known(t, product_id)
        sales, prices = self._only(t["sales"], product_id), self._only(t["competitor_prices"], product_id)
        context = features.serving_context(weekly_sales_price(sales), products, prices, t["promotions"].limit(0))
        models = self._models("promo_ml")
        columns = [F.col("promo_price") if c == "price_week" else c for c in features.PROMO_FEATURES]
        return optimize.optimise_promo(context, lambda rows: boosting.score(rows, columns, models, QUANTILES))

    def restock(self, t: dict[str, DataFrame], product_id: int | None = None) -> DataFrame:
        return optimize.optimise_restock(self._known(t, product_id), self.demand(t, product_id))

    def anomalies(self, t: dict[str, DataFrame], product_id: int | None = None) -> DataFrame:
        """product_id, anomalies, and for a product that doesn't exist the error."""
        products = self._only(t["products"], product_id)
        if product_id is not None and not products.limit(1).collect():
            return self.spark.createDataFrame([(product_id, [], "Produit introuvable")], "product_id bigint, anomalies array<struct<type:string,severity:string,detail:string>>, error string")
        report = self.registry.latest_report("anomaly_ml")
        stats = self.registry.latest("anomaly_stats")
        rows = anomaly.scaled(anomaly.serving_rows(self._only(t["competitor_prices"], product_id), products, self.order), stats).drop(*stats.columns)
        raw = isolation.score(rows, [f"{c}_scaled" for c in anomaly.FEATURES], self.registry.load("anomaly_forest", isolation.forest))
        scored = raw.withColumn("score", F.col("raw_score") - F.lit(report["offset"]))
        threshold = self.spark.range(1).select(F.lit(float(report["score_threshold"])).alias("threshold"))
        found = anomaly.explain_scores(scored, stats, threshold, self.order)
        out = products.select("product_id").join(found, "product_id", "left")
        empty = F.array().cast("array<struct<type:string,severity:string,detail:string>>")
        return out.select("product_id", F.coalesce("anomalies", empty).alias("anomalies"), F.lit(None).cast("string").alias("error"))
