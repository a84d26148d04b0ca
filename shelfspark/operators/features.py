"""Features of the demand, price and promotion models, for training and for serving.

Lags are positional: they count weeks that have sales. Training and serving differ on purpose, as documented for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.texts import NO_SALES, SHORT_HISTORY
from shelfspark.operators.weekly import by_product, middle, weekly_sales_price

LAGS = ["lag_1", "lag_2", "lag_3", "lag_4"]
DEMAND_FEATURES = ["product_id", *LAGS, "roll_mean_4", "roll_std_4"]
PRICE_FEATURES = ["product_id", "price_week", "comp_median", "promo_flag", *LAGS, "roll_mean_4", "roll_std_4", "weekofyear"]
PROMO_FEATURES = ["product_id", "price_week", "comp_median", "promo_flag", "discount", *LAGS, "roll_mean_4", "roll_std_4", "weekofyear"]


def _mean_and_std(ddof: int) -> tuple[Column, Column]:
    lags = [F.col(c) for c in LAGS]
    mean = (lags[0] + lags[1] + lags[2] + lags[3]) / F.lit(4.0)
    squares = [(x - mean) * (x - mean) for x in lags]
    return mean, F.sqrt((squares[0] + squares[1] + squares[2] + squares[3]) / F.lit(4.0 - ddof))


def lag_features(weekly: DataFrame) -> DataFrame:
    """The four last quantities before each week, as doubles; weeks with fewer than four before them are dropped."""
    w = Window.partitionBy("product_id").orderBy("week")
    lagged = weekly.withColumns({f"lag_{i}": F.lag(F.col("qty").cast("double"), i).over(w) for i in range(1, 5)})
    return lagged.filter(F.col("lag_4").isNotNull())


def training_features(weekly: DataFrame) -> DataFrame:
    """lag_features with roll_mean_4 and the sample deviation (ddof 1)."""
    mean, std = _mean_and_std(1)
    return lag_features(weekly).withColumns({"roll_mean_4": mean, "roll_std_4": F.coalesce(std, F.lit(0.0))})


def _last_four(sold: str) -> list[Column]:
    """Aggregates of a product's last rows, which are numbered n: its last four quantities, its last week, and their number."""
    lags = [F.max(F.when(F.col(sold) & (F.col("n") == i), F.col("qty").cast("double"))).alias(f"lag_{i}") for i in range(1, 5)]
    return [*lags, F.max(F.when(F.col(sold), F.col("week"))).alias("last_week"), F.count(sold).cast("int").alias("last_weeks")]


def serving_features(weekly: DataFrame) -> DataFrame:
    """One row a product with its last four weeks as lags, roll_mean_4, the population deviation (ddof 0), last_week and
    n_weeks; products with fewer than four weeks have null lags."""
    w = Window.partitionBy("product_id").orderBy(F.col("week").desc())
    last = weekly.withColumn("n", F.row_number().over(w)).filter("n <= 4")
    wide = last.withColumn("sold", F.lit(True)).groupBy("product_id").agg(*_last_four("sold"))
    mean, std = _mean_and_std(0)
    return wide.withColumns({"roll_mean_4": mean, "roll_std_4": std})


def price_dataset(sales: DataFrame, competitor_prices: DataFrame, promotions: DataFrame) -> DataFrame:
    """Training rows of the price model: a missing competitor median is the week's own price, a missing flag is 0."""
    rows = by_product(weekly_sales_price(sales), competitor_prices, promotions).withColumn("middle", middle("price", "product_id", "week"))
    weeks = rows.groupBy("product_id", "week").agg(F.max("qty").alias("qty"), F.max("price_week").alias("price_week"), F.coalesce(F.avg("middle"), F.max("price_week")).alias("comp_median"), F.coalesce(F.max("promo_flag"), F.lit(0)).alias("promo_flag"), F.max("sold").alias("sold"))
    return training_features(weeks.filter("sold").drop("sold")).withColumn("weekofyear", F.weekofyear("week"))


def promo_dataset(sales: DataFrame, competitor_prices: DataFrame, promotions: DataFrame) -> DataFrame:
    """The price model's rows with discount 0 in all of them."""
    return price_dataset(sales, competitor_prices, promotions).withColumn("discount", F.lit(0.0))


def serving_context(weekly: DataFrame, products: DataFrame, competitor_prices: DataFrame, promotions: DataFrame) -> DataFrame:
    """Of each product serving_features with, for its last week with sales, the competitor median (else the current price)
    and the promotion flag (else 0), and that week's number in the year. Products without sales have a null week, those
    with fewer than four weeks last_weeks below 4; their lags are null."""
    w = Window.partitionBy("product_id").orderBy(F.col("sold").desc_nulls_last(), F.col("week").desc())
    rows = by_product(weekly.select("product_id", "week", "qty"), competitor_prices, promotions).withColumns({"n": F.row_number().over(w), "last": F.first("week").over(w), "any": F.first("sold").over(w)})
    near = rows.filter("any and if(sold, n <= 4, week = last)").withColumn("middle", middle("price", "product_id"))
    last = near.groupBy("product_id").agg(*_last_four("sold"), F.avg("middle").alias("comp_median"), F.max("promo_flag").alias("promo_flag"))
    mean, std = _mean_and_std(0)
    joined = products.join(last.withColumns({"roll_mean_4": mean, "roll_std_4": std}).withColumnRenamed("last_week", "week"), "product_id", "left")
    return joined.withColumns({"comp_median": F.coalesce("comp_median", "current_price"), "promo_flag": F.coalesce("promo_flag", F.lit(0)), "weekofyear": F.weekofyear("week")})


def history_error(model: str) -> Column:
    """Why serving_context's row can't be answered by `model`: no sales, or fewer than four weeks; null where it can."""
    return F.when(F.col("week").isNull(), NO_SALES).when(F.col("last_weeks") < 4, SHORT_HISTORY % model)
