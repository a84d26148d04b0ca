"""Column functions that fix the semantics which Spark, SQL and dataframe libraries differ in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def week_start(ts: Column) -> Column:
    """The Monday of the week, as a date."""
    return F.date_trunc("week", ts).cast("date")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up in binary: the same in any engine with IEEE doubles."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def nearest(x: Column, digits: int) -> Column:
    """`digits` decimals as Python's round gives them: the nearest by the double's exact value, ties to the even digit.

    Spark's own rounding takes the shortest decimal text of the double for its value, so it rounds 2.675 up. Here the product
    with 10^digits (up to 8 digits) is known exactly, as a double and what that is off by (Dekker 1971).
    """
    scale = F.lit(10.0**digits)

    def rounded_size(size: Column) -> Column:
        product, lifted = size * scale, size * F.lit(float(2**27 + 1))
        upper = lifted - (lifted - size)
        error = (upper * scale - product) + (size - upper) * scale
        whole = F.floor(product).cast("double")
        over, odd = (product - whole - F.lit(0.5)) + error, whole % 2 == 1
        step = F.when((over > 0) | ((over == 0) & odd), F.lit(1.0)).when((over == -1) & odd, F.lit(-1.0)).otherwise(F.lit(0.0))
        # Beyond the limit, doubles are farther apart than the decimals.
        return F.when(product < F.lit(2.0**53), (whole + step) / scale).otherwise(size)

    # As the parameter of a function the number is worked out once, where an expression would repeat it thirty times.
    value = F.get(F.transform(F.array(F.abs(x.cast("double"))), rounded_size), F.lit(0))
    return F.when(x < 0, -value).otherwise(value)


def latest_per_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each group by `order`, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def first_per_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def argmax_first(value: Column, score: Column, place: Column) -> Column:
    """Aggregate: the value with the greatest score; of equal scores the one with the smallest place."""
    return F.max_by(value, F.struct(score, -place))


def argmin_first(value: Column, score: Column, place: Column) -> Column:
    return F.min_by(value, F.struct(score, place))
