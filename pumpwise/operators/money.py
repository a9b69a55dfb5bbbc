"""Currency conversion with rates in units per base currency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rated(df: DataFrame, rates: DataFrame, currency: str) -> DataFrame:
    rates = rates.select(F.col("currency").alias("__currency"), F.col("rate").alias("__rate")).where("__rate <> 0")
    return df.join(rates, F.col(currency) == F.col("__currency"), "left")


def convert(df: DataFrame, rates: DataFrame, price: str, target: str, base: str = "EUR", places: int = 3) -> DataFrame:
    """price (in base) in the row's target currency, and price_currency.  Without a rate (0 counts as none) price and base label stay."""
    rated = _rated(df, rates, target)
    known = F.col("__rate").isNotNull() & (F.col(target) != base)
    out = rated.withColumn(price, F.when(known, F.round(F.col(price) * F.col("__rate"), places)).otherwise(F.col(price)))
    return out.withColumn("price_currency", F.when(known, F.col(target)).otherwise(F.lit(base))).drop("__currency", "__rate")


def to_base(df: DataFrame, rates: DataFrame, price: str, currency: str, base: str = "EUR") -> DataFrame:
    """base_price: the price in the base currency; null without a rate."""
    rated = _rated(df, rates, currency)
    value = F.when(F.col(currency) == base, F.col(price)).otherwise(F.col(price) / F.col("__rate"))
    return rated.withColumn("base_price", value).drop("__currency", "__rate")


def convert_nested(stations: DataFrame, rates: DataFrame, currency: str, base: str = "EUR", places: int = 3) -> DataFrame:
    """The same for the canonical prices[] of stations."""
    rated = _rated(stations, rates, currency)
    known = F.col("__rate").isNotNull() & (F.col(currency) != base)

    def local(p: Column) -> Column:
        return p.withField("price", F.round(p["price"] * F.col("__rate"), places)).withField("currency", F.col(currency))

    return rated.withColumn("prices", F.when(known, F.transform("prices", local)).otherwise(F.col("prices"))).drop("__currency", "__rate")
