"""Prices inside a station row: wide columns or nested lists to an ordered, valid, deduplicated array.  No shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pumpwise.functions.scalars import valid_price
from pumpwise.schema import STATION_COLUMNS


def entry(fuel: Column, price: Column, unit: Column) -> Column:
    """The working form of a price: fuel_type, price, unit."""
    return F.struct(fuel.alias("fuel_type"), price.cast("double").alias("price"), unit.alias("unit"))


def from_columns(fuels: Sequence[tuple[str, str, str]], value) -> Column:
    """Wide to long: one entry per (source column, fuel, unit), in that order.  value maps a source column's name to a double Column."""
    return F.array(*(entry(F.lit(fuel), value(name), F.lit(unit)) for name, fuel, unit in fuels))


def keep_valid(prices: Column) -> Column:
    return F.filter(prices, lambda p: valid_price(p["price"]))


def first_per_fuel(prices: Column) -> Column:
    """The first entry of each fuel, order kept.  Filter for validity before, so that an invalid price does not hide a later valid one."""
    names = F.transform(prices, lambda p: p["fuel_type"])
    return F.filter(prices, lambda p, i: F.array_position(names, p["fuel_type"]) == i + 1)


def first_valid_columns(fuels: Sequence[tuple[str, str, str]], value) -> Column:
    """The same as first_per_fuel(keep_valid(from_columns(fuels, value))), with the comparisons of fuels made while the plan is built."""
    prices, kept = [value(name) for name, _, _ in fuels], []
    for i, (_, fuel, unit) in enumerate(fuels):
        earlier = [valid_price(prices[j]) for j in range(i) if fuels[j][1] == fuel]
        first = valid_price(prices[i])
        for other in earlier:
            first = first & ~other
        kept.append(F.when(first, entry(F.lit(fuel), prices[i], F.lit(unit))))
    return F.array_compact(F.array(*kept))


def unnest(df: DataFrame, keep: Sequence[str], nested: str, ordinal: str, name: str) -> DataFrame:
    """The elements of a nested list as rows, with their place in the list."""
    return df.select(*keep, F.posexplode(nested).alias(ordinal, name))


def first_where(elements: Column, condition) -> Column:
    """The first list element that meets the condition, null without one; what it holds is parsed only then, so a bad value does not
    make way for the next element."""
    return F.get(F.filter(elements, condition), F.lit(0))


def with_prices(stations: DataFrame, prices: Column, currency: str, run_at: Column, keep_empty: bool = False) -> DataFrame:
    """Stations with prices[] in the canonical form; stations left without a price go unless keep_empty."""
    canonical = F.transform(
        prices,
        lambda p: F.struct(
            p["fuel_type"].alias("fuel_type"), p["price"].alias("price"), F.lit(currency).alias("currency"), p["unit"].alias("unit"),
            run_at.alias("updated_at")
        ),
    )
    out = stations.withColumn("prices", canonical)
    return out if keep_empty else out.where(F.size("prices") > 0)


def canonical(stations: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The canonical columns, and extra ones that some sources have; helper columns go."""
    return stations.select(*STATION_COLUMNS, *(c for c in extra if c in stations.columns))
