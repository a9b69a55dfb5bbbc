"""Order-sensitive deduplication: first wins, last wins, first valid, merged partial answers, ordered lists.

Order is always given by explicit ordinal columns.  Minima and maxima by ordinal are
aggregates, so rows of a key combine before the shuffle and a hot key costs no more than others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pumpwise.operators.ranks import number_rows


def _packed(cols: Sequence[str]) -> Column:
    """One column as it is (numbers then aggregate by hash), several as a struct (by sort)."""
    return F.col(cols[0]) if len(cols) == 1 else F.struct(*cols)


def _unpacked(packed: str, cols: Sequence[str]) -> list[Column]:
    return [F.col(packed).alias(cols[0])] if len(cols) == 1 else [F.col(f"{packed}.{c}") for c in cols]


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(_packed(rest), _packed(order)).alias("__row"))
    return picked.select(*keys, *_unpacked("__row", rest)).select(*df.columns)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, at the position of the first: order columns are those of the first sight."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.max_by(_packed(rest), _packed(order)).alias("__row"), F.min(_packed(order)).alias("__at"))
    return picked.select(*keys, *_unpacked("__row", rest), *_unpacked("__at", order)).select(*df.columns)


def first_then_filter(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """First wins before the condition: a first row that fails it hides later ones."""
    return first_wins(df, keys, order).where(condition)


def first_valid(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """The first row of each key among those that meet the condition."""
    return first_wins(df.where(condition), keys, order)


def ordered_list(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The values of each key as an array in order."""
    listed = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), value.alias("v"))))
    return df.groupBy(*keys).agg(F.transform(listed, lambda x: x["v"]).alias(name))


def merge_partials(df: DataFrame, key: str, order: Sequence[str], prices: str = "prices") -> DataFrame:
    """Partial answers of a key as one: attributes of the first, all fuels, the first price of each.

    Prices are an array of entries with fuel_type.  A price's place is that of its first sight.
    """
    attributes = [c for c in df.columns if c not in (key, prices)]
    first = df.groupBy(key).agg(F.min_by(F.struct(*attributes), _packed(order)).alias("__row"))
    each = df.select(key, *order, F.posexplode(prices).alias("__pos", "__p")).withColumn("__fuel", F.col("__p.fuel_type"))
    best = each.groupBy(key, "__fuel").agg(
        F.min_by("__p", _packed([*order, "__pos"])).alias("__p"), F.min(_packed([*order, "__pos"])).alias("__at")
    )
    listed = ordered_list(best, [key], ["__at"], F.col("__p"), prices)
    return first.join(listed, key, "left").select(key, "__row.*", prices).select(*df.columns)


def group_by_place(df: DataFrame, name: str, lat: str, lon: str, order: Sequence[str], places: int = 4) -> DataFrame:
    """df with place_key: the name and coordinates rounded, under which rows count as one station; and the first row's order as place_at."""
    key = F.concat_ws("|", F.col(name), F.round(F.col(lat), places).cast("string"), F.round(F.col(lon), places).cast("string"))
    keyed = df.withColumn("place_key", key)
    first = keyed.groupBy("place_key").agg(F.min(_packed(order)).alias("place_at"))
    return keyed.join(first, "place_key")


def ordinal_ids(df: DataFrame, partition: Sequence[str], order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Rows numbered from 0 by first sight within a partition (a country), a large one by many tasks.  For parity with sources that number their rows."""
    return number_rows(df, partition, order, name, first=0)


def stable_id(*cols: Column) -> Column:
    """An id from the key itself, the same in every run."""
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 16)
