"""Lookups of source codes: plain, with wildcard, by ordered keywords, overridden, in two hops, excluded, by membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def dim(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table of fixed values, as a literal in the plan.

    Joins with tables carry no hint and count nothing: Spark broadcasts a literal or a file by its known size, and what is
    derived by the size it measures when it runs (adaptive execution), so that building a plan starts no job.
    """
    return spark.createDataFrame(list(rows), schema)


def fuel_dim(spark: SparkSession, fuels: Sequence[tuple[str, str, str]]) -> DataFrame:
    return dim(spark, [(i, *f) for i, f in enumerate(fuels)], "fuel_ord int, fuel_code string, fuel_type string, unit string")


def map_codes(df: DataFrame, code: str, codes: DataFrame, key: str) -> DataFrame:
    """Inner join with a code table: unmapped codes are dropped."""
    return df.join(codes.withColumnRenamed(key, "__code"), F.col(code) == F.col("__code")).drop("__code")


def code_map(pairs: Sequence[tuple[str, str]], key: Column) -> Column:
    """The value of a key in a short list of fixed pairs, in place of a join; null for other keys."""
    return F.try_element_at(F.create_map(*(F.lit(x) for p in pairs for x in p)), key)


def with_wildcard(rules: Sequence[tuple[str, str | None, str]], first: Column, second: Column) -> Column:
    """Composite lookup: the rule for (first, second), else the one for (first, any).  A blank second matches only the latter."""
    exact = F.coalesce(*(F.when((first == a) & (second == b), v) for a, b, v in rules if b is not None), F.lit(None))
    loose = F.coalesce(*(F.when(first == a, v) for a, b, v in rules if b is None), F.lit(None))
    return F.coalesce(exact, loose)


def by_keyword(rules: Sequence[tuple[str, str]], text: Column) -> Column:
    """The value of the first rule whose keyword occurs in the text, upper and lower case alike; null without one."""
    return F.coalesce(*(F.when(F.lower(text).contains(k.lower()), v) for k, v in rules), F.lit(None))


def overridden(code: Column, special: str, name: Column, marker: str, with_marker: str, without: str, otherwise: Column) -> Column:
    """One code depends on whether the name contains a marker (case matters); all others are looked up."""
    return F.when(code == special, F.when(name.contains(marker), with_marker).otherwise(without)).otherwise(otherwise)


def two_hops(facts: DataFrame, key: str, first: DataFrame, first_key: str, link: str, second: DataFrame, second_key: str) -> DataFrame:
    """facts -> first -> second by inner joins; facts that miss either are dropped."""
    hop = facts.join(first, F.col(key) == F.col(first_key))
    return hop.join(second, F.col(link) == F.col(second_key))


def registry_join(registry: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Registry rows and their facts; either without the other is dropped.  Both sides may be large: Spark picks the join."""
    return registry.join(facts, key)


def exclude(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Rows whose value is not in a fixed list; nulls stay."""
    return df.where(~F.coalesce(F.col(column).isin(*names), F.lit(False)))


def members(df: DataFrame, column: str, names: DataFrame, key: str) -> DataFrame:
    """Rows whose value is in a list."""
    return df.join(names.select(F.col(key).alias("__member")), F.col(column) == F.col("__member"), "left_semi")


def of_shape(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose key has the required shape; nulls go."""
    return df.where(F.col(column).rlike(pattern))


def open_stations(df: DataFrame, column: str = "open") -> DataFrame:
    """Stations that are open or do not say."""
    return df.where(F.coalesce(F.col(column), F.lit(True)))


def tagged(df: DataFrame, tag: str, value: str, types: Sequence[str], tags: str = "tags", kind: str = "type") -> DataFrame:
    """Elements of the given types whose tag has the value; one without the tag, or without tags, is none of them."""
    return df.where((F.col(tags)[tag] == value) & F.col(kind).isin(*types))


def of_networks(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Rows whose network is one of a fixed list, whatever its case, blanks and punctuation; nulls go."""
    key = F.regexp_replace(F.lower(F.col(column)), "[^a-z0-9]", "")
    return df.where(key.isin(*("".join(c for c in n.lower() if c.isascii() and c.isalnum()) for n in names)))


def latest_slice(df: DataFrame, period: str, condition: Column) -> DataFrame:
    """Rows that meet the condition, of the latest period among them."""
    chosen = df.where(condition)
    latest = chosen.agg(F.max(period).alias("__latest"))
    return chosen.join(F.broadcast(latest), F.col(period) == F.col("__latest")).drop("__latest")  # one row


def fallback(primary: DataFrame, secondary: DataFrame, status: DataFrame, source: str) -> DataFrame:
    """The primary's rows, and the secondary's where the status table marks their source as unavailable.

    status: source, available.  A source that is available but empty stays empty.
    """
    down = status.where(~F.col("available")).select(F.col(source).alias("__source"))
    up = status.where("available").select(F.col(source).alias("__source"))
    use = primary.join(up, F.col(source) == F.col("__source"), "left_semi")
    return use.unionByName(secondary.join(down, F.col(source) == F.col("__source"), "left_semi"), allowMissingColumns=True)


def union_sources(*parts: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that a part lacks are null; no deduplication across parts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
