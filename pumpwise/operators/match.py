"""Greedy one-to-one matching of priced records with known locations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pumpwise.operators.ranks import number_rows


def _numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all keys filled, numbered within the key as __n (a hot key by many tasks); and the others, which never match."""
    full = F.lit(True)
    for k in keys:
        full = full & F.coalesce(F.col(k) != "", F.lit(False))
    return number_rows(df.where(full), keys, order, "__n"), df.where(~full)


Numbered = tuple[DataFrame, DataFrame]


def _matched(locations: Numbered, records: Numbered, columns: Sequence[str], keys: Sequence[str], take: Sequence[str]) -> DataFrame:
    (left, blank), (right, _) = locations, records
    right = right.select(*keys, "__n", *(F.col(c).alias(f"__{c}") for c in take), F.lit(True).alias("__hit"))
    joined = left.join(right, [*keys, "__n"], "left").withColumn("matched", F.coalesce("__hit", F.lit(False)))
    for c in take:
        joined = joined.withColumn(c, F.when(F.col("matched"), F.col(f"__{c}")).otherwise(F.col(c)) if c in columns else F.col(f"__{c}"))
    names = [*columns, *(c for c in take if c not in columns), "matched"]
    return joined.select(*names).unionByName(blank.withColumn("matched", F.lit(False)), allowMissingColumns=True)


def _left_over(locations: Numbered, records: Numbered, keys: Sequence[str]) -> DataFrame:
    right, blank = records
    return right.join(locations[0].select(*keys, "__n"), [*keys, "__n"], "left_anti").drop("__n").unionByName(blank)


def match_slots(
    locations: DataFrame, records: DataFrame, keys: Sequence[str], location_order: Sequence[str], record_order: Sequence[str],
    take: Sequence[str]
) -> DataFrame:
    """All locations; the i-th of a key has the take columns of the i-th record of that key, and matched is true.

    Filled before the window, blank keys neither match nor skew it.
    """
    return _matched(_numbered(locations, keys, location_order), _numbered(records, keys, record_order), locations.columns, keys, take)


def unmatched_records(
    locations: DataFrame, records: DataFrame, keys: Sequence[str], location_order: Sequence[str], record_order: Sequence[str]
) -> DataFrame:
    """Records without a location: those beyond the number of locations of their key, and those with a blank key."""
    return _left_over(_numbered(locations, keys, location_order), _numbered(records, keys, record_order), keys)


def match_and_rest(
    locations: DataFrame, records: DataFrame, keys: Sequence[str], location_order: Sequence[str], record_order: Sequence[str],
    take: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """match_slots and unmatched_records of the same tables: each is sorted, written and numbered once for both."""
    left, right = _numbered(locations, keys, location_order), _numbered(records, keys, record_order)
    return _matched(left, right, locations.columns, keys, take), _left_over(left, right, keys)
