"""Rows numbered within a key without gathering the key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pumpwise.staging import staged


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name


def _quoted(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def range_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], part: str) -> DataFrame:
    """df dealt into ranges of (key, order), the number of the range in part, written out so that the ranges stay as they are.

    A key with most rows is cut into as many ranges as its share; only rows equal in key and order keep together.
    """
    return staged(df.repartitionByRange(*_quoted([*keys, *order])).withColumn(part, F.spark_partition_id()))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, first: int = 1) -> DataFrame:
    """df with name: each row's place within its key, from first on, nulls in order before values.

    The table is cut into ranges of (key, order) of about equal size; the rows of a key are counted in each range, the counts of the ranges before are
    summed, and a row's number is that sum plus its place within its range.  A task sorts one range at most, however many rows its
    key has.  Null keys are a key.  Rows equal in key and order are numbered in no fixed order; an empty table gives none.
    """
    part, before = _free(df, "__part"), _free(df, "__before")
    rows = range_parts(df, keys, order, part)
    counts = rows.groupBy(part, *_quoted(keys)).agg(F.count(F.lit(1)).alias("__n"))
    of_key = ", ".join(f"`{k}`" for k in keys)
    sums = f"coalesce(sum(__n) OVER (PARTITION BY {of_key} ORDER BY `{part}` ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    offsets = counts.withColumn(before, F.expr(sums)).select(F.col(part).alias("__p"), *(k.alias(f"__k{i}") for i, k in enumerate(_quoted(keys))), before)
    same = F.col(part) == F.col("__p")
    for i, k in enumerate(_quoted(keys)):
        same = same & k.eqNullSafe(F.col(f"__k{i}"))
    by_order = ", ".join(f"`{c}`" for c in order)
    placed = rows.withColumn(name, F.expr(f"row_number() OVER (PARTITION BY `{part}`, {of_key} ORDER BY {by_order})"))
    numbered = placed.join(offsets, same).withColumn(name, F.col(name).cast("bigint") + F.col(before) + (first - 1))
    return numbered.select(*_quoted(df.columns), name)
