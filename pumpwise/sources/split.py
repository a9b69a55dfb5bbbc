"""Large JSON documents read by many tasks: cut at closing braces, put together again by the depth at each cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _pieces(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """path, block (offset of the split that a piece begins in), at (its order there), value: the text between closing braces."""
    read = spark.read.option("lineSep", "}").text(path)
    return read.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )


def _running(df: DataFrame, **values: Column) -> DataFrame:
    """df with a column for each name: the sum of its value over all pieces of a file before each one.

    A task sums the pieces of one block; of the blocks of a file, a few rows each, the sums are summed and handed down.
    """
    df = df.withColumns({f"__v_{n}": v for n, v in values.items()})
    blocks = df.groupBy("path", "block").agg(*(F.sum(f"__v_{n}").alias(f"__all_{n}") for n in values))
    before = "coalesce(sum(__all_{}) OVER (PARTITION BY path ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    blocks = blocks.select("path", "block", *(F.expr(before.format(n)).alias(f"__before_{n}") for n in values))
    inside = "coalesce(sum(__v_{}) OVER (PARTITION BY path, block ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    df = df.withColumns({n: F.expr(inside.format(n)) for n in values}).join(blocks, ["path", "block"])
    return df.withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in values}).drop(*(f"__{k}_{n}" for n in values for k in ("v", "before")))


def _outside(parts: Column, first: int) -> Column:
    """Of a text cut at its quotes, the parts outside strings joined: every second one, from the first or the second."""
    return F.array_join(F.filter(parts, lambda _, i: i % 2 == first), "\x00")


def _count(text: Column, c: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))


def split_json_list(spark: SparkSession, path: str | Sequence[str], element: str, key: str | None = None) -> DataFrame:
    """The objects of a JSON list, at the root of each file or under a key of its root object: path, row_ord, x.  Each file is one document.

    The file is split like any text, at closing braces, so that a document of any size is read by as many tasks as it has blocks and no task, row or value
    holds more than a block or an element.  The quotes before a piece tell whether it begins inside a string, the brackets outside strings how deep; both
    are running sums, within a block and over the blocks.  A piece whose closing brace returns to the list's depth ends an element; an element cut by
    pieces or blocks is put together by its number.

    For a well-formed document whose list holds objects only, the result is that of json_list; row_ord counts objects.  An element that does not
    fit the schema has null fields.  Files without the key, empty ones and an empty list give no rows.  What follows a place where
    a document is malformed is undefined, though no error.
    """
    clean = F.regexp_replace("value", r"(?s)\\.", "")
    rows = _pieces(spark, path).withColumn("parts", F.split(clean, '"', -1))
    rows = _running(rows, quotes=F.size("parts") - 1)
    inside = F.pmod(F.col("quotes"), F.lit(2)) == 1
    shown = F.when(inside, _outside(F.col("parts"), 1)).otherwise(_outside(F.col("parts"), 0))
    ends_outside = F.pmod(F.col("quotes") + F.size("parts") - 1, F.lit(2)) == 0
    rows = rows.withColumn("shown", shown).withColumn("closes", ends_outside).drop("parts")
    opened = _count(F.col("shown"), "{") - F.col("closes").cast("int")
    listed = _count(F.col("shown"), "[") - _count(F.col("shown"), "]")
    rows = _running(rows, braces=opened, brackets=listed)
    depth, lists = 1 if key is not None else 0, F.col("brackets") + listed
    rows = rows.withColumn("ends", F.col("closes") & (F.col("braces") + opened == depth) & (lists == 1))
    # Pieces between elements count too: those after a list's last element belong to the next number.
    rows = _running(rows, number=F.col("ends").cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda p: p["value"]), "}")
    whole = rows.groupBy("path", "number").agg(text.alias("text"), F.bool_or("ends").alias("ends")).where("ends")
    # Before an element's own brace stand a comma, or what opens its list: with a key, the last name before the bracket.
    begins = r"(?s)^.*?\[\s*(?=\{)" if key is None else r'(?s)^(?:.*?)"((?:[^"\\]|\\.)*)"\s*:\s*\[\s*(?=\{)'
    opens = r"(?s)^\s*,\s*\{"
    if key is None:
        found = whole.withColumn("first", F.lit(0)).withColumn("last", F.lit(None).cast("bigint"))
    else:
        heads = whole.where(~F.col("text").rlike(opens)).select("path", "number", F.regexp_extract("text", begins, 1).alias("name"))
        heads = heads.select("path", F.col("number").alias("first"), "name", F.expr("lead(number) OVER (PARTITION BY path ORDER BY number)").alias("last"))
        mine = heads.where(F.col("name") == key).groupBy("path").agg(F.min(F.struct("first", "last")).alias("h")).select("path", "h.first", "h.last")
        found = whole.join(mine, "path").where((F.col("number") >= F.col("first")) & (F.col("last").isNull() | (F.col("number") < F.col("last"))))
    own = F.concat(F.when(F.col("text").rlike(opens), F.regexp_replace("text", r"(?s)^\s*,\s*", "")).otherwise(F.regexp_replace("text", begins, "")), F.lit("}"))
    return found.select("path", (F.col("number") - F.col("first")).cast("int").alias("row_ord"), F.from_json(own, element).alias("x")).where("x IS NOT NULL")
