"""Exact deduplication by a 128-bit content hash, with bytes compared inside each hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.llm.common import ascii_lower, checkpoint, read_table, text_or_empty


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  Rows are grouped by
    content_hash (MD5: 128 bits); inside a hash group the normalised texts
    themselves are grouping keys, so texts that merely collide stay apart.
    Grouping starts in each scan task, so a group of copies that holds a third
    of all rows reaches the shuffle as one row per task.  The second join moves
    ids and hashes only, never texts.

    keep names the id that stays, "min" or "max".  A null text counts as empty.
    Null ids never become keep_id unless all ids of the group are null; a row
    with a null id is kept only then.  Rows that repeat the kept id are all
    marked as kept, so there are no ties to break.  Very long texts are compared whole.  Other columns are ignored; an empty table gives no
    rows.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    texts = docs.select(F.col(id_col).alias("id"), ascii_lower(text_or_empty(text_col)).alias("norm"))
    keyed = texts.withColumn("h", F.unhex(content_hash(F.col("norm"))))
    classes = keyed.groupBy("h", "norm").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # Classes that share h differ in bytes; from here on their SHA-256 tells them apart, or the job stops.
    distinct = F.when(F.count(F.lit(1)) == 1, F.sum("n")).otherwise(F.raise_error(F.lit("two texts share both hashes")).cast("long"))
    labels = (
        classes.select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "n")
        .groupBy("h", "sha")
        .agg(pick("keep_id").alias("keep_id"), distinct.alias("group_size"))
    )
    # Written out, so that Spark may split a hot class's rows in the join; under an aggregate it could not.
    labels = checkpoint(labels)
    rows = keyed.select("id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"))
    return rows.join(labels, ["h", "sha"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal texts of every document, the largest doc_id staying."""
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="max")


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
