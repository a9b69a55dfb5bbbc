"""Daily summaries of pulls as they land: event time, late rows, repeated pulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

#: Files of one micro-batch, and how long after the newest row seen rows may still come.
FILES_PER_BATCH, LATE = 1000, "2 days"


def landed_rows(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = FILES_PER_BATCH, archive: str | None = None, kind: str = "parquet"
) -> DataFrame:
    """New files of rows in a landing folder, at most so many in a batch, so that a backlog is worked off in bounded steps.  With an archive, files
    that are done are moved there; without one they stay."""
    stream = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if archive:
        stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return stream.load(path)


def daily_rows(pulls: DataFrame, keys: list[str], at: str, identity: list[str], price: str = "price", late: str = LATE) -> DataFrame:
    """keys, day, n, low, high of a stream of pulls; see summarise_days."""
    seen = pulls.where(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([*identity])
    return seen.groupBy(F.window(at, "1 day").alias("day"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(price).alias("low"), F.max(price).alias("high")
    ).select(*keys, F.col("day.start").cast("date").alias("day"), "n", "low", "high")


def summarise_days(
    pulls: DataFrame, keys: list[str], at: str, identity: list[str], out: str, checkpoint: str, price: str = "price", late: str = LATE
) -> StreamingQuery:
    """Each day's summary appended to out once, as Parquet, when the day is over by more than late; for all that has landed, then stops.

    Time is that of the rows, not of their arrival.  The watermark is the newest time of all batches before, less late: rows older than it are too
    late and dropped, days that end by it are final.  A row that has come before, by identity, is dropped if it comes again while it
    would still be accepted, so a pull that is repeated counts once.  State is kept for the open days and for the rows of the last late only.  A day that
    has not ended by the watermark waits for the next call with the same checkpoint.  Rows without a time are dropped.
    """
    rows = daily_rows(pulls, keys, at, identity, price, late)
    return rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
