"""Incremental ingestion of pulls with Structured Streaming, the geocode cache carried from batch to batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pumpwise.operators import geocode
from pumpwise.plans.publish import load_cache

#: Batches between two writings of the whole cache.
COMPACT_EVERY = 20


#: Documents of one micro-batch: a backlog is worked off in steps.
FILES_PER_BATCH = 1000


def landed(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH, archive: str | None = None) -> DataFrame:
    """New whole files of a landing folder as documents (path, doc), at most so many in a batch; with an archive, those that are done are moved there."""
    stream = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch)
    if archive:
        stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    stream = stream.load(path)
    return stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))


def ingest(docs: DataFrame, adapter: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each pull's stations under out/batch=<id>; a batch that is repeated after a failure writes the same folder again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        adapter(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_with_cache(
    docs: DataFrame, adapter: Callable[[DataFrame], DataFrame], gazetteer: DataFrame, key: Column, query: Column, out: str, cache_root: str,
    checkpoint: str,
    order: list[str], limit: int = geocode.LIMIT,
) -> StreamingQuery:
    """Like ingest; stations get coordinates from the cache, and at most limit new keys per country and batch are looked up.

    Batch n writes the attempts it made (delta=n), and every COMPACT_EVERY batches the whole cache besides (full=n), so that what is
    written does not grow as batches times cache.  It reads the last full cache before it and the deltas since, so that a repeated batch
    gives the same result; what the last full cache but one superseded is dropped.
    """
    root = cache_root.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cache = cache_before(spark, root, batch_id)
        stations = geocode.apply_cache(adapter(batch).withColumn("geo_key", key), cache).persist()
        try:
            turn = geocode.take_turn(geocode.backlog(stations, cache, order), order, limit).withColumn("query", query)
            attempts = geocode.look_up(turn.select("country", "geo_key", "id", "query"), gazetteer)
            attempts.select("country", F.col("geo_key").alias("key"), "id", "lat", "lon").write.mode("overwrite").parquet(f"{root}/delta={batch_id}")
            attempts = spark.read.parquet(f"{root}/delta={batch_id}")
            new = attempts.where("lat IS NOT NULL").select("country", "id", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
            located = stations.join(new, ["country", "id"], "left").withColumns(
                {"lat": F.coalesce("lat", "__lat"), "lon": F.coalesce("lon", "__lon")}
            )
            located.drop("__lat", "__lon", "geo_key").write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")
            if (batch_id + 1) % COMPACT_EVERY == 0:
                grown = geocode.grown_cache(cache, attempts.withColumnRenamed("key", "geo_key"))
                grown.write.mode("overwrite").parquet(f"{root}/full={batch_id}")
                last, before = batch_id - COMPACT_EVERY, batch_id - 2 * COMPACT_EVERY
                _drop(spark, [f"{root}/full={before}", *(f"{root}/delta={n}" for n in range(max(0, before + 1), last + 1))])
        finally:
            stations.unpersist()

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cache_before(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """The cache that batch batch_id starts from; the same whenever it is asked for, empty before the first batch."""
    full = batch_id // COMPACT_EVERY * COMPACT_EVERY - 1
    paths = [f"{root}/full={full}"] * (full >= 0) + [f"{root}/delta={n}" for n in range(full + 1, batch_id)]
    cache = load_cache(spark, [])
    for path in paths:  # a delta holds only keys never tried before it
        cache = cache.unionByName(spark.read.parquet(path).select(*cache.columns))
    return cache


def _drop(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
