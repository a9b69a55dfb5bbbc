"""Publishing: per-country files, index, combined view, geocode cache, summary counts; failure isolation per source."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pumpwise.functions.scalars import iso_timestamp
from pumpwise.operators.geocode import grown_cache
from pumpwise.schema import CACHE, STATION
from pumpwise.staging import Files


def counts(df: DataFrame, group: str) -> DataFrame:
    """Rows per group and in all (group null): one pass."""
    return df.rollup(group).agg(F.count(F.lit(1)).alias("station_count"))


def coverage(df: DataFrame, group: str, **conditions: Column) -> DataFrame:
    """Per group, how many rows meet each condition."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in conditions.items()))


def metas(stations: DataFrame, sources: DataFrame, fetched_at: Column, status: DataFrame | None = None) -> DataFrame:
    """One row per source: country, currency, source, confidence, fetched_at, station_count.  The source's own values stand even if its rows came from a fallback.

    With a status per country (see run.country_status) those that failed are left out; one that answered with nothing is listed with 0.
    """
    if status is not None:
        sources = sources.join(status.where("available").select("country"), "country", "left_semi")
    per = stations.groupBy("country").agg(F.count(F.lit(1)).alias("station_count"))
    joined = sources.join(per, "country", "left")
    return joined.select(
        "source_ord", "country", "currency", "source", "confidence", iso_timestamp(fetched_at).alias("fetched_at"),
        F.coalesce("station_count", F.lit(0).cast("bigint")).alias("station_count")
    )


def index(metas: DataFrame, fetched_at: Column) -> DataFrame:
    """One row: fetched_at, total_stations, countries (metas in registry order)."""
    listed = F.array_sort(
        F.collect_list(F.struct("source_ord", "country", "currency", "source", "confidence", "fetched_at", "station_count"))
    )
    total = F.coalesce(F.sum("station_count"), F.lit(0).cast("bigint"))
    return metas.agg(
        total.alias("total_stations"), F.transform(listed, lambda m: m.dropFields("source_ord")).alias("countries")
    ).select(iso_timestamp(fetched_at).alias("fetched_at"), "total_stations", "countries")


def write_countries(stations: DataFrame, path: str) -> None:
    """Stations as JSON lines, one folder per country: a large country is written by many tasks."""
    shown = stations.withColumn("prices", F.transform("prices", lambda p: p.withField("updated_at", iso_timestamp(p["updated_at"]))))
    shown.withColumn("country_code", F.lower("country")).write.mode("overwrite").partitionBy("country_code").json(path)


def read_combined(spark: SparkSession, path: str) -> DataFrame:
    """The combined view: all countries' files."""
    return spark.read.schema(STATION).json(path)


def country_document(stations: DataFrame, metas: DataFrame) -> DataFrame:
    """Optional export of one nested document {meta, stations} per country, for readers that want single files.

    A country's stations become one row, so this is for countries of some ten thousand stations; write_countries has no such limit.
    """
    listed = stations.groupBy("country").agg(F.sort_array(F.collect_list(F.struct(*STATION.fieldNames()))).alias("stations"))
    meta = metas.select("country", F.struct(*(c for c in metas.columns if c != "source_ord")).alias("meta"))
    return meta.join(listed, "country").select("country", F.to_json(F.struct("meta", "stations")).alias("document"))


def write_index(one: DataFrame, path: str) -> None:
    one.coalesce(1).write.mode("overwrite").json(path)


#: Versions of a cache that stay: the newest, and those before it for readers under way.
KEEP_VERSIONS = 3
_COMMITS = "_commits"


def save_cache(cache: DataFrame, attempts: DataFrame, root: str, keep: int = KEEP_VERSIONS) -> str:
    """The cache grown by this run's attempts as the newest version under root; returns its path.

    The data are written first, into a folder of their own, then a commit file with the next number and that folder's name, renamed into place; of two writers one
    takes the number and the other the next.  Versions beyond the newest keep go, their commits first, and with them what unfinished writings
    older than those left behind.
    """
    files, folder = Files(cache.sparkSession, root), f"version={uuid.uuid1().hex}"
    grown_cache(cache, attempts).write.mode("errorifexists").parquet(f"{root.rstrip('/')}/{folder}")
    while True:
        committed = _commits(files)
        number = max(committed, default=-1) + 1
        if files.put(f"{_COMMITS}/{number:012d}", json.dumps({"folder": folder, "unfinished": _unfinished(files, committed, folder)})):
            break
    for old in sorted({*committed, number})[: -max(1, keep)]:
        commit = json.loads(files.text(f"{_COMMITS}/{old:012d}"))
        files.drop(f"{_COMMITS}/{old:012d}")
        # What was unfinished when an old version was committed, and is still, was given up.
        for name in (commit["folder"], *set(commit["unfinished"]) - {json.loads(files.text(f"{_COMMITS}/{n:012d}"))["folder"] for n in _commits(files)}):
            files.drop(name)
    return f"{root.rstrip('/')}/{folder}"


def _commits(files: Files) -> list[int]:
    return [int(n) for n in files.names(_COMMITS) if n.isdigit()]


def _unfinished(files: Files, committed: Sequence[int], own: str) -> list[str]:
    """Version folders without a commit."""
    done = {json.loads(files.text(f"{_COMMITS}/{n:012d}"))["folder"] for n in committed}
    return [n for n in files.names() if n.startswith("version=") and n not in done and n != own]


def _newest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest committed version under path that can be read whole and has a cache's columns; None if path has no commits."""
    files = Files(spark, path)
    for number in sorted(_commits(files), reverse=True):
        with contextlib.suppress(AnalysisException, ValueError, KeyError, Py4JJavaError):
            folder = json.loads(files.text(f"{_COMMITS}/{number:012d}"))["folder"]
            if "_SUCCESS" not in files.names(folder):
                continue  # its folder is gone or half there
            found = spark.read.parquet(f"{path.rstrip('/')}/{folder}")
            if set(CACHE.fieldNames()) <= set(found.columns):
                return found
    return None


def load_cache(spark: SparkSession, candidates: Sequence[str]) -> DataFrame:
    """The first candidate that is a cache, else an empty one: of a folder of versions the newest, or a table with a cache's columns.

    A version that is not whole is passed over for the one before it, a folder without a whole one for the next candidate.  A table that exists and
    cannot be read is an error.
    """
    for path in candidates:
        if (newest := _newest(spark, path)) is not None:
            return newest.select(*CACHE.fieldNames())
        if any(n.startswith("version=") or n == _COMMITS for n in Files(spark, path).names()):
            continue  # versions, none of them committed and whole
        try:
            found = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise  # a cache that is there but cannot be read must not pass for an empty one
            continue
        if set(CACHE.fieldNames()) <= set(found.columns):
            return found.select(*CACHE.fieldNames())
    return spark.createDataFrame([], CACHE)


STATUS = "country string, available boolean, error string, documents bigint, readable bigint, station_count bigint, with_coordinates bigint, with_prices bigint"


class Watch:
    """What a source's feeds held, counted while its own write reads them."""

    def __init__(self, country: str) -> None:
        self.country, self._seen = country, []

    def feed(self, docs: DataFrame, doc: str = "doc", readable: Column | None = None) -> DataFrame:
        """docs, whose documents and readable ones (by default those that are JSON) are counted as they go by."""
        seen = Observation()
        self._seen.append(seen)
        good = F.try_parse_json(doc).isNotNull() if readable is None else readable
        return docs.observe(seen, F.count(F.lit(1)).alias("documents"), F.count_if(good).alias("readable"))

    def counts(self) -> tuple[int | None, int | None]:
        """Documents and readable ones of the feed with fewest; None if nothing was watched.  After the write only."""
        got = [x.get for x in self._seen]
        return min(((x["documents"], x["readable"]) for x in got), key=lambda x: x[1], default=(None, None))


def run_all(
    spark: SparkSession, adapters: dict[str, Callable[[], DataFrame]], staging: str, watches: Mapping[str, Watch] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Each source written to staging by itself, so that one that fails leaves the others; their union, and a status row per source (STATUS).

    Adapters are lazy: what can go wrong in a source goes wrong in its own write.  The same write counts its stations, those with coordinates and those
    with prices, and by a watch its documents: a watched source none of whose documents can be read is unavailable, one that
    answers with no stations is available.
    """
    status, paths, watches = [], [], watches or {}
    for country, adapter in adapters.items():
        path, made = f"{staging.rstrip('/')}/{country.lower()}", Observation()
        placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
        try:
            rows = adapter().observe(
                made, F.count(F.lit(1)).alias("n"), F.count_if(placed).alias("placed"), F.count_if(F.size("prices") > 0).alias("priced")
            )
            rows.write.mode("overwrite").parquet(path)
            documents, readable = watches[country].counts() if country in watches else (None, None)
        except Exception as e:  # noqa: BLE001  any failure of a source concerns that source only
            status.append((country, False, str(e)[:200], None, None, None, None, None))
            continue
        got = made.get
        if readable == 0:
            status.append((country, False, "no document could be read", documents, readable, 0, 0, 0))
        else:
            status.append((country, True, None, documents, readable, got["n"], got["placed"], got["priced"]))
            paths.append(path)
    union = spark.createDataFrame([], STATION)
    for p in paths:
        union = union.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return union, spark.createDataFrame(status, STATUS)
