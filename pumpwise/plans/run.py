"""One run over all countries: which sources answer, their adapters, the dimension of sources."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.functions import dims
from pumpwise.operators import lookup
from pumpwise.plans import adapters, publish

#: Countries to which the point-of-interest feed adds stations, and those for which it stands in when their own source is down.
ADDED, STAND_IN = ("DK", "FI"), ("DE", "ES")
_CACHED = ("SE", "DK", "FI")


def source_dim(spark: SparkSession) -> DataFrame:
    """source_ord, country, currency, source, confidence of all countries, in the order of publication."""
    own = {c: (currency, source, sure) for c, currency, source, sure in dims.SOURCES}
    poi = {c[0]: (c[6], dims.POI_SOURCE, c[7]) for c in dims.POI_COUNTRIES}
    rows = [(i, c, *own.get(c, poi.get(c))) for i, c in enumerate(dims.COUNTRY_ORDER)]
    return lookup.dim(spark, rows, "source_ord int, country string, currency string, source string, confidence double")


def poi_scope(available: Mapping[str, bool]) -> list[str]:
    """The countries taken from the point-of-interest feed: those without an own source, the added ones, and those whose own source is down."""
    own = {c for c, *_ in dims.SOURCES}
    return [c[0] for c in dims.POI_COUNTRIES if c[0] not in own or c[0] in ADDED or (c[0] in STAND_IN and not available.get(c[0], False))]


def sources_of(
    spark: SparkSession, raw: Mapping[str, adapters.Raw], run_at: Column, cache: DataFrame | None = None, gazetteer: DataFrame | None = None,
) -> dict[str, Callable[[], DataFrame]]:
    """Country -> lazy stations of each source of a country's own that has landed, for publish.run_all.  raw maps a country to its landed feeds."""
    found: dict[str, Callable[[], DataFrame]] = {}
    for country, adapter in adapters.ADAPTERS.items():
        if country in raw:
            extra = (cache, gazetteer) if country in _CACHED else ()
            found[country] = lambda a=adapter, r=raw[country], x=extra: a(r, run_at, *x)
    return found


def run_sources(
    spark: SparkSession, raw: Mapping[str, adapters.Raw], rates: DataFrame, run_at: Column, staging: str,
    cache: DataFrame | None = None, gazetteer: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """All stations, and the status of each source and of each country that the point-of-interest feed serves.

    First the countries' own sources are written; then, by what happened, the point-of-interest feed for the countries without one and for those
    of STAND_IN whose source is absent, failed, or had no document that can be read.  A source that answers with an empty list is not
    replaced.  The feed's documents are counted while the source is written, in the same pass; the point-of-interest feed is scanned once.
    """
    watches = {c: publish.Watch(c) for c in STAND_IN if c in raw}
    watched = {c: {k: watches[c].feed(v) for k, v in feeds.items()} if c in watches else feeds for c, feeds in raw.items()}
    rows, status = publish.run_all(spark, sources_of(spark, watched, run_at, cache, gazetteer), staging, watches)
    if "POI" not in raw:
        return rows, status
    up = {r["country"]: r["available"] for r in status.select("country", "available").collect()}  # a row a source
    scope = poi_scope(up)
    countries = adapters.poi_countries(spark, scope)
    more, feed = publish.run_all(spark, {"POI": lambda: adapters.points_of_interest(raw["POI"]["stations"], countries, rates, run_at)}, staging)
    return rows.unionByName(more), status.unionByName(feed).withColumn("scope", F.when(F.col("country") == "POI", F.array(*map(F.lit, scope)).cast("array<string>")))


def country_status(status: DataFrame, scope: Sequence[str]) -> DataFrame:
    """country, available: the status of publish.run_all, that of the point-of-interest feed handed to each country of its scope.

    A country that several sources serve is available if one of them is.
    """
    of_feed = status.where("country = 'POI'").select(F.explode(F.array(*map(F.lit, scope)).cast("array<string>")).alias("country"), "available")
    both = status.where("country <> 'POI'").select("country", "available").unionByName(of_feed)
    return both.groupBy("country").agg(F.bool_or("available").alias("available"))
