"""Coordinates from a cache and, for keys never tried, from a gazetteer, a bounded number per country and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pumpwise.functions.scalars import norm_key

#: New lookups per country and run.
LIMIT = 300


def apply_cache(stations: DataFrame, cache: DataFrame, country: str = "country", key: str = "geo_key") -> DataFrame:
    """Coordinates of a cached success replace the station's; a cached failure (null lat) and a blank key change nothing."""
    hits = cache.where("lat IS NOT NULL").select(
        F.col("country").alias("__country"), F.col("key").alias("__key"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon")
    )
    same = (F.col(country) == F.col("__country")) & (F.col(key) == F.col("__key")) & (F.col(key) != "")
    joined = stations.join(hits, same, "left")
    hit = F.col("__lat").isNotNull()
    joined = joined.withColumns(
        {"lat": F.when(hit, F.col("__lat")).otherwise(F.col("lat")), "lon": F.when(hit, F.col("__lon")).otherwise(F.col("lon"))}
    )
    return joined.drop("__country", "__key", "__lat", "__lon")


def backlog(stations: DataFrame, cache: DataFrame, order: list[str], country: str = "country", key: str = "geo_key") -> DataFrame:
    """The first station of each key without coordinates that was never tried; a cached failure counts as tried."""
    tried = cache.select(F.col("country").alias(country), F.col("key").alias(key))
    open_ = stations.where(F.col("lat").isNull() & (F.col(key) != "")).join(tried, [country, key], "left_anti")
    rest = F.struct(*(c for c in open_.columns if c not in (country, key)))
    return open_.groupBy(country, key).agg(F.min_by(rest, F.struct(*order)).alias("__row")).select(country, key, "__row.*")


def take_turn(waiting: DataFrame, order: list[str], limit: int = LIMIT, country: str = "country") -> DataFrame:
    """At most limit rows per country, in order: the work of one run.  Spark keeps limit rows per task before it shuffles."""
    rank = F.expr(f"row_number() OVER (PARTITION BY {country} ORDER BY {', '.join(order)})")
    return waiting.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank")


def left_over(waiting: DataFrame, limit: int = LIMIT, country: str = "country") -> DataFrame:
    """How many rows of each country wait for a later run."""
    return waiting.groupBy(country).agg(F.greatest(F.lit(0).cast("bigint"), F.count(F.lit(1)) - limit).alias("left_over"))


def look_up(queries: DataFrame, gazetteer: DataFrame, query: str = "query") -> DataFrame:
    """queries with lat, lon of the best gazetteer answer; null (a remembered failure) without one.

    query is struct(city, street, postal) or null.  gazetteer: country, street, city, postal, lat, lon, rank.  Street and city
    together come first, then the city alone (or the postal code), in the order of rank.
    """
    best = F.min_by(F.struct("lat", "lon"), F.struct("rank", "lat", "lon"))

    def answers(level: str, keys: dict[str, Column], condition: Column) -> DataFrame:
        found = gazetteer.where(condition).groupBy("country", *(v.alias(f"__{k}") for k, v in keys.items())).agg(best.alias(level))
        return found.withColumnRenamed("country", "__country")

    exact = answers("exact", {"street": norm_key(F.col("street")), "city": norm_key(F.col("city"))}, F.col("street").isNotNull())
    city = answers("by_city", {"city": norm_key(F.col("city"))}, F.col("city").isNotNull())
    postal = answers("by_postal", {"postal": F.col("postal")}, F.col("postal").isNotNull())
    asked = queries.withColumns({
        "__c": norm_key(F.col(f"{query}.city")), "__s": norm_key(F.col(f"{query}.street")), "__p": F.col(f"{query}.postal"),
    })
    here = F.col("country") == F.col("__country")
    out = asked.join(
        exact, here & (F.col("__s") == F.col("__street")) & (F.col("__c") == F.col("__city")) & (F.col("__s") != ""), "left"
    ).drop("__country", "__street", "__city")
    out = out.join(city, here & (F.col("__c") == F.col("__city")) & (F.col("__c") != ""), "left").drop("__country", "__city")
    out = out.join(postal, here & (F.col("__p") == F.col("__postal")) & (F.col("__p") != ""), "left").drop("__country", "__postal")
    answer = F.when(F.col(query).isNotNull(), F.coalesce("exact", "by_city", "by_postal"))
    out = out.withColumn("__a", answer)
    return out.withColumns({"lat": F.col("__a.lat"), "lon": F.col("__a.lon")}).drop(
        "__a", "exact", "by_city", "by_postal", "__c", "__s", "__p"
    )


def grown_cache(cache: DataFrame, attempts: DataFrame) -> DataFrame:
    """The cache and this run's attempts, failures included; an attempt replaces an older entry of its key."""
    new = attempts.select("country", F.col("geo_key").alias("key"), "lat", "lon")
    return cache.join(new, ["country", "key"], "left_anti").unionByName(new)
