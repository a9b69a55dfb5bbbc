"""Queries: what a run publishes, written to the shared folder and read back; bytes in several charsets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.functions import dims
from pumpwise.plans import publish, run
from pumpwise.queries.registry import Registry, table
from pumpwise.schema import PRICE, STATION_COLUMNS
from pumpwise.sources import raw as R
from pumpwise.staging import shared_folder

REGISTRY = Registry()
RUN_AT, SHOWN_AT = "2026-01-02 03:04:05", "2026-01-02T03:04:05.000000+00:00"
#: Every nation is a country in the order of publication; the rest of that order has no stations.
_COUNTRY = f"([{', '.join(repr(c) for c in dims.COUNTRY_ORDER)}])[c_nationkey + 1]"


PRICE_LIST = f"array<{PRICE.simpleString()}>"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, balance = F.col("c_custkey"), F.col("c_acctbal")
    price = F.struct(F.lit("E5").alias("fuel_type"), balance.alias("price"), F.lit("EUR").alias("currency"), F.lit("L").alias("unit"), F.lit(RUN_AT).cast("timestamp").alias("updated_at"))
    rows = table(spark, sf_dir, "customer").withColumns({
        "id": F.concat(F.lit("x_"), k.cast("string")), "country": F.element_at(F.array(*map(F.lit, dims.COUNTRY_ORDER)), F.col("c_nationkey").cast("int") + 1),
        "name": F.concat(F.lit('"Ä" '), "c_name"), "brand": F.col("c_mktsegment"), "address": F.lit(""), "city": F.lit("C"),
        "lat": F.when(k % 3 > 0, k.cast("double") / 8), "lon": F.when(k % 3 > 0, F.lit(1.5)), "source": F.lit("s"), "confidence": F.lit(0.5),
        "prices": F.when(balance > 0, F.array(price)).otherwise(F.array().cast(PRICE_LIST)),
    })
    return rows.select(*STATION_COLUMNS)


@REGISTRY.add(f"""SELECT 'x_' || c_custkey AS id, {_COUNTRY} AS country, '"Ä" ' || c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey AS DOUBLE) / 8 END AS lat,
  CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS n_prices, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS price, CASE WHEN c_acctbal > 0 THEN '{SHOWN_AT}' END AS updated_at FROM customer""")
def published_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations written country by country and read back as the combined view (SNK-01, SNK-03)."""
    path = _folder(spark, "published")
    publish.write_countries(_stations(spark, sf_dir), path)
    first = F.get("prices", F.lit(0))
    shown = F.date_format(first["updated_at"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return publish.read_combined(spark, path).select("id", "country", "name", "lat", F.size("prices").alias("n_prices"), first["price"].alias("price"), shown.alias("updated_at"))


_DOWN = dims.COUNTRY_ORDER[3]
_ORDER = ", ".join(f"({i}, '{c}')" for i, c in enumerate(dims.COUNTRY_ORDER))


@REGISTRY.add(f"""WITH o(place, country) AS (VALUES {_ORDER}), n AS (SELECT {_COUNTRY} AS country, count(*) AS station_count FROM customer GROUP BY ALL),
m AS (SELECT place, country, coalesce(station_count, 0) AS station_count FROM o LEFT JOIN n USING (country) WHERE country <> '{_DOWN}')
SELECT '{SHOWN_AT}' AS fetched_at, sum(station_count) OVER ()::BIGINT AS total_stations, CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS place, country, station_count FROM m""")
def published_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index as written and read back: a source that failed is left out, one without stations is listed with 0 (SNK-02, AGG-09)."""
    sources, at, path = run.source_dim(spark), F.lit(RUN_AT).cast("timestamp"), _folder(spark, "index")
    metas = publish.metas(_stations(spark, sf_dir), sources, at, sources.select("country", (F.col("country") != _DOWN).alias("available")))
    one = publish.index(metas, at)
    publish.write_index(one, path)
    back = spark.read.schema(one.schema).json(path).select("fetched_at", "total_stations", F.posexplode("countries").alias("place", "m"))
    return back.select("fetched_at", "total_stations", "place", "m.country", "m.station_count")


@REGISTRY.add("""SELECT 'X' AS country, c_name AS key, CASE WHEN c_custkey % 5 = 0 THEN -1 WHEN c_custkey % 3 = 0 THEN c_acctbal END AS lat FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 = 0""")
def cache_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs grow the geocode cache; the newest whole version is what the next run reads (SNK-04, SNK-05)."""
    k, root = F.col("c_custkey"), _folder(spark, "cache")
    rows = table(spark, sf_dir, "customer").select(F.lit("X").alias("country"), F.col("c_name").alias("geo_key"), F.col("c_acctbal").alias("lat"), k, F.lit(1.0).alias("lon"))
    first = rows.where(k % 2 == 0).select("country", "geo_key", F.when(k % 3 == 0, F.col("lat")).alias("lat"), F.when(k % 3 == 0, F.col("lon")).alias("lon"))
    second = rows.where(k % 5 == 0).select("country", "geo_key", F.lit(-1.0).alias("lat"), "lon")
    none = publish.load_cache(spark, [root])
    publish.save_cache(none, first, root)
    publish.save_cache(publish.load_cache(spark, [root]), second, root)
    return publish.load_cache(spark, [root]).select("country", "key", "lat")


@REGISTRY.add("""SELECT c_custkey, c_name || ' Malmö Ærø' AS name, c_name || ' €“ž”' || chr(65533) AS legacy FROM customer""")
def charset_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in UTF-8 with or without a mark, latin-1 told by not being UTF-8, and windows-1252 with a byte that it does not have (SRC-04)."""
    k, text = F.col("c_custkey"), F.concat("c_name", F.lit(" Malmö Ærø"))
    utf8 = F.encode(text, "UTF-8")
    content = F.when(k % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).when(k % 3 == 1, F.encode(text, "ISO-8859-1")).otherwise(utf8)
    old = F.concat(F.encode("c_name", "UTF-8"), F.unhex(F.lit("2080939E9481")))
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", R.decode(content).alias("name"), R.decode(old, "windows-1252").alias("legacy"))
