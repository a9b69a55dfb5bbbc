"""Queries: whole adapters over feeds that Spark makes from the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.functions import dims
from pumpwise.operators import lookup
from pumpwise.plans import adapters
from pumpwise.queries.registry import Registry, table

REGISTRY = Registry()
#: Stations of one answer, and the time that all prices carry.
PAGE_ROWS, RUN_AT = 1000, "2026-01-02 03:04:05"


def _answers(rows: DataFrame, keys: list[str], station: Column) -> DataFrame:
    """One answer per key: the keys, x (stations in the order of c_custkey), shard_ord."""
    listed = F.array_sort(F.collect_list(F.struct("c_custkey", station.alias("v"))))
    answers = rows.groupBy(*keys).agg(F.transform(listed, lambda e: e["v"]).alias("x"))
    return answers.withColumns({"shard_ord": F.struct(*keys), "path": F.concat_ws("-", *(F.col(k).cast("string") for k in keys))})


def _shown(stations: DataFrame) -> DataFrame:
    """A row per price, with what tells stations apart."""
    rows = stations.select("id", "name", "brand", "address", "city", "lat", "lon", F.posexplode("prices").alias("price_ord", "p"))
    return rows.select("id", "name", "brand", "address", "city", "lat", "lon", "price_ord", "p.fuel_type", "p.price", "p.currency", "p.unit")


@REGISTRY.add(f"""
WITH s AS (
  SELECT c_nationkey AS n, c_custkey // {PAGE_ROWS} AS page, c_custkey, 'de_' || (c_custkey // 2) AS id, c_mktsegment || ' ' || c_name AS name, c_mktsegment AS brand,
         CASE WHEN c_custkey % 3 = 0 THEN 'Street' ELSE 'Street ' || c_custkey END AS address, 'City' || c_nationkey AS city, 47 + CAST(c_nationkey AS DOUBLE) / 8 AS lat, 9.5::DOUBLE AS lon,
         [struct_pack(f := 'E5', p := c_acctbal), struct_pack(f := 'E10', p := CASE WHEN c_custkey % 3 > 0 THEN c_acctbal - 1000 END),
          struct_pack(f := 'DIESEL', p := CASE WHEN c_custkey % 5 = 0 THEN 1.5::DOUBLE ELSE 0 END)] AS all_prices
  FROM customer WHERE c_nationkey % 5 <> 4
), v AS (SELECT *, list_filter(all_prices, lambda x: x.p > 0) AS prices FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n, page, c_custkey) AS rn FROM v WHERE len(prices) > 0)
SELECT id, name, brand, address, city, lat, lon, CAST(i AS INTEGER) AS price_ord, prices[i + 1].f AS fuel_type, prices[i + 1].p AS price, 'EUR' AS currency, 'L' AS unit
FROM (SELECT *, unnest(range(len(prices))) AS i FROM f WHERE rn = 1)""")
def adapter_germany(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers per area that are not ok go, a station is taken from the first area that prices it, invalid prices go (section 2.12, DE)."""
    key, price = F.col("c_custkey"), F.col("c_acctbal")
    station = F.struct(
        F.floor(key / 2).cast("string").alias("id"), F.col("c_mktsegment").alias("brand"), F.col("c_name").alias("name"),
        F.lit("Street").alias("street"), F.when(key % 3 > 0, key.cast("string")).alias("houseNumber"),
        F.concat(F.lit("City"), F.col("c_nationkey").cast("string")).alias("place"),
        (F.lit(47) + F.col("c_nationkey").cast("double") / 8).alias("lat"), F.lit(9.5).alias("lng"), price.alias("e5"),
        F.when(key % 3 > 0, price - 1000).alias("e10"), F.when(key % 5 == 0, 1.5).otherwise(0.0).alias("diesel"),
    )
    rows = table(spark, sf_dir, "customer").withColumn("page", F.floor(key / PAGE_ROWS))
    answers = _answers(rows, ["c_nationkey", "page"], station)
    doc = F.to_json(F.struct((F.col("c_nationkey") % 5 != 4).alias("ok"), F.col("x").alias("stations")))
    areas = answers.select("path", "shard_ord", doc.alias("doc"))
    return _shown(adapters.germany({"areas": areas}, F.lit(RUN_AT).cast("timestamp")))


@REGISTRY.add(f"""
WITH fuels(fuel, ord, fuel_type) AS (VALUES ('2101', 0, 'DIESEL'), ('3201', 1, 'E5'), ('3400', 2, 'E5')),
s AS (
  SELECT fuel, ord, fuel_type, c_custkey // {PAGE_ROWS} AS page, c_custkey, 'pt_' || (c_custkey // 2) AS id, c_name AS name, c_mktsegment AS brand, 'Rua ' || fuel AS address, 'Town' || c_nationkey AS city,
         CAST(360 + c_custkey % 90 AS DOUBLE) / 10 AS y, c_acctbal AS price
  FROM customer, fuels WHERE c_custkey % 3 <> ord AND c_acctbal > 0
), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord, page, c_custkey) AS n, row_number() OVER (PARTITION BY id, fuel_type ORDER BY ord, page, c_custkey) AS m FROM s)
SELECT a.id, a.name, a.brand, a.address, a.city, CASE WHEN a.y <= 43 THEN a.y END AS lat, CASE WHEN a.y <= 43 THEN -8.5::DOUBLE END AS lon,
       CAST(row_number() OVER (PARTITION BY p.id ORDER BY p.n) - 1 AS INTEGER) AS price_ord, p.fuel_type, p.price, 'EUR' AS currency, 'L' AS unit
FROM r p JOIN r a ON a.id = p.id AND a.n = 1 WHERE p.m = 1""")
def adapter_portugal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers per fuel merged by station: the first answer's attributes, all fuels, the first valid price of each (section 2.12, PT)."""
    key = F.col("c_custkey")
    fuels = F.explode(F.array(*(F.struct(F.lit(f).alias("fuel"), F.lit(i).alias("ord")) for i, f in enumerate(("2101", "3201", "3400")))))
    rows = table(spark, sf_dir, "customer").withColumns({"page": F.floor(key / PAGE_ROWS), "f": fuels}).select("*", "f.fuel", "f.ord")
    tenths = F.lit(360) + key % 90
    station = F.struct(
        F.floor(key / 2).cast("string").alias("Id"), F.col("c_name").alias("Nome"), F.concat(F.lit(" "), "c_mktsegment").alias("Marca"),
        F.concat(F.lit("Rua "), "fuel").alias("Morada"), F.concat(F.lit("Town"), F.col("c_nationkey").cast("string")).alias("Municipio"),
        F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")).alias("Latitude"), F.lit("-8.5").alias("Longitude"),
        F.concat(F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")), F.lit(" €")).alias("Preco"),
    )
    answers = _answers(rows.where(key % 3 != F.col("ord")), ["ord", "fuel", "page"], station)
    doc = F.to_json(F.struct(F.lit(True).alias("status"), F.col("x").alias("resultado")))
    return _shown(adapters.portugal({"fuels": answers.select("path", "fuel", "shard_ord", doc.alias("doc"))}, F.lit(RUN_AT).cast("timestamp")))


def _pick(names: Sequence[str], place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (place + 1).cast("int"))


def _sql_pick(names: Sequence[str], place: str) -> str:
    return "([" + ", ".join(f"'{n}'" for n in names) + f"])[({place}) + 1]"


def _page(key: str) -> Column:
    """The page of a row, so that pages sort as texts, too."""
    return F.lpad(F.floor(F.col(key) / PAGE_ROWS).cast("string"), 9, "0").alias("page")


def _whole(stations: DataFrame, *extra: str) -> DataFrame:
    """A row per price, one for a station without any, with the origin that each station claims."""
    own = ["id", "name", "brand", "address", "city", "lat", "lon", "source", "confidence", *extra]
    rows = stations.select(*own, F.posexplode_outer("prices").alias("price_ord", "p"))
    return rows.select(*own, "price_ord", "p.fuel_type", "p.price", "p.currency", "p.unit")


SE_MAP_BRANDS, SE_PRICE_BRANDS = ["Shell", "St1", "OKQ8", "Statoil Nord", "Preem"], ["st1", "okq8", "circlek", "preem", "ingo"]
SE_MAP_CITIES, SE_PRICE_CITIES = ["LUND", "Boden", "Kalmar", "Umeå"], ["Lund", "Boden", "Kalmar", "Umea"]


@REGISTRY.add(f"""
WITH e AS (
  SELECT s_suppkey AS pos, s_suppkey - CAST(s_suppkey % 5 = 4 AS INTEGER) AS id, {_sql_pick(SE_MAP_BRANDS, 's_suppkey % 5')} AS brand,
         CASE WHEN s_suppkey % 13 = 12 THEN '' ELSE {_sql_pick(SE_MAP_CITIES, 's_suppkey // 5 % 4')} END AS city,
         {_sql_pick(["st1", "st1", "okq8", "circlek", "preem"], 's_suppkey % 5')} AS bk, {_sql_pick(["lund", "boden", "kalmar", "umea"], 's_suppkey // 5 % 4')} AS ck,
         CASE WHEN s_suppkey % 10 <> 3 THEN 55 + CAST(s_suppkey % 80 AS DOUBLE) / 8 END AS lat
  FROM supplier WHERE s_suppkey % 11 <> 10 AND s_suppkey % 17 <> 16
), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS copy FROM e) WHERE copy = 1 AND lat IS NOT NULL),
l AS (SELECT *, CASE WHEN city <> '' THEN row_number() OVER (PARTITION BY bk, ck, city = '' ORDER BY pos) END AS slot FROM f),
posts AS (
  SELECT c_nationkey AS n, c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS p95, CASE WHEN c_acctbal > 1000 THEN c_acctbal - 1000 END AS diesel FROM customer
  UNION ALL SELECT (c_nationkey + 1) % 25, c_custkey, c_custkey % 100 + 0.5::DOUBLE, NULL FROM customer WHERE c_custkey % 4 = 0),
s AS (
  SELECT k, min(n) AS first_n, max(n) AS last_n, max_by(p95, n) FILTER (WHERE p95 IS NOT NULL) AS p95, max(diesel) AS diesel, any_value(c_nationkey) AS home
  FROM posts JOIN customer ON c_custkey = k WHERE p95 IS NOT NULL OR diesel IS NOT NULL GROUP BY k),
r AS (
  SELECT *, {_sql_pick(SE_PRICE_BRANDS, 'k % 5')} AS bk, {_sql_pick(SE_PRICE_CITIES, 'k // 5 % 4')} AS city,
         row_number() OVER (PARTITION BY k % 5, k // 5 % 4 ORDER BY first_n, k // {PAGE_ROWS}, k) AS slot FROM s),
out AS (
  SELECT 'se_osm_' || id AS id, l.brand AS name, l.brand, 'Väg ' || pos AS address, l.city, l.lat, 13.0::DOUBLE AS lon, CASE WHEN k IS NULL THEN 'openstreetmap.org' ELSE 'bensinpriser.nu' END AS source,
         CASE WHEN k IS NULL THEN 0.75 ELSE 0.85 END::DOUBLE AS confidence, NULL AS county, p95, diesel
  FROM l LEFT JOIN r ON l.bk = r.bk AND l.ck = lower(r.city) AND l.slot = r.slot
  UNION ALL
  SELECT 'se_county' || home || '_' || r.bk || '_' || city || 'Gatan' || k, r.bk || ' · Gatan, ' || city, r.bk, 'Gatan', city, 60 + CAST(k % 40 AS DOUBLE) / 8, 14.5::DOUBLE, 'bensinpriser.nu', 0.85::DOUBLE,
         'county' || last_n, p95, diesel
  FROM r WHERE k % 3 = 0 AND k % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM l WHERE l.bk = r.bk AND l.ck = lower(r.city) AND l.slot = r.slot)),
prices AS (SELECT *, list_filter([struct_pack(f := 'E10', p := p95), struct_pack(f := 'DIESEL', p := diesel)], lambda x: x.p IS NOT NULL) AS ps FROM out)
SELECT id, name, brand, address, city, lat, lon, source, confidence, county, CASE WHEN len(ps) > 0 THEN CAST(i AS INTEGER) END AS price_ord,
       ps[i + 1].f AS fuel_type, ps[i + 1].p AS price, CASE WHEN len(ps) > 0 THEN 'SEK' END AS currency, CASE WHEN len(ps) > 0 THEN 'L' END AS unit
FROM (SELECT *, unnest(range(greatest(len(ps), 1))) AS i FROM prices)""")
def adapter_sweden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map elements take the prices of the records of their brand and city one to one; leftovers stay where the cache knows them (section 2.12, SE; PRJ-04)."""
    s = F.col("s_suppkey")
    lat, lon = F.when(s % 10 != 3, F.lit(55) + (s % 80).cast("double") / 8), F.lit(13.0)
    way = s % 3 == 0
    element = F.struct(
        (s - (s % 5 == 4).cast("int")).alias("id"), F.when(s % 17 == 16, "relation").when(way, "way").otherwise("node").alias("type"),
        F.when(~way, lat).alias("lat"), F.when(~way, lon).alias("lon"), F.when(way, F.struct(lat.alias("lat"), lon.alias("lon"))).alias("center"),
        F.struct(
            F.when(s % 11 == 10, "cafe").otherwise("fuel").alias("amenity"), _pick(SE_MAP_BRANDS, s % 5).alias("brand"),
            F.when(s % 13 != 12, _pick(SE_MAP_CITIES, F.floor(s / 5) % 4)).alias("addr:city"), F.lit("Väg").alias("addr:street"),
            s.cast("string").alias("addr:housenumber"),
        ).alias("tags"),
    )
    elements = table(spark, sf_dir, "supplier").select("*", _page("s_suppkey"), s.alias("c_custkey"))
    osm = _answers(elements, ["page"], element).select("path", F.to_json(F.struct(F.col("x").alias("elements"))).alias("doc"))
    k, n, balance = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
    geo_key = F.concat(_pick(SE_PRICE_CITIES, F.floor(k / 5) % 4), F.lit("Gatan"), k.cast("string"))
    station = F.concat(F.lit("county"), n.cast("string"), F.lit("_"), _pick(SE_PRICE_BRANDS, k % 5), F.lit("_"), geo_key)
    field = (lambda code, value: F.concat(F.lit('"'), station, F.lit(f'__{code}":'), value))
    quoted = F.concat(F.lit('"'), F.replace(balance.cast("string"), F.lit("."), F.lit(",")), F.lit('"'))
    customers = table(spark, sf_dir, "customer").select("*", _page("c_custkey"))
    own = customers.withColumns({"n": n, "entry": F.concat_ws(",", field("95", quoted), field("diesel", (balance - 1000).cast("string")), field("odd", F.lit("3")))})
    again = customers.where(k % 4 == 0).withColumns({"n": (n + 1) % 25, "entry": field("95", F.concat((k % 100).cast("string"), F.lit(".5")))})
    answers = _answers(own.unionByName(again), ["n", "page"], F.col("entry"))
    doc = F.concat(F.lit("{"), F.array_join("x", ","), F.lit("}"))
    counties = answers.select("path", "shard_ord", F.concat(F.lit("county"), F.col("n").cast("string")).alias("county"), doc.alias("doc"))
    cache = customers.where(k % 3 == 0).select(
        F.lit("SE").alias("country"), geo_key.alias("key"), F.when(k % 7 != 0, F.lit(60) + (k % 40).cast("double") / 8).alias("lat"),
        F.when(k % 7 != 0, F.lit(14.5)).alias("lon")
    )
    return _whole(adapters.sweden({"osm": osm, "counties": counties}, F.lit(RUN_AT).cast("timestamp"), cache), "county")


IT_CODES = ["Benzina", "Gasolio", "Gasolio BTZ", "GPL", "Metano", "HVO", "Kerosene", "benzina"]


@REGISTRY.add(f"""
WITH g AS (
  SELECT c_custkey // 2 AS sid, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE c_mktsegment END AS brand, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'Nome ' || c_custkey END AS shown,
         'Via ' || c_custkey AS address, 'Comune' || c_nationkey AS city, CAST(340 + c_custkey % 150 AS DOUBLE) / 10 AS y, row_number() OVER (PARTITION BY c_custkey // 2 ORDER BY c_custkey DESC) AS rn
  FROM customer WHERE c_custkey % 19 <> 18
), p AS (
  SELECT o_custkey AS sid, o_orderkey AS pos, CASE o_orderkey % 8 WHEN 0 THEN 'E5' WHEN 1 THEN 'DIESEL' WHEN 2 THEN 'DIESEL' WHEN 3 THEN 'LPG' WHEN 4 THEN 'CNG' ELSE 'HVO100' END AS fuel_type, o_totalprice AS price
  FROM orders WHERE o_orderkey % 8 < 6 AND o_orderkey % 7 <> 0
), v AS (SELECT *, row_number() OVER (PARTITION BY sid, fuel_type ORDER BY pos) AS rn FROM p)
SELECT 'it_' || g.sid AS id, shown AS name, brand, address, city, CASE WHEN y BETWEEN 35 AND 48 THEN y END AS lat, CASE WHEN y BETWEEN 35 AND 48 THEN 9.5::DOUBLE END AS lon, 'mimit.gov.it' AS source, 0.9::DOUBLE AS confidence,
       CAST(row_number() OVER (PARTITION BY g.sid ORDER BY pos) - 1 AS INTEGER) AS price_ord, fuel_type, price, 'EUR' AS currency, CASE fuel_type WHEN 'CNG' THEN 'kg' ELSE 'L' END AS unit
FROM g JOIN v ON v.sid = g.sid WHERE g.rn = 1 AND v.rn = 1""")
def adapter_italy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two delimited files with a preamble: the registry's last line of an id, joined to the first valid price of each fuel (section 2.12, IT)."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    tenths = F.lit(340) + k % 150
    fields = [
        F.when(k % 19 == 18, "").otherwise(F.floor(k / 2).cast("string")), F.col("c_name"), F.when(k % 4 == 0, "").otherwise(F.col("c_mktsegment")), F.lit("Stradale"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Nome "), k.cast("string"))), F.concat(F.lit("Via "), k.cast("string")),
        F.concat(F.lit("Comune"), F.col("c_nationkey").cast("string")), F.lit("XX"),
        F.concat(F.floor(tenths / 10).cast("string"), F.lit(","), (tenths % 10).cast("string")), F.lit("9,5"),
    ]
    price = F.when(o % 7 == 0, "0").otherwise(F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(",")))
    offers = [F.col("o_custkey").cast("string"), _pick(IT_CODES, o % 8), price, F.lit("1"), F.lit("02/01/2026 03:04:05")]

    def lines(rows: DataFrame, key: Column, columns: list[str], values: list[Column]) -> DataFrame:
        body = rows.select(F.lit("f").alias("path"), key.cast("bigint").alias("line_ord"), F.concat_ws("|", *values).alias("value"))
        head = lookup.dim(spark, [("f", -2, "Estrazione del 2026-01-02"), ("f", -1, "|".join(columns))], "path string, line_ord bigint, value string")
        return body.unionByName(head)

    raw = {
        "registry": lines(table(spark, sf_dir, "customer"), k, adapters.IT_REGISTRY, fields),
        "prices": lines(table(spark, sf_dir, "orders"), o, adapters.IT_PRICES, offers),
    }
    return _whole(adapters.italy(raw, F.lit(RUN_AT).cast("timestamp")))


@REGISTRY.add("""
WITH s AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE c_mktsegment END AS brand, c_nationkey,
         list_filter([struct_pack(f := 'DIESEL', p := c_acctbal), struct_pack(f := 'E5', p := CASE WHEN c_custkey % 2 = 1 AND c_acctbal > 1000 THEN c_acctbal - 1000 ELSE c_custkey % 50 + 0.5::DOUBLE END),
                      struct_pack(f := 'LPG', p := CASE WHEN c_custkey % 5 = 0 THEN 1.25::DOUBLE END)], lambda x: x.p > 0) AS ps
  FROM customer)
SELECT 'fr_' || k AS id, brand AS name, brand, 'Rue ' || k AS address, 'Ville' || c_nationkey AS city,
       CASE WHEN k % 3 = 0 THEN 48.5::DOUBLE WHEN k % 3 = 1 THEN 44 + CAST(k % 16 AS DOUBLE) / 8 END AS lat, CASE WHEN k % 3 = 0 THEN 2.25::DOUBLE WHEN k % 3 = 1 THEN 3.5::DOUBLE END AS lon,
       'data.economie.gouv.fr' AS source, 0.95::DOUBLE AS confidence, CAST(i AS INTEGER) AS price_ord, ps[i + 1].f AS fuel_type, ps[i + 1].p AS price, 'EUR' AS currency, 'L' AS unit
FROM (SELECT *, unnest(range(len(ps))) AS i FROM s)""")
def adapter_france(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide records, in a list or under one of two keys: the first valid of the columns of a fuel, coordinates scaled where they need it (section 2.12, FR)."""
    k, balance = F.col("c_custkey"), F.col("c_acctbal")
    text = (lambda c: c.cast("string"))
    geom = F.struct(text(F.lit(44) + (k % 16).cast("double") / 8).alias("lat"), F.lit("3.5").alias("lon"))
    station = F.struct(
        text(k).alias("id"), F.when(k % 4 != 0, F.concat(F.lit(" "), "c_mktsegment")).alias("nom_marque"), F.col("c_name").alias("nom"),
        F.concat(F.lit("Rue "), text(k)).alias("adresse"), F.concat(F.lit("Ville"), text(F.col("c_nationkey")), F.lit(" ")).alias("ville"),
        F.when(k % 3 == 1, geom).alias("geom"), F.when(k % 3 == 0, "4850000").alias("latitude"), F.when(k % 3 == 0, "225000").alias("longitude"),
        text(balance).alias("gazole_prix"), F.when(k % 2 == 1, text(balance - 1000)).alias("sp95_prix"),
        F.concat(text(k % 50), F.lit(".5")).alias("sp98_prix"), F.lit("n/a").alias("e10_prix"), F.lit("0").alias("e85_prix"),
        F.when(k % 5 == 0, "1.25").alias("gplc_prix"),
    )
    answers = _answers(table(spark, sf_dir, "customer").select("*", _page("c_custkey"), (k % 3).alias("third")), ["page", "third"], station)
    doc = F.when(F.col("third") == 0, F.to_json("x")).when(F.col("third") == 1, F.to_json(F.struct(F.col("x").alias("results"))))
    doc = doc.otherwise(F.to_json(F.struct(F.array().cast("array<string>").alias("results"), F.col("x").alias("records"))))
    return _whole(adapters.france({"stations": answers.select("path", doc.alias("doc"))}, F.lit(RUN_AT).cast("timestamp")))


RO_BRANDS = [*dims.RO_NETWORKS, "Other one", "Other two", "", "Om"]


@REGISTRY.add(f"""
WITH r AS (
  SELECT ord, c_nationkey AS n, c_custkey AS k, {_sql_pick(RO_BRANDS, f'c_custkey % {len(RO_BRANDS)}')} AS brand, CAST(430 + c_custkey % 60 AS DOUBLE) / 10 AS lat, CASE WHEN ord = 0 THEN c_acctbal ELSE c_acctbal - 1000 END AS price,
         ([ 'E5', 'DIESEL', 'LPG' ])[ord + 1] AS fuel_type
  FROM customer, (VALUES (0), (1), (2)) f(ord) WHERE c_custkey % {len(RO_BRANDS)} < {len(dims.RO_NETWORKS)} AND (ord < 2 OR c_custkey % 2 = 0)
), v AS (SELECT *, brand || '|' || lat || '|25.5' AS key FROM r WHERE price > 0 AND lat BETWEEN 43.5 AND 48.4),
a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord, n, k // {PAGE_ROWS}, k) AS first, row_number() OVER (PARTITION BY key, fuel_type ORDER BY ord, n, k // {PAGE_ROWS}, k) AS m FROM v)
SELECT 'ro_' || sha256(p.key)[:16] AS id, s.brand AS name, s.brand, 'Strada ' || s.k AS address, 'Oras' || s.n AS city, s.lat, 25.5::DOUBLE AS lon, 'peco-online.ro' AS source, 0.9::DOUBLE AS confidence,
       CAST(row_number() OVER (PARTITION BY p.key ORDER BY p.first) - 1 AS INTEGER) AS price_ord, p.fuel_type, p.price, 'RON' AS currency, 'L' AS unit
FROM a p JOIN a s ON s.key = p.key AND s.first = 1 WHERE p.m = 1""")
def adapter_romania(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals in page script, fuel by fuel: listed networks, one station per brand and rounded place, its first price of each fuel (section 2.12, RO)."""
    k, ord_ = F.col("c_custkey"), F.col("ord")
    tenths = F.lit(430) + k % 60
    quoted = (lambda *c: F.concat(F.lit('"'), *c, F.lit('"')))
    fuels = F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(c).alias("fuel")) for i, (c, _, _) in enumerate(dims.RO_FUELS))))
    rows = table(spark, sf_dir, "customer").select("*", _page("c_custkey"), fuels.alias("f")).select("*", "f.ord", "f.fuel").where((ord_ < 2) | (k % 2 == 0))
    item = F.concat(
        F.lit("["), F.concat_ws(
            ",", quoted(_pick(RO_BRANDS, k % len(RO_BRANDS))), F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")), F.lit("25.5"),
            quoted(F.lit("Oras"), F.col("c_nationkey").cast("string")), quoted(F.lit("Strada "), k.cast("string")),
            F.when(ord_ == 0, F.col("c_acctbal")).otherwise(F.col("c_acctbal") - 1000).cast("string")
        ), F.lit("]"),
    )
    answers = _answers(rows, ["ord", "fuel", "c_nationkey", "page"], item)
    doc = F.concat(F.lit("<script>var rezultate = JSON.parse('["), F.array_join("x", ","), F.lit("]');</script>"))
    return _whole(adapters.romania({"pages": answers.select("path", "fuel", "shard_ord", doc.alias("doc"))}, F.lit(RUN_AT).cast("timestamp")))


POI_CODES = ["NLD", "BEL", "POL", "HUN", "USA"]
_POI = [c for c in dims.POI_COUNTRIES if c[1] in POI_CODES]


@REGISTRY.add(f"""
WITH c(country, iso, y, x, currency, confidence) AS (VALUES {', '.join(f"('{c[0]}', '{c[1]}', {c[2]}::DOUBLE, {c[3]}::DOUBLE, '{c[6]}', {c[7]}::DOUBLE)" for c in _POI)}),
s AS (
  SELECT c_custkey AS k, c_name, c_nationkey, c.*, CASE currency WHEN 'PLN' THEN 4.5 ELSE 1 END AS rate, CASE currency WHEN 'PLN' THEN 'PLN' ELSE 'EUR' END AS label,
         list_filter([struct_pack(f := CASE WHEN c_custkey % 2 = 0 THEN 'E10' ELSE 'E5' END, p := c_acctbal, u := 'L'), struct_pack(f := 'CNG', p := CAST(c_custkey % 50 AS DOUBLE), u := 'kg'),
                      struct_pack(f := 'DIESEL', p := CASE WHEN c_custkey % 3 = 0 THEN c_acctbal / 2 END, u := 'L')], lambda v: v.p > 0) AS ps
  FROM customer JOIN c ON iso = {_sql_pick(POI_CODES, 'c_nationkey % 5')} WHERE c_custkey % 7 <> 0 AND c_custkey % 9 <> 0)
SELECT lower(country) || '_a_' || k AS id, c_name AS name, c_name AS brand, 'S ' || k AS address, 'City' || c_nationkey AS city, y AS lat, x AS lon, 'anwb.nl (ANWB POI API)' AS source, confidence, country,
       CAST(i AS INTEGER) AS price_ord, ps[i + 1].f AS fuel_type, CASE WHEN rate = 1 THEN ps[i + 1].p ELSE round(ps[i + 1].p * rate, 3) END AS price, label AS currency, ps[i + 1].u AS unit
FROM (SELECT *, unnest(range(len(ps))) AS i FROM s)""")
def adapter_points_of_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed for many countries: ISO code and box, the fuel by its name, prices in the country's currency where there is a rate (section 2.12, POI)."""
    k = F.col("c_custkey")
    places = {c[1]: (c[2], c[3]) for c in _POI}
    lat, lon = (F.element_at(F.array(*(F.lit(float(places.get(c, (0.0, 0.0))[i])) for c in POI_CODES)), (F.col("c_nationkey") % 5 + 1).cast("int")) for i in (0, 1))
    offer = (lambda code, name, value: F.struct(F.lit(code).alias("fuelType"), name.alias("fuelName"), value.alias("value")))
    station = F.struct(
        F.concat(F.lit("a|"), k.cast("string")).alias("id"), F.col("c_name").alias("title"),
        F.struct(
            _pick(POI_CODES, F.col("c_nationkey") % 5).alias("iso3CountryCode"), F.concat(F.lit("S "), k.cast("string")).alias("streetAddress"),
            F.concat(F.lit("City"), F.col("c_nationkey").cast("string")).alias("city")
        ).alias("address"),
        F.struct(F.when(k % 7 == 0, F.lit(-80.0)).otherwise(lat).alias("latitude"), F.when(k % 9 != 0, lon).alias("longitude")).alias("coordinates"),
        F.array(
            offer("EURO95", F.when(k % 2 == 0, "Euro 95 (E10)").otherwise("euro e10"), F.col("c_acctbal")), offer("CNG", F.lit("gas"), (k % 50).cast("double")),
            offer("ODD", F.lit("odd"), F.lit(1.0)), offer("DIESEL_SPECIAL", F.lit("d"), F.when(k % 3 == 0, F.col("c_acctbal") / 2)),
        ).alias("prices"),
    )
    answers = _answers(table(spark, sf_dir, "customer").select("*", _page("c_custkey")), ["page"], station)
    docs = answers.select("path", F.to_json(F.struct(F.col("x").alias("value"))).alias("doc"))
    rates = lookup.dim(spark, [("PLN", 4.5)], "currency string, rate double")
    found = adapters.points_of_interest(docs, adapters.poi_countries(spark), rates, F.lit(RUN_AT).cast("timestamp"))
    return _whole(found, "country")


@REGISTRY.add("""
WITH s AS (
  SELECT c_custkey AS k, c_name, c_nationkey AS n, 'Ulica ' || c_custkey AS address, CAST(420 + c_custkey % 55 AS DOUBLE) / 10 AS y,
         list_filter([struct_pack(f := 'E5', p := c_acctbal), struct_pack(f := 'DIESEL', p := CASE WHEN c_acctbal > 1000 THEN c_acctbal - 1000 ELSE c_custkey % 50 + 0.5::DOUBLE END)], lambda v: v.p > 0) AS ps
  FROM customer)
SELECT 'hr_' || CASE WHEN k % 4 > 0 THEN CAST(k AS VARCHAR) ELSE sha256(c_name || '|' || address || '|Mjesto' || n)[:16] END AS id, c_name AS name, c_name AS brand, address, 'Mjesto' || n AS city,
       CASE WHEN y BETWEEN 42.3 AND 46.9 THEN y END AS lat, CASE WHEN y BETWEEN 42.3 AND 46.9 THEN 16.5::DOUBLE END AS lon, 'mzoe-gor.hr' AS source, 1.0::DOUBLE AS confidence,
       CAST(i AS INTEGER) AS price_ord, ps[i + 1].f AS fuel_type, ps[i + 1].p AS price, 'EUR' AS currency, 'L' AS unit
FROM (SELECT *, unnest(range(len(ps))) AS i FROM s)""")
def adapter_croatia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by product, products by category, categories by fuel; the last row of a product counts; axes in the wrong fields (section 2.12, HR)."""
    k, balance = F.col("c_custkey"), F.col("c_acctbal")
    text, tenths = (lambda c: c.cast("string")), F.lit(420) + k % 55
    y = F.concat(text(F.floor(tenths / 10)), F.lit(","), text(tenths % 10))
    offer = (lambda product, value: F.struct(F.lit(product).alias("gorivo_id"), value.alias("cijena")))
    station = F.struct(
        F.when(k % 4 > 0, text(k)).alias("id"), F.col("c_name").alias("naziv"), F.col("c_mktsegment").alias("brand"),
        F.concat(F.lit("Ulica "), text(k)).alias("adresa"), F.concat(F.lit("Mjesto"), text(F.col("c_nationkey"))).alias("mjesto"),
        F.when(k % 2 == 0, y).otherwise("16,5").alias("lat"), F.when(k % 2 == 0, "16.5").otherwise(y).alias("lng"),
        F.array(
            offer(101, text(balance)), offer(999, F.lit("1")), offer(102, F.replace(text(balance - 1000), F.lit("."), F.lit(","))),
            offer(103, F.concat(text(k % 50), F.lit(",5")))
        ).alias("cjenici"),
    )
    products = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(c).alias("vrsta_goriva_id")) for i, c in ((101, 1), (102, 2), (103, 7), (102, 8), (104, 99), (0, 1))))
    answers = _answers(table(spark, sf_dir, "customer").select("*", _page("c_custkey")), ["page"], station)
    docs = answers.select("path", F.to_json(F.struct(F.col("x").alias("postajas"), products.alias("gorivos"))).alias("doc"))
    return _whole(adapters.croatia({"all": docs}, F.lit(RUN_AT).cast("timestamp")))


@REGISTRY.add("""
WITH s AS (
  SELECT c_custkey AS k, c_mktsegment AS brand, c_nationkey AS n,
         list_filter([struct_pack(f := 'DIESEL', p := c_acctbal, u := 'L'), struct_pack(f := 'E5', p := CASE WHEN c_custkey % 2 = 1 AND c_acctbal > 1000 THEN c_acctbal - 1000 ELSE c_custkey % 50 + 0.5::DOUBLE END, u := 'L'),
                      struct_pack(f := 'CNG', p := CASE WHEN c_custkey % 3 = 0 THEN 1.25::DOUBLE END, u := 'kg')], lambda v: v.p > 0) AS ps
  FROM customer)
SELECT 'es_' || k AS id, brand AS name, brand, 'Calle ' || k AS address, 'Municipio' || n AS city, CASE WHEN k % 5 > 0 AND k % 7 > 0 THEN 40.5::DOUBLE END AS lat, CASE WHEN k % 5 > 0 AND k % 7 > 0 THEN -3.25::DOUBLE END AS lon,
       'minetur.gob.es' AS source, 0.95::DOUBLE AS confidence, CAST(i AS INTEGER) AS price_ord, ps[i + 1].f AS fuel_type, ps[i + 1].p AS price, 'EUR' AS currency, ps[i + 1].u AS unit
FROM (SELECT *, unnest(range(len(ps))) AS i FROM s)""")
def adapter_spain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide records with decimal commas: the first valid of the columns of a fuel; zero and impossible coordinates are none (section 2.12, ES)."""
    k, balance = F.col("c_custkey"), F.col("c_acctbal")
    text = (lambda c: c.cast("string"))
    comma = (lambda c: F.replace(text(c), F.lit("."), F.lit(",")))
    station = F.struct(
        text(k).alias("IDEESS"), F.col("c_mktsegment").alias("Rótulo"), F.concat(F.lit("Calle "), text(k)).alias("Dirección"),
        F.concat(F.lit("Municipio"), text(F.col("c_nationkey"))).alias("Municipio"),
        F.when(k % 5 == 0, "0").when(k % 7 == 0, "95,0").otherwise("40,5").alias("Latitud"), F.when(k % 5 == 0, "0").otherwise("-3,25").alias("Longitud (WGS84)"),
        comma(balance).alias("Precio Gasoleo A"), F.when(k % 2 == 1, comma(balance - 1000)).otherwise("").alias("Precio Gasolina 95 E5"),
        F.lit("").alias("Precio Gasolina 95 E10"), F.concat(text(k % 50), F.lit(",5")).alias("Precio Gasolina 98 E5"),
        F.when(k % 3 == 0, "1,25").alias("Precio Gas Natural Comprimido"),
    )
    answers = _answers(table(spark, sf_dir, "customer").select("*", _page("c_custkey")), ["page"], station)
    docs = answers.select("path", F.to_json(F.struct(F.lit("OK").alias("ResultadoConsulta"), F.col("x").alias("ListaEESSPrecio"))).alias("doc"))
    return _whole(adapters.spain({"stations": docs}, F.lit(RUN_AT).cast("timestamp")))


@REGISTRY.add("""
WITH s AS (
  SELECT c_custkey AS k, c_name, c_nationkey AS n, CAST(450 + c_custkey % 25 AS DOUBLE) / 10 AS y,
         list_filter([struct_pack(f := 'E5', p := CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE c_custkey % 50 + 0.5::DOUBLE END, u := 'L'), struct_pack(f := 'DIESEL', p := c_acctbal - 1000, u := 'L'),
                      struct_pack(f := 'CNG', p := CASE WHEN c_custkey % 3 = 0 THEN 1.25::DOUBLE END, u := 'kg')], lambda v: v.p > 0) AS ps
  FROM customer)
SELECT 'si_' || CASE WHEN k % 6 > 0 THEN CAST(k AS VARCHAR) ELSE sha256(c_name || '|Cesta ' || k)[:16] END AS id, c_name AS name, c_name AS brand, 'Cesta ' || k AS address, CAST(1000 + n AS VARCHAR) AS city,
       CASE WHEN y BETWEEN 45.4 AND 46.9 THEN y END AS lat, CASE WHEN y BETWEEN 45.4 AND 46.9 THEN 14.5::DOUBLE END AS lon, 'goriva.si' AS source, 1.0::DOUBLE AS confidence,
       CAST(i AS INTEGER) AS price_ord, ps[i + 1].f AS fuel_type, ps[i + 1].p AS price, 'EUR' AS currency, ps[i + 1].u AS unit
FROM (SELECT *, unnest(range(len(ps))) AS i FROM s)""")
def adapter_slovenia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered pages up to an empty one, behind which nothing counts; a station without a number gets the hash of its name and address (section 2.12, SI)."""
    k, balance = F.col("c_custkey"), F.col("c_acctbal")
    text, tenths = (lambda c: c.cast("string")), F.lit(450) + k % 25
    station = F.struct(
        F.when(k % 6 > 0, text(k)).when(k % 12 == 0, "0").alias("pk"), F.col("c_name").alias("name"), F.concat(F.lit("Cesta "), text(k)).alias("address"),
        text(F.lit(1000) + F.col("c_nationkey")).alias("zip_code"), F.concat(text(F.floor(tenths / 10)), F.lit("."), text(tenths % 10)).alias("lat"), F.lit("14.5").alias("lng"),
        F.struct(
            balance.alias("95"), F.concat(text(k % 50), F.lit(".5")).alias("98"), (balance - 1000).alias("dizel"), F.when(k % 3 == 0, F.lit(1.25)).alias("cng")
        ).alias("prices"),
    )
    rows = table(spark, sf_dir, "customer").withColumn("page", (F.floor(k / PAGE_ROWS) + 1).cast("int"))
    more = F.lit("next").alias("next")
    full = _answers(rows, ["page"], station).select("path", "page", F.to_json(F.struct(more, F.col("x").alias("results"))).alias("doc"))
    last = rows.agg((F.max("page") + 1).alias("page"))  # one row: the empty page
    empty = last.select(F.lit("z").alias("path"), "page", F.lit('{"next": "next", "results": []}').alias("doc"))
    beyond = last.select(F.lit("zz").alias("path"), (F.col("page") + 1).alias("page"), F.lit('{"next": null, "results": [{"pk": "late", "name": "late", "prices": {"95": 1}}]}').alias("doc"))
    return _whole(adapters.slovenia({"pages": full.unionByName(empty).unionByName(beyond)}, F.lit(RUN_AT).cast("timestamp")))


@REGISTRY.add("""
WITH s AS (
  SELECT c_custkey AS k, c_mktsegment AS brand, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE c_name END AS name,
         list_filter([struct_pack(f := 'E5', p := c_acctbal), struct_pack(f := 'DIESEL', p := CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 50 + 0.5::DOUBLE END)], lambda v: v.p > 0) AS ps
  FROM customer)
SELECT 'is_' || k AS id, name, brand, '' AS address, '' AS city, CASE WHEN k % 3 = 0 THEN 64.5::DOUBLE WHEN k % 3 = 1 THEN 65.25::DOUBLE END AS lat, CASE WHEN k % 3 = 0 THEN -21.5::DOUBLE WHEN k % 3 = 1 THEN -18.25::DOUBLE END AS lon,
       'gasvaktin.is' AS source, 0.9::DOUBLE AS confidence, CAST(i AS INTEGER) AS price_ord, ps[i + 1].f AS fuel_type, ps[i + 1].p AS price, 'ISK' AS currency, 'L' AS unit
FROM (SELECT *, unnest(range(len(ps))) AS i FROM s)""")
def adapter_iceland(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list at the root or under a key; coordinates nested, or flat where those are missing or 0 (section 2.12, IS)."""
    k = F.col("c_custkey")
    nested = F.when(k % 3 == 0, F.struct(F.lit("64.5").alias("lat"), F.lit("-21.5").alias("lon"))).when(k % 3 == 1, F.struct(F.lit("0").alias("lat"), F.lit("0").alias("lon")))
    station = F.struct(
        k.cast("string").alias("key"), F.when(k % 4 > 0, F.concat("c_name", F.lit(" "))).alias("name"), F.col("c_mktsegment").alias("company"), nested.alias("geo"),
        F.when(k % 3 == 1, "65.25").alias("lat"), F.when(k % 3 == 1, "-18.25").alias("lon"), F.col("c_acctbal").alias("bensin95"),
        F.when(k % 2 == 0, (k % 50).cast("double") + 0.5).alias("diesel"),
    )
    answers = _answers(table(spark, sf_dir, "customer").select("*", _page("c_custkey"), (k % 2).alias("half")), ["page", "half"], station)
    doc = F.when(F.col("half") == 0, F.to_json("x")).otherwise(F.to_json(F.struct(F.col("x").alias("stations"))))
    return _whole(adapters.iceland({"stations": answers.select("path", doc.alias("doc"))}, F.lit(RUN_AT).cast("timestamp")))
