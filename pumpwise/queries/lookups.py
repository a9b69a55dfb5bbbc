"""Queries: code lookups, geography, gazetteer, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.functions import dims
from pumpwise.functions import scalars as S
from pumpwise.operators import geo, geocode, lookup
from pumpwise.operators.keywords import by_keyword_table
from pumpwise.queries.registry import Registry, table

REGISTRY = Registry()
PRIORITIES = [("1-URGENT", "E10", "L"), ("2-HIGH", "E5", "L"), ("3-MEDIUM", "DIESEL", "L"), ("5-LOW", "CNG", "kg")]


@REGISTRY.add("""SELECT o_orderkey, fuel_type, unit FROM orders
JOIN (VALUES ('1-URGENT', 'E10', 'L'), ('2-HIGH', 'E5', 'L'), ('3-MEDIUM', 'DIESEL', 'L'), ('5-LOW', 'CNG', 'kg')) f(code, fuel_type, unit) ON code = o_orderpriority""")
def fuel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes to fuels, unmapped codes dropped (JOIN-01)."""
    rows = lookup.map_codes(table(spark, sf_dir, "orders"), "o_orderpriority", lookup.fuel_dim(spark, PRIORITIES), "fuel_code")
    return rows.select("o_orderkey", "fuel_type", "unit")


@REGISTRY.add("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'E10' WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'E5' WHEN l_returnflag = 'N' THEN 'DIESEL' END AS fuel_type
FROM lineitem""")
def composite_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite key with wildcard (JOIN-02)."""
    rules = [("A", "F", "E10"), ("N", "F", "E5"), ("N", None, "DIESEL")]
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        lookup.with_wildcard(rules, F.col("l_returnflag"), F.col("l_linestatus")).alias("fuel_type")
    )


@REGISTRY.add("""SELECT p_partkey, CASE WHEN contains(lower(p_name || ' ' || p_type), 'brass') THEN 'E10' WHEN contains(lower(p_name || ' ' || p_type), 'red') THEN 'E5'
  WHEN contains(lower(p_name || ' ' || p_type), 'e') THEN 'DIESEL' END AS fuel_type FROM part""")
def ordered_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first keyword that occurs decides (JOIN-03)."""
    rules = [("BRASS", "E10"), ("Red", "E5"), ("e", "DIESEL")]
    return table(spark, sf_dir, "part").select(
        "p_partkey", lookup.by_keyword(rules, F.concat_ws(" ", "p_name", "p_type")).alias("fuel_type")
    )


@REGISTRY.add("""WITH r AS (SELECT item_id AS rule_ord, lower(substr(text, 1 + item_id % 11, 5 + item_id % 9)) AS keyword, 'item ' || item_id AS fuel_type FROM benchmark
  UNION ALL SELECT 1000000 + min(p_partkey), string_split(p_name, ' ')[2], min_by(p_brand, p_partkey) FROM part GROUP BY ALL HAVING string_split(p_name, ' ')[2] <> ''
  UNION ALL SELECT 2000000 + min(p_partkey), p_name, min_by(p_brand, p_partkey) FROM part GROUP BY p_name
  UNION ALL SELECT 3000000 + r_regionkey, lower(r_name[:3]), r_name FROM region)
SELECT doc_id, min_by(fuel_type, rule_ord) AS fuel_type FROM documents LEFT JOIN r ON contains(lower(text), keyword) GROUP BY doc_id""")
def keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of many keyword rules that occurs in a text: rules from the names of parts, pieces of benchmark items and short names (JOIN-03)."""
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("bigint").alias("rule_ord"), F.expr("substring(text, 1 + item_id % 11, 5 + item_id % 9)").alias("keyword"),
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("value"),
    )
    parts = table(spark, sf_dir, "part")
    word = parts.select((F.col("p_partkey") + 1_000_000).alias("rule_ord"), F.split("p_name", " ")[1].alias("keyword"), F.col("p_brand").alias("value"))
    names = parts.select((F.col("p_partkey") + 2_000_000).alias("rule_ord"), F.upper("p_name").alias("keyword"), F.col("p_brand").alias("value"))
    short = table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 3_000_000).alias("rule_ord"), F.substring("r_name", 1, 3).alias("keyword"), F.col("r_name").alias("value")
    )
    rules = lookup.union_sources(items, word, names, short)
    return by_keyword_table(table(spark, sf_dir, "documents"), "text", rules, "fuel_type").select("doc_id", "fuel_type")


@REGISTRY.add("""SELECT p_partkey, CASE WHEN p_size = 1 THEN CASE WHEN contains(p_name, 'a') THEN 'E10' ELSE 'E5' END
  WHEN p_size = 2 THEN 'LPG' WHEN p_size = 3 THEN 'CNG' END AS fuel_type FROM part""")
def conditional_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One code depends on the name, the others are looked up (JOIN-04)."""
    code = F.col("p_size").cast("string")
    fuel = lookup.overridden(code, "1", F.col("p_name"), "a", "E10", "E5", lookup.code_map([("2", "LPG"), ("3", "CNG")], code))
    return table(spark, sf_dir, "part").select("p_partkey", fuel.alias("fuel_type"))


@REGISTRY.add("SELECT c_custkey, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chained lookups (JOIN-05)."""
    rows = lookup.two_hops(
        table(spark, sf_dir, "customer"), "c_nationkey", table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey",
        table(spark, sf_dir, "region"), "r_regionkey"
    )
    return rows.select("c_custkey", "r_name")


@REGISTRY.add("""SELECT c_mktsegment AS source, 'customer' AS origin, c_custkey AS id FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL
SELECT CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'AUTOMOBILE' ELSE 'MACHINERY' END, 'supplier', s_suppkey FROM supplier WHERE s_suppkey % 3 <> 1""")
def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secondary source stands in where the primary is unavailable (JOIN-12)."""
    primary = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("source"), F.lit("customer").alias("origin"), F.col("c_custkey").alias("id")
    )
    third = F.col("s_suppkey") % 3
    other = F.when(third == 0, "BUILDING").when(third == 1, "AUTOMOBILE").otherwise("MACHINERY")
    secondary = table(spark, sf_dir, "supplier").select(
        other.alias("source"), F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("id")
    )
    seen = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("source")).distinct()
    return lookup.fallback(primary, secondary, seen.withColumn("available", ~F.col("source").isin("BUILDING", "MACHINERY")), "source")


_HAV = "2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * power(sin(radians({d} - {c}) / 2), 2))))"
#: Pseudo-coordinates of suppliers and customers, from their keys.
_LAT, _LON = "(48 + (s_suppkey * 37 % 997) / 250.0)", "(8 + (s_suppkey * 53 % 991) / 200.0)"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = F.lit(48) + (F.col("s_suppkey") * 37 % 997) / 250.0
    lon = F.lit(8) + (F.col("s_suppkey") * 53 % 991) / 200.0
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("price"), lat.alias("lat"), lon.alias("lon")
    )


@REGISTRY.add(f"""SELECT id, g_id FROM (SELECT s_suppkey AS id, {_LAT}::DOUBLE AS lat, {_LON}::DOUBLE AS lon FROM supplier) s
JOIN (SELECT row_number() OVER (ORDER BY a) - 1 AS g_id, x AS g_lat, y AS g_lon FROM (VALUES {', '.join(f'({i}, {a}::DOUBLE, {b}::DOUBLE)' for i, (a, b) in enumerate(dims.DE_GRID))}) v(a, x, y)) g
ON {_HAV.format(a='lat', b='g_lat', c='lon', d='g_lon')} <= 25""")
def radius_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within 25 km of a grid point (FLT-11)."""
    grid = lookup.dim(spark, [(i, *p) for i, p in enumerate(dims.DE_GRID)], "g_id bigint, g_lat double, g_lon double")
    return geo.radius_cover(_placed(spark, sf_dir), grid, 25.0).select("id", "g_id")


@REGISTRY.add(f"""SELECT id, price FROM (SELECT s_suppkey AS id, s_acctbal AS price, {_LAT}::DOUBLE AS lat, {_LON}::DOUBLE AS lon FROM supplier)
WHERE {_HAV.format(a='50.0', b='lat', c='10.0', d='lon')} <= 150 ORDER BY price, {_HAV.format(a='50.0', b='lat', c='10.0', d='lon')}, id LIMIT 20""")
def nearest_cheapest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 cheapest within 150 km: a top-k report (DCL-04)."""
    return geo.cheapest_near(_placed(spark, sf_dir), 50.0, 10.0, 150.0, 20).select("id", "price")


_C_LAT, _C_LON = "(48 + (c_custkey * 41 % 1009) / 250.0)", "(8 + (c_custkey * 59 % 983) / 200.0)"


def _customers_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = F.lit(48) + (F.col("c_custkey") * 41 % 1009) / 250.0, F.lit(8) + (F.col("c_custkey") * 59 % 983) / 200.0
    return table(spark, sf_dir, "customer").select("c_custkey", lat.alias("lat"), lon.alias("lon"))


@REGISTRY.add(f"""SELECT c_custkey, s_suppkey, place FROM (
  SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY {_HAV.format(a='c.lat', b='s.lat', c='c.lon', d='s.lon')}, s_suppkey)::INTEGER AS place
  FROM (SELECT c_custkey, {_C_LAT}::DOUBLE AS lat, {_C_LON}::DOUBLE AS lon FROM customer) c, (SELECT s_suppkey, {_LAT}::DOUBLE AS lat, {_LON}::DOUBLE AS lon FROM supplier) s)
WHERE place <= 3""")
def nearest_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest suppliers of every customer, nearest first (FLT-11, DCL-04)."""
    return geo.nearest(_customers_placed(spark, sf_dir), _placed(spark, sf_dir).withColumnRenamed("id", "s_suppkey"), 3, "c_custkey", "s_suppkey").drop("distance_km")


@REGISTRY.add(f"""SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, {_C_LAT}::DOUBLE AS lat, {_C_LON}::DOUBLE AS lon FROM customer) c
JOIN (SELECT s_suppkey, {_LAT}::DOUBLE AS s_lat, {_LON}::DOUBLE AS s_lon, (s_suppkey % 7 + 1)::DOUBLE * 0.01371::DOUBLE AS half FROM supplier) s
ON lat BETWEEN s_lat - half AND s_lat + half AND lon BETWEEN s_lon - 2 * half AND s_lon + 2 * half""")
def boxes_without_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the boxes of suppliers, which overlap and are of several sizes (FLT-08)."""
    half = (F.col("id") % 7 + 1).cast("double") * 0.01371
    boxes = _placed(spark, sf_dir).select(
        F.col("id").alias("s_suppkey"), (F.col("lat") - half).alias("min_lat"), (F.col("lat") + half).alias("max_lat"),
        (F.col("lon") - 2 * half).alias("min_lon"), (F.col("lon") + 2 * half).alias("max_lon")
    )
    return geo.in_boxes(_customers_placed(spark, sf_dir), boxes).select("c_custkey", "s_suppkey")


@REGISTRY.add(
    """SELECT event_id, value FROM events WHERE event_type IN ('click', 'view') AND CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events WHERE event_type IN ('click', 'view'))"""
)
def latest_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen products of the latest period (FLT-13)."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    return lookup.latest_slice(rows, "day", F.col("event_type").isin("click", "view")).select("event_id", "value")


@REGISTRY.add("SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 1)")
def member_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of listed networks (FLT-15)."""
    parts = table(spark, sf_dir, "part")
    return lookup.members(parts, "p_brand", parts.where("p_size = 1").select("p_brand").distinct(), "p_brand").select("p_partkey")


@REGISTRY.add(f"""SELECT c_custkey FROM customer WHERE c_custkey % 23 < {len(dims.RO_NETWORKS)}""")
def network_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a fixed list of networks, spelled in other cases and with blanks, among rows of others (FLT-15)."""
    listed = F.element_at(F.array(*map(F.lit, dims.RO_NETWORKS)), (F.col("c_custkey") % 23 + 1).cast("int"))
    spelled = F.when(F.col("c_custkey") % 2 == 0, F.upper(listed)).otherwise(F.concat(F.lit(" "), listed, F.lit(".")))
    other = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Other "), F.col("c_mktsegment")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 23 < len(dims.RO_NETWORKS), spelled).otherwise(other).alias("brand"))
    return lookup.of_networks(rows, "brand", dims.RO_NETWORKS).select("c_custkey")


@REGISTRY.add(
    """SELECT event_id FROM events WHERE CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) % 2 = 0 AND event_type IN ('click', 'view', 'purchase')"""
)
def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag of a map and a type decide; an element without the tag goes (FLT-14).  Even events have the tag, odd ones another or none."""
    k = F.from_json("props", "map<string,string>")["k"].try_cast("int")
    amenity = F.when(k % 2 == 0, "fuel").when(k % 3 > 0, "cafe")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"), F.create_map(F.lit("amenity"), amenity).alias("tags"))
    return lookup.tagged(rows, "amenity", "fuel", ("click", "view", "purchase")).select("event_id")


@REGISTRY.add("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 AND n_nationkey < 20 THEN CAST(n_nationkey AS DOUBLE)
  WHEN c_custkey % 3 <> 0 THEN 1000.0 + n_regionkey END AS lat FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def gazetteer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street and city first, then the city alone; misses stay null (JOIN-15, SCL-21)."""
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    blank = F.lit(None).cast("string")
    exact = nations.where("n_nationkey < 20").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lit("XX").alias("country"), F.col("n_name").alias("street"), F.col("r_name").alias("city"), blank.alias("postal"),
        F.col("n_nationkey").cast("double").alias("lat"), F.lit(0.0).alias("lon"), F.lit(0).alias("rank"))
    loose = regions.select(
        F.lit("XX").alias("country"), blank.alias("street"), F.col("r_name").alias("city"), blank.alias("postal"),
        (F.col("r_regionkey") + 1000.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit(-1).alias("rank")
    )
    # An entry without a street answers queries by city only; those with one rank after it there.
    gazetteer = exact.withColumn("rank", F.lit(5)).unionByName(loose)
    rows = table(spark, sf_dir, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    ).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("c_custkey")
    street = F.when(key % 2 == 0, F.upper("n_name")).otherwise("")
    city = F.when((key % 7 == 0), "Nowhere").when(
        (key % 3 == 0) & ~((key % 2 == 0) & (F.col("n_nationkey") < 20)), ""
    ).otherwise(F.col("r_name"))
    query = S.geocode_query(city, F.when((city == ""), "").otherwise(street), F.lit(""))
    asked = rows.select("c_custkey", F.lit("XX").alias("country"), query.alias("query"))
    return geocode.look_up(asked, gazetteer).select("c_custkey", "lat")


_BOX = "c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 5 AND 20"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("lat"), F.col("c_nationkey").cast("double").alias("lon")
    )


@REGISTRY.add(
    f"SELECT c_custkey, CASE WHEN {_BOX} THEN c_acctbal END AS lat, CASE WHEN {_BOX} THEN CAST(c_nationkey AS DOUBLE) END AS lon FROM customer"
)
def bounds_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates outside the box become null (FLT-04)."""
    return geo.null_outside(_customers(spark, sf_dir), (0.0, 5.0, 5000.0, 20.0))


@REGISTRY.add(f"SELECT c_custkey FROM customer WHERE {_BOX}")
def bounds_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows outside the box go (FLT-05)."""
    return geo.drop_outside(_customers(spark, sf_dir), (0.0, 5.0, 5000.0, 20.0)).select("c_custkey")


@REGISTRY.add("""SELECT c_custkey, 'X' || n_regionkey AS country FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE n_regionkey < 3 AND c_acctbal BETWEEN n_regionkey * 1000 AND n_regionkey * 1000 + 2500""")
def box_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO code and box of the country, all countries in one join (FLT-07, FLT-08)."""
    regions = table(spark, sf_dir, "region").where("r_regionkey < 3")
    low = F.col("r_regionkey") * 1000.0
    countries = regions.select(
        F.concat(F.lit("X"), F.col("r_regionkey").cast("string")).alias("country"),
        F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("iso3"), low.alias("min_lat"), F.lit(-1.0).alias("min_lon"),
        (low + 2500).alias("max_lat"), F.lit(99.0).alias("max_lon")
    )
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(
        "c_custkey", F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("code"), F.col("c_acctbal").alias("lat"),
        F.col("c_nationkey").cast("double").alias("lon")
    )
    return geo.in_country(rows, countries, "code").select("c_custkey", "country")


@REGISTRY.add("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def coords_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both coordinates needed (FLT-06)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("lat"), F.col("toxic").alias("lon"))
    return geo.require_coordinates(table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")).select("doc_id")


@REGISTRY.add("""SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 'customer' AS source FROM customer UNION ALL
SELECT s_suppkey, s_name, NULL, 'supplier' FROM supplier""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNION ALL by name with missing columns (SET-01..03)."""
    one = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.lit("customer").alias("source")
    )
    two = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.lit("supplier").alias("source"), F.col("s_name").alias("name")
    )
    return lookup.union_sources(one, two)


@REGISTRY.add("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def open_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations that are open or do not say (FLT-12)."""
    status = F.col("o_orderstatus")
    says = F.when(status == "O", True).when(status == "F", False)
    return lookup.open_stations(table(spark, sf_dir, "orders").withColumn("open", says)).select("o_orderkey")


@REGISTRY.add("SELECT doc_id FROM documents WHERE source IS NULL OR source NOT IN ('src0', 'src3')")
def exclude_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names on a list are left out (JOIN-14)."""
    return lookup.exclude(table(spark, sf_dir, "documents"), "source", ["src0", "src3"]).select("doc_id")


@REGISTRY.add("""SELECT p_partkey, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN '' WHEN regexp_matches(p_brand, '^[0-9]') THEN '' ELSE p_brand END AS city,
  p_name AS street, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN CAST(p_size AS VARCHAR) ELSE '' END AS postal FROM part""")
def geocode_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to look up for a station (SCL-21)."""
    query = S.geocode_query(F.col("p_brand"), F.col("p_name"), F.col("p_size").cast("string"), ["Brand#11", "Brand#12"])
    return table(spark, sf_dir, "part").select("p_partkey", query.alias("q")).select("p_partkey", "q.city", "q.street", "q.postal")
