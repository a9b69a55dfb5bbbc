"""Queries: scalar expressions on texts made from the tables' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.functions import scalars as S
from pumpwise.operators import lookup
from pumpwise.queries.registry import Registry, table

REGISTRY = Registry()


@REGISTRY.add("""SELECT doc_id, regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g') AS key,
  coalesce(nullif(nullif(regexp_replace(strip_accents(lower(regexp_extract(text, '^\\s*([^\\s]+)', 1))), '[^a-z0-9]', '', 'g'), 'the'), 'statoil'),
    CASE regexp_replace(strip_accents(lower(regexp_extract(text, '^\\s*([^\\s]+)', 1))), '[^a-z0-9]', '', 'g') WHEN 'the' THEN 'a' WHEN 'statoil' THEN 'circlek' END) AS brand FROM documents""")
def norm_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and brand keys (SCL-03, SCL-04, JOIN-13)."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", S.norm_key(F.col("text")).alias("key"), S.brand_key(F.col("text"), {"the": "a", "statoil": "circlek"}).alias("brand")
    )


@REGISTRY.add("SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS odd FROM orders")
def decimal_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a decimal comma (SCL-01); two separators give null."""
    text = F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(","))
    odd = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("1."), text)).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", S.decimal_comma(text).alias("price"), S.decimal_comma(odd).alias("odd"))


@REGISTRY.add(
    "SELECT p_partkey, CAST(p_size AS DOUBLE) AS price, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS broken FROM part"
)
def strip_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a currency sign (SCL-02)."""
    text = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(",0 €"))
    broken = F.when(F.col("p_size") % 2 == 0, text).otherwise(F.concat(text, F.lit(" per litre")))
    return table(spark, sf_dir, "part").select("p_partkey", S.strip_symbol(text).alias("price"), S.strip_symbol(broken).alias("broken"))


@REGISTRY.add("""WITH w AS (SELECT p_partkey, regexp_extract_all('X' || p_type || 'Malm' || p_brand, '[A-Z][a-z]*') AS w FROM part)
SELECT p_partkey, w[1] AS city, array_to_string(w[2:], ' ') AS street FROM w""")
def split_camel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camel-case words (SCL-06)."""
    parts = S.split_camel(F.concat(F.lit("X"), "p_type", F.lit("Malm"), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", parts.alias("x")).select("p_partkey", "x.city", "x.street")


@REGISTRY.add("""WITH s AS (SELECT s_suppkey, s_suppkey % 4 AS k, CAST(s_suppkey AS VARCHAR) AS n, 'Malm' || chr(CAST(97 + s_suppkey % 26 AS INTEGER)) AS c,
  'Ga' || chr(CAST(97 + s_suppkey // 26 % 26 AS INTEGER)) || 'an' AS r FROM supplier)
SELECT s_suppkey, CASE k WHEN 0 THEN 'circle k' || n || ' · Main ' || r || ', ' || c WHEN 1 THEN 'st' || n || ' · ' || r || ', ' || c WHEN 2 THEN 'plain brand' || n ELSE 'single' || n END AS name,
  CASE k WHEN 0 THEN 'circle_k' || n WHEN 1 THEN 'st' || n WHEN 2 THEN 'plain_brand' || n ELSE 'single' || n END AS brand,
  CASE k WHEN 0 THEN c || 'Main' || r WHEN 1 THEN c || r ELSE '' END AS geo_key, CASE WHEN k < 2 THEN c ELSE '' END AS city,
  CASE k WHEN 0 THEN 'Main ' || r WHEN 1 THEN r ELSE '' END AS street FROM s""")
def parse_composite_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite ids (SCL-07)."""
    key = F.col("s_suppkey")
    kind, n, county = key % 4, key.cast("string"), F.concat(F.lit("lan-"), F.col("s_nationkey").cast("string"))
    city = F.concat(F.lit("Malm"), F.char(key % 26 + 97))
    street = F.concat(F.lit("Ga"), F.char(F.floor(key / 26) % 26 + 97), F.lit("an"))
    text = F.when(kind == 0, F.concat(county, F.lit("_circle_k"), n, F.lit("_"), city, F.lit("Main"), street)).when(
        kind == 1, F.concat(county, F.lit("_st"), n, F.lit("_"), city, street, F.lit("_rest"))
    ).when(kind == 2, F.concat(county, F.lit("_plain_brand"), n)).otherwise(F.concat(F.lit("single"), n))
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.parse_composite_id(text).alias("x")).select("s_suppkey", "x.*")


@REGISTRY.add("SELECT c_custkey, c_name || '__' || c_mktsegment AS head, CAST(c_nationkey AS VARCHAR) AS tail FROM customer")
def rsplit_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split at the last '__' (SCL-08)."""
    text = F.concat_ws("__", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.rsplit_key(text).alias("x")).select("c_custkey", "x.*")


@REGISTRY.add("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE n_word END AS city, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(1000 + c_nationkey AS VARCHAR) END AS postal,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE lower(c_mktsegment) || ' 7' END AS street FROM (SELECT *, 'City' || c_nationkey AS n_word FROM customer WHERE c_nationkey < 10) UNION ALL
SELECT c_custkey, '', CAST(1000 + c_nationkey AS VARCHAR), '' FROM customer WHERE c_nationkey >= 10""")
def parse_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City, postal code and street of an address (SCL-09)."""
    nation = F.col("c_nationkey").cast("string")
    full = F.concat(F.lower("c_mktsegment"), F.lit(" 7  City"), nation, F.lit(" 10"), F.lpad(nation, 2, "0"), F.lit(" Danmark"))
    text = F.when(
        F.col("c_nationkey") >= 10, F.concat((F.col("c_nationkey") + 1000).cast("string"), F.lit(" end"))
    ).when(F.col("c_custkey") % 5 == 0, "no digits 12").otherwise(full)
    return table(spark, sf_dir, "customer").select("c_custkey", S.parse_address(text).alias("x")).select("c_custkey", "x.*")


@REGISTRY.add("SELECT p_partkey, p_brand AS brand, CASE WHEN p_size % 2 = 0 THEN p_name || ', ' || p_type ELSE '' END AS address FROM part")
def split_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and address at the first comma (SCL-10)."""
    text = F.when(F.col("p_size") % 2 == 0, F.concat_ws(", ", "p_brand", "p_name", "p_type")).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", S.split_comma(text).alias("x")).select("p_partkey", "x.*")


@REGISTRY.add("SELECT p_partkey, p_name AS rest, CASE WHEN p_size % 3 > 0 THEN 1.5::DOUBLE + p_size END AS price FROM part")
def embedded_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price inside a name (SCL-11)."""
    size = F.col("p_size")
    note = F.when(size % 3 == 0, " (Re85 1.2.3)").otherwise(F.concat(F.lit(" (Re85  "), (size + 1).cast("string"), F.lit(".5)")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.embedded_price(F.concat("p_name", note)).alias("x")
    ).select("p_partkey", "x.*")


@REGISTRY.add(
    "SELECT c_custkey, lower(c_mktsegment) || '_' || replace(replace(c_name || '|' || c_custkey || ' x', '|', '_'), ' ', '_') AS id FROM customer"
)
def sanitize_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with a country prefix (SCL-12)."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        S.sanitize_id(F.col("c_mktsegment"), F.concat("c_name", F.lit("|"), F.col("c_custkey").cast("string"), F.lit(" x"))).alias("id")
    )


@REGISTRY.add("""SELECT p_partkey, trim(CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END || ' ' || CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END) AS address,
  CASE WHEN p_size % 2 = 0 THEN p_brand || ' ' || p_type ELSE p_type END AS shown FROM part""")
def join_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street and number, brand and name (SCL-13, SCL-14)."""
    size = F.col("p_size")
    address = S.join_address(F.when(size % 2 == 0, F.col("p_name")), F.when(size % 3 == 0, size.cast("string")))
    shown = S.brand_and_name(F.when(size % 2 == 0, F.col("p_brand")).otherwise(""), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", address.alias("address"), shown.alias("shown"))


@REGISTRY.add("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN nullif(CAST(c_nationkey AS DOUBLE), 0) END AS lat,
  CASE WHEN c_custkey % 3 <> 0 THEN nullif(c_acctbal, 0) END AS lon FROM customer""")
def zero_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero is no coordinate; a broken axis spoils both (SCL-15)."""
    lon = F.when(F.col("c_custkey") % 3 == 0, "east").otherwise(F.col("c_acctbal").cast("string"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", S.zero_to_null(F.col("c_nationkey").cast("string"), lon).alias("x")
    ).select("c_custkey", "x.*")


@REGISTRY.add("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 50.0 WHEN abs(c_acctbal) > 90 THEN c_acctbal / 100000 ELSE c_acctbal END AS lat,
  CASE WHEN c_custkey % 4 = 0 THEN 5.0 WHEN abs(c_acctbal) > 90 THEN CAST(c_nationkey AS DOUBLE) / 100000 ELSE c_nationkey END AS lon FROM customer""")
def descale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates stored times 100 000 (SCL-16)."""
    quarter = F.col("c_custkey") % 4 == 0
    x = S.descale(F.when(quarter, F.lit(50.0)).otherwise(F.lit(0.0)), F.lit(5.0), F.col("c_acctbal"), F.col("c_nationkey").cast("double"))
    return table(spark, sf_dir, "customer").select("c_custkey", x.alias("x")).select("c_custkey", "x.*")


@REGISTRY.add(
    """SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN CAST(430 + c_custkey % 39 AS DOUBLE) / 10 END AS lat,
  CASE WHEN c_custkey % 4 < 2 THEN CAST(140 + (c_custkey + c_nationkey) % 51 AS DOUBLE) / 10 END AS lon FROM customer"""
)
def swap_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swapped axes told apart by their ranges (SCL-17)."""
    kind = F.col("c_custkey") % 4
    tenths = (lambda n, mark: F.concat(F.floor(n / 10).cast("string"), F.lit(mark), (n % 10).cast("string")))
    lat, lon = F.lit(430) + F.col("c_custkey") % 39, F.lit(140) + (F.col("c_custkey") + F.col("c_nationkey")) % 51
    first = F.when(kind == 0, tenths(lon, ",")).when(kind == 3, F.concat(F.lit("9"), tenths(lat, "."))).otherwise(tenths(lat, "."))
    second = F.when(kind == 0, tenths(lat, ",")).when(kind == 2, "n/a").otherwise(tenths(lon, "."))
    x = S.repair_axes([first, F.lit(None).cast("string"), second], (42.3, 13.4, 46.9, 19.5))
    return table(spark, sf_dir, "customer").select("c_custkey", x.alias("x")).select("c_custkey", "x.*")


@REGISTRY.add("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS DOUBLE) ELSE 64.5 END AS lat, 20.0::DOUBLE AS lon FROM customer WHERE c_custkey % 5 <> 0 UNION ALL
SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey % 5 = 0""")
def nested_or_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested coordinates, else flat ones (SCL-18)."""
    key = F.col("c_custkey")
    x = S.nested_or_flat(
        F.when(key % 3 == 0, "0").otherwise("64.5"), F.lit(None).cast("string"), F.col("c_nationkey").cast("string"),
        F.when(key % 5 == 0, "west").otherwise("20")
    )
    return table(spark, sf_dir, "customer").select("c_custkey", x.alias("x")).select("c_custkey", "x.*")


@REGISTRY.add(
    "SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END, ''), CASE WHEN p_size % 3 = 0 THEN p_type END, 'Station') AS name FROM part"
)
def coalesce_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value that is not blank (SCL-05)."""
    size = F.col("p_size")
    name = S.first_nonblank(
        F.when(size % 2 == 0, "").otherwise(F.col("p_brand")), F.when(size % 3 == 0, F.col("p_type")), default="Station"
    )
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


@REGISTRY.add(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice / 7, 3) * 1000 AS BIGINT) AS milli FROM lineitem"
)
def round_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounding to three places (SCL-19)."""
    milli = F.round(S.round_places(F.col("l_extendedprice") / 7, 3) * 1000).cast("bigint")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", milli.alias("milli"))


@REGISTRY.add("SELECT c_custkey, lower(c_mktsegment) AS code FROM customer")
def lower_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes for file names (SCL-22)."""
    return table(spark, sf_dir, "customer").select("c_custkey", S.lower_code(F.col("c_mktsegment")).alias("code"))


@REGISTRY.add("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN NULL ELSE o_orderstatus END AS value FROM orders")
def sentinel_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'-' and blank are no values (FLT-09)."""
    status = F.col("o_orderstatus")
    cell = F.when(status == "F", " - ").when(status == "O", "  ").otherwise(F.concat(F.lit(" "), status))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.sentinel_to_null(cell).alias("value"))


@REGISTRY.add("SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderpriority, '^[0-9]-[A-Z]+$')")
def key_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the required shape (FLT-10)."""
    return lookup.of_shape(table(spark, sf_dir, "orders"), "o_orderpriority", "^[0-9]-[A-Z]+$").select("o_orderkey")


@REGISTRY.add("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey % 5 > 0")
def valid_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices are positive numbers (FLT-01); 'nan' is none."""
    text = F.when(F.col("c_custkey") % 5 == 0, "nan").otherwise(F.col("c_acctbal").cast("string"))
    return table(spark, sf_dir, "customer").where(S.valid_price(S.number(text))).select("c_custkey")
