"""Queries: deduplication, price arrays, matching, currency, cache and history."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.functions import scalars as S
from pumpwise.operators import dedup, geocode, lookup, match, money
from pumpwise.operators.prices import entry, first_valid_columns, first_where, keep_valid, unnest, with_prices
from pumpwise.plans import history, publish
from pumpwise.queries.registry import Registry, table
from pumpwise.staging import shared_folder
from pumpwise.streaming import daily

REGISTRY = Registry()
#: Order of line items that leaves no ties: (l_orderkey, l_linenumber) is no key in the synthetic tables.
LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate"
]
_LINES = ", ".join(LINE_ORDER)
FLAGS = [("A", "E10", "L"), ("N", "DIESEL", "kg")]
_FLAGS = "(VALUES ('A', 'E10', 'L'), ('N', 'DIESEL', 'kg')) f(code, fuel_type, unit)"


@REGISTRY.add(f"""
SELECT s_suppkey, s_name, fuel_type, unit, l_orderkey, l_linenumber, price FROM (
  SELECT s_suppkey, s_name, fuel_type, unit, l_orderkey, l_linenumber, l_discount AS price,
         row_number() OVER (PARTITION BY l_suppkey, fuel_type ORDER BY {_LINES}) AS rn
  FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN {_FLAGS} ON code = l_returnflag WHERE l_discount > 0
) WHERE rn = 1""")
def registry_first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry joined to price facts, codes looked up, the first valid price of each fuel (JOIN-06, JOIN-01, FLT-01, AGG-03)."""
    facts = lookup.map_codes(table(spark, sf_dir, "lineitem"), "l_returnflag", lookup.fuel_dim(spark, FLAGS), "fuel_code")
    facts = facts.select(F.col("l_suppkey").alias("s_suppkey"), "fuel_type", "unit", F.col("l_discount").alias("price"), *LINE_ORDER)
    facts = dedup.first_valid(facts, ["s_suppkey", "fuel_type"], LINE_ORDER, S.valid_price(F.col("price")))
    registry = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return lookup.registry_join(registry, facts, "s_suppkey").select(
        "s_suppkey", "s_name", "fuel_type", "unit", "l_orderkey", "l_linenumber", "price"
    )


_SLOTS = """
WITH l AS (SELECT s_suppkey, s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier),
r AS (SELECT c_custkey, c_acctbal, c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer)
"""


def _slots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = (lambda c: (F.concat(F.lit("n"), c.cast("string")).alias("bk"), F.concat(F.lit("c"), c.cast("string")).alias("ck")))
    locations = table(spark, sf_dir, "supplier").select("s_suppkey", *nation(F.col("s_nationkey")))
    records = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", *nation(F.col("c_nationkey")))
    return locations, records


@REGISTRY.add(_SLOTS + "SELECT s_suppkey, c_custkey, c_acctbal, c_custkey IS NOT NULL AS matched FROM l LEFT JOIN r USING (k, n)")
def slot_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one matching per key (JOIN-07)."""
    locations, records = _slots(spark, sf_dir)
    found = match.match_slots(locations, records, ["bk", "ck"], ["s_suppkey"], ["c_custkey"], ["c_custkey", "c_acctbal"])
    return found.select("s_suppkey", "c_custkey", "c_acctbal", "matched")


@REGISTRY.add(_SLOTS + "SELECT c_custkey, c_acctbal FROM r ANTI JOIN l USING (k, n)")
def slot_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records beyond the number of locations (JOIN-08)."""
    locations, records = _slots(spark, sf_dir)
    return match.unmatched_records(locations, records, ["bk", "ck"], ["s_suppkey"], ["c_custkey"]).select("c_custkey", "c_acctbal")


RATES = [("CUR0", 11.25), ("CUR1", 0.5), ("CUR2", 7.46), ("CUR3", 0.0)]
_RATES = "(VALUES ('CUR0', 11.25), ('CUR1', 0.5), ('CUR2', 7.46), ('CUR3', 0.0)) x(cur, rate)"
_PRICED = f"""
WITH o AS (SELECT o_orderkey, round(o_totalprice * 100) AS price, 'CUR' || (c_nationkey % 5) AS currency
           FROM orders JOIN customer ON o_custkey = c_custkey)
"""


def _priced_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.select(
        "o_orderkey", F.round(F.col("o_totalprice") * 100).alias("price"),
        F.concat(F.lit("CUR"), (F.col("c_nationkey") % 5).cast("string")).alias("currency")
    )
    return orders, lookup.dim(spark, RATES, "currency string, rate double")


@REGISTRY.add(_PRICED + f"""
SELECT o_orderkey, CASE WHEN rate <> 0 THEN CAST(round(price * CAST(rate AS DOUBLE)) AS BIGINT) ELSE CAST(price AS BIGINT) END AS price,
       CASE WHEN rate <> 0 THEN currency ELSE 'EUR' END AS price_currency
FROM o LEFT JOIN {_RATES} ON cur = currency""")
def fx_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in local currency; no rate, or rate 0: the base price stays (JOIN-09)."""
    orders, rates = _priced_orders(spark, sf_dir)
    return money.convert(orders, rates, "price", "currency", places=0).select(
        "o_orderkey", F.col("price").cast("bigint").alias("price"), "price_currency"
    )


@REGISTRY.add(_PRICED + f"""
SELECT o_orderkey, CASE WHEN rate <> 0 THEN price / CAST(rate AS DOUBLE) END AS base_price FROM o LEFT JOIN {_RATES} ON cur = currency""")
def to_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local prices in the base currency (DCL-03)."""
    orders, rates = _priced_orders(spark, sf_dir)
    return money.to_base(orders, rates, "price", "currency").select("o_orderkey", "base_price")


def _cached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as stations without coordinates, labels as a cache in which label 0 is a remembered failure."""
    key = (lambda c: F.concat(F.lit("k"), F.floor(c / 4).cast("string")))  # up to four documents of a language share a key
    stations = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("country"), key(F.col("doc_id")).alias("geo_key"), F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lon")
    )
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    rows = labels.select(F.col("lang").alias("country"), key(F.col("doc_id")).alias("key"), "doc_id", "quality")
    first = dedup.first_wins(rows, ["country", "key"], ["doc_id"])
    good = F.when(F.col("quality") == 1, F.col("doc_id").cast("double"))
    return stations, first.select("country", "key", good.alias("lat"), (good / 2).alias("lon"))


_CACHE = """
WITH s AS (SELECT doc_id, lang AS country, doc_id // 4 AS k FROM documents),
c AS (SELECT lang AS country, doc_id // 4 AS k, CASE WHEN arg_min(quality, doc_id) = 1 THEN CAST(min(doc_id) AS DOUBLE) END AS lat
      FROM labels JOIN documents USING (doc_id) GROUP BY ALL)
"""


@REGISTRY.add(_CACHE + "SELECT doc_id, lat, lat / 2 AS lon FROM s LEFT JOIN c USING (country, k)")
def cache_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates from the cache (JOIN-10)."""
    return geocode.apply_cache(*_cached(spark, sf_dir)).select("doc_id", "lat", "lon")


@REGISTRY.add(_CACHE + """, b AS (SELECT country, min(doc_id) AS doc_id FROM s ANTI JOIN c USING (country, k) GROUP BY country, k),
r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY doc_id) AS n FROM b)
SELECT country, doc_id, n <= 300 AS this_run FROM r""")
def cache_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys never tried and which of them this run takes, at most 300 per country (JOIN-11, LIM-01)."""
    waiting = geocode.backlog(*_cached(spark, sf_dir), ["doc_id"]).select("country", "doc_id")
    turn = geocode.take_turn(waiting, ["doc_id"]).select("country", "doc_id", F.lit(True).alias("this_run"))
    return waiting.join(turn, ["country", "doc_id"], "left").select(
        "country", "doc_id", F.coalesce("this_run", F.lit(False)).alias("this_run")
    )


@REGISTRY.add(_CACHE + """, b AS (SELECT DISTINCT country, k FROM s ANTI JOIN c USING (country, k))
SELECT country, greatest(0, count(*) - 300) AS left_over FROM b GROUP BY country""")
def cache_left_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys wait for a later run (AGG-11)."""
    return geocode.left_over(geocode.backlog(*_cached(spark, sf_dir), ["doc_id"]))


@REGISTRY.add(
    "SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey"
)
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of each customer (AGG-01)."""
    return dedup.first_wins(
        table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"]
    )


@REGISTRY.add(
    "SELECT * FROM (SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey) WHERE o_orderstatus <> 'F'"
)
def first_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First wins, then the condition: a first row that fails hides later ones (AGG-02)."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return dedup.first_then_filter(rows, ["o_custkey"], ["o_orderkey"], F.col("o_orderstatus") != "F")


@REGISTRY.add("SELECT user_id, event_type, arg_max(value, event_id) AS value, min(event_id) AS event_id FROM events GROUP BY ALL")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value at the first place (AGG-04)."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return dedup.last_wins(rows, ["user_id", "event_type"], ["event_id"])


@REGISTRY.add("""
WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 0 AS ord, 'E5' AS fuel_type, l_discount AS price FROM lineitem UNION ALL
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 1, 'E5', l_tax FROM lineitem UNION ALL
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 2, 'DIESEL', l_extendedprice FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, fuel_type, price FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, fuel_type ORDER BY ord) AS rn FROM u WHERE price > 0
) WHERE rn = 1""")
def unpivot_first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide price columns to long, the first valid of each fuel, inside the row (PRJ-05, AGG-03)."""
    fuels = [("l_discount", "E5", "L"), ("l_tax", "E5", "L"), ("l_extendedprice", "DIESEL", "L")]
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", first_valid_columns(fuels, F.col).alias("p")
    )
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode("p").alias("p")
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p.fuel_type", "p.price")


@REGISTRY.add(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linestatus, {_LINES}) AS n,
                  row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_linestatus, {_LINES}) AS m FROM lineitem),
a AS (SELECT l_suppkey, l_linestatus AS attribute FROM r WHERE n = 1)
SELECT l_suppkey, attribute, l_returnflag AS fuel_type, l_extendedprice AS price,
       CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY n) - 1 AS INTEGER) AS price_ord
FROM r JOIN a USING (l_suppkey) WHERE m = 1""")
def merge_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial answers merged: first attributes, all fuels, the first price of each (AGG-05)."""
    order = ["shard", *LINE_ORDER]
    rows = table(spark, sf_dir, "lineitem").withColumn("shard", F.col("l_linestatus"))
    one = F.array(F.struct(F.col("l_returnflag").alias("fuel_type"), F.col("l_extendedprice").alias("price")))
    merged = dedup.merge_partials(rows.select("l_suppkey", *order, one.alias("prices")), "l_suppkey", order)
    return merged.select(
        "l_suppkey", F.col("shard").alias("attribute"), F.posexplode("prices").alias("price_ord", "p")
    ).select("l_suppkey", "attribute", "price_ord", "p.fuel_type", "p.price")


@REGISTRY.add(
    f"SELECT l_suppkey, string_agg(l_returnflag || l_linenumber, ',' ORDER BY {_LINES}, l_returnflag) AS listed FROM lineitem GROUP BY l_suppkey"
)
def ordered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a key in order (AGG-06)."""
    value = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    rows = dedup.ordered_list(table(spark, sf_dir, "lineitem"), ["l_suppkey"], [*LINE_ORDER, "l_returnflag"], value, "listed")
    return rows.select("l_suppkey", F.array_join("listed", ",").alias("listed"))


@REGISTRY.add("""
SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_mktsegment, round(c_acctbal, -3), round(c_acctbal / 2, -3)) AS first_custkey FROM customer""")
def rounded_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one name and rounded place are one station (AGG-07)."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", F.col("c_acctbal").alias("lat"), (F.col("c_acctbal") / 2).alias("lon")
    )
    keyed = dedup.group_by_place(rows, "c_mktsegment", "lat", "lon", ["c_custkey"], places=-3)
    return keyed.select("c_custkey", F.col("place_at").alias("first_custkey"))


@REGISTRY.add("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) - 1 AS ordinal FROM customer")
def ordinal_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows numbered within a country (AGG-08)."""
    return dedup.ordinal_ids(table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_name", "c_custkey"]).select("c_custkey", "ordinal")


@REGISTRY.add("SELECT n_name, count(*) AS station_count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name)")
def meta_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations per country and in all (AGG-09)."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return publish.counts(rows, "n_name")


@REGISTRY.add("""SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS with_prices, count(*) FILTER (c_mktsegment LIKE '%O%') AS with_coordinates
FROM customer GROUP BY c_nationkey""")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts (AGG-10)."""
    return publish.coverage(
        table(spark, sf_dir, "customer"), "c_nationkey", with_prices=F.col("c_acctbal") > 0,
        with_coordinates=F.col("c_mktsegment").contains("O")
    )


@REGISTRY.add("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 0)")
def nonempty_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations with a valid price (FLT-03)."""
    one = entry(F.col("o_orderpriority"), F.col("o_totalprice"), F.lit("L"))
    listed = dedup.ordered_list(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], one, "raw_prices")
    stations = table(spark, sf_dir, "customer").join(listed, F.col("c_custkey") == F.col("o_custkey"), "left")
    return with_prices(stations, keep_valid(F.col("raw_prices")), "EUR", F.lit("2026-01-01").cast("timestamp")).select("c_custkey")


@REGISTRY.add("""SELECT event_id, previous, value - previous AS delta FROM (
  SELECT event_id, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous FROM events)""")
def price_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change against the pull before (DCL-01)."""
    return history.price_changes(
        table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value"
    ).select("event_id", "previous", "delta")


@REGISTRY.add("""SELECT event_id, previous, value - previous AS delta FROM (
  SELECT event_id, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL)""")
def price_delta_by_pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change against the pull before, three pulls one after the other against a table of the latest prices (DCL-01)."""
    events = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL").select("event_id", "ts", "user_id", "event_type", "value")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    state = history.LatestPrices(spark, f"{shared_folder(spark).rstrip('/')}/latest-{uuid.uuid4().hex}", ["user_id", "event_type"], buckets=8)
    out, step = None, (last - first) / 3 if first is not None else timedelta(0)
    for k in range(3):
        low, high = (F.lit(first + i * step) if first is not None else F.lit(None).cast("timestamp") for i in (k, k + 1))
        pull = events.where(((F.col("ts") >= low) | F.lit(k == 0)) & ((F.col("ts") < high) | F.lit(k == 2)))
        changed = state.apply(pull, ["ts", "event_id"], "value")
        out = changed if out is None else out.unionByName(changed)
    return out.select("event_id", "previous", "delta")


@REGISTRY.add("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY ALL")
def daily_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily summary of prices (DCL-02)."""
    return history.daily_summary(table(spark, sf_dir, "events"), ["event_type"], "ts", "value")


@REGISTRY.add("""SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, min(value) AS low, max(value) AS high FROM events
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY ALL""")
def streamed_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily summaries of events that land in four pieces, each with a day of the one before again; days that are final (STR-01, DCL-02)."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    root = f"{shared_folder(spark).rstrip('/')}/landing-{uuid.uuid4().hex}"
    step = (last - first) / 4 if first is not None else None
    for k in range(4) if step is not None else ():
        low, high = first + k * step - timedelta(days=1), first + (k + 1) * step
        piece = events.where((F.col("ts") >= F.lit(low)) & ((F.col("ts") < F.lit(high)) | F.lit(k == 3)))
        piece.write.mode("append").parquet(f"{root}/landed")
        daily.summarise_days(
            daily.landed_rows(spark, f"{root}/landed", events.schema), ["event_type"], "ts", ["event_id"], f"{root}/days", f"{root}/checkpoint", "value"
        ).awaitTermination()
    schema = "event_type string, day date, n bigint, low double, high double"
    return spark.read.schema(schema).parquet(f"{root}/days") if step is not None else spark.createDataFrame([], schema)


@REGISTRY.add("""SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, CAST(v AS DOUBLE) AS value FROM (
  SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)""")
def unnest_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested list to rows, order kept (PRJ-06)."""
    rows = unnest(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", "pos", "value")
    return rows.withColumn("value", F.col("value").cast("double"))


@REGISTRY.add("""SELECT o_custkey, CASE WHEN arg_min(o_orderkey, o_orderkey) % 3 > 0 THEN arg_min(o_totalprice, o_orderkey) END AS value
FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey""")
def first_matching_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first list element that meets a condition; if it cannot be parsed, the next is not tried (PRJ-07)."""
    text = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    one = F.struct(F.col("o_orderstatus").alias("status"), text.alias("amount"))
    listed = dedup.ordered_list(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], one, "listed")
    first = first_where(F.col("listed"), lambda p: p["status"] == "F")
    found = listed.select("o_custkey", first.alias("x")).where("x IS NOT NULL")
    return found.select("o_custkey", S.number(F.col("x.amount")).alias("value"))
