"""Queries: raw documents of every shape, made from the tables by Spark and parsed back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.functions import scalars as S
from pumpwise.plans.adapters import RO_LITERAL
from pumpwise.sources import raw as R
from pumpwise.sources.split import split_json_list
from pumpwise.staging import shared_folder
from pumpwise.queries.registry import Registry, table

REGISTRY = Registry()


#: Keys of rows in one document, where a key of its own would not keep documents small.
PAGE_ROWS = 1000


def _documents(df: DataFrame, key: str | list[str], value: Column, *order: str) -> DataFrame:
    """One document per key: path, x (values in the order of the columns)."""
    keys = [key] if isinstance(key, str) else key
    listed = F.array_sort(F.collect_list(F.struct(*order, value.alias("v"))))
    path = F.concat_ws("-", *(F.col(k).cast("string") for k in keys))
    return df.groupBy(*keys).agg(F.transform(listed, lambda e: e["v"]).alias("x")).withColumn("path", path)


def _paged_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the page that their key is on: documents made of a page do not grow with the table."""
    return table(spark, sf_dir, "customer").withColumn("page_no", F.floor(F.col("c_custkey") / PAGE_ROWS))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    return _documents(table(spark, sf_dir, "orders"), "o_custkey", row, "o_orderkey")


_ORDERS = "SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS row_ord, o_orderkey AS id, o_totalprice AS price FROM orders"
_ROW = "struct<id: bigint, s: string, p: double>"


@REGISTRY.add(_ORDERS)
def json_nested_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list inside a JSON document (SRC-01)."""
    docs = _orders(spark, sf_dir).select("o_custkey", F.to_json(F.struct(F.lit("x").alias("note"), F.col("x").alias("value"))).alias("doc"))
    return R.json_list(docs, _ROW, ["value"]).select("o_custkey", "row_ord", "x.id", F.col("x.p").alias("price"))


@REGISTRY.add(
    "SELECT o_custkey // 1000 AS page_no, CAST(row_number() OVER (PARTITION BY o_custkey // 1000 ORDER BY o_orderkey) - 1 AS INTEGER) AS row_ord, o_orderkey AS id, o_totalprice AS price FROM orders"
)
def json_split_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of whole files, a file a thousand customers, each read by as many tasks as it has blocks (SRC-01)."""
    row = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    orders = table(spark, sf_dir, "orders").withColumn("page_no", F.floor(F.col("o_custkey") / PAGE_ROWS))
    docs = _documents(orders, "page_no", row, "o_orderkey").select("page_no", F.to_json(F.struct(F.lit("a [{ \"value\"").alias("note"), F.col("x").alias("value"))).alias("doc"))
    root = f"{shared_folder(spark).rstrip('/')}/documents-{uuid.uuid4().hex}"
    docs.write.partitionBy("page_no").text(root)
    found = split_json_list(spark, root, _ROW, "value")
    page = F.regexp_extract("path", "page_no=([0-9]+)", 1).cast("bigint")
    return found.select(page.alias("page_no"), "row_ord", "x.id", F.col("x.p").alias("price"))


@REGISTRY.add(_ORDERS)
def json_root_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bare list, or a list under one of several keys, the first that is not empty (SRC-02)."""
    kind, x = F.col("o_custkey") % 3, F.col("x")
    none = F.array().cast(f"array<{_ROW}>")
    doc = F.when(kind == 0, F.to_json(x)).when(
        kind == 1, F.to_json(F.struct(none.alias("results"), x.alias("data")))
    ).otherwise(F.to_json(F.struct(x.alias("stations"))))
    docs = _orders(spark, sf_dir).select("o_custkey", doc.alias("doc"))
    return R.json_list(
        docs, _ROW, ["results", "records", "data", "stations"], root=True
    ).select("o_custkey", "row_ord", "x.id", F.col("x.p").alias("price"))


@REGISTRY.add(
    "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, s_acctbal AS price, CAST(s_nationkey AS VARCHAR) AS path FROM supplier"
)
def csv_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited lines after a line of metadata (SRC-03)."""
    rows = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    line = F.concat_ws(
        "|", key, F.concat(F.lit('"'), "s_name", F.lit('"')), F.replace(F.col("s_acctbal").cast("string"), F.lit("."), F.lit(",")),
        F.lit("extra")
    )
    lines = rows.select(
        F.col("s_nationkey").cast("string").alias("path"), F.struct(F.lit(2).alias("a"), F.col("s_suppkey").alias("b")).alias("line_ord"),
        line.alias("value")
    )
    nations = rows.select(F.col("s_nationkey").cast("string").alias("path")).distinct()
    heads = [
        nations.select(
            "path", F.struct(F.lit(i).alias("a"), F.lit(0).cast("bigint").alias("b")).alias("line_ord"), F.lit(v).alias("value")
        ) for i,
        v in enumerate(("Extracted today", "id|name|price"))
    ]
    parsed = R.csv_after_preamble(lines.unionByName(heads[0]).unionByName(heads[1]), "id|", ["id", "name", "price"])
    return parsed.select("id", "name", S.decimal_comma(F.col("price")).alias("price"), "path")


@REGISTRY.add("""SELECT page_id, CAST(n AS INTEGER) AS row_ord, regexp_extract(li, 'href="([^"]*)"', 1) AS href, CAST(len(regexp_extract_all(li, '<a')) AS INTEGER) AS cells FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS li, unnest(range(len(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)))) AS n FROM pages)""")
def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and cells of page markup (SRC-05)."""
    docs = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("doc"))
    rows = R.table_rows(docs, "(?s)(.*)", "(?s)<li>(.*?)</li>", "(<a)")
    return rows.select("page_id", "row_ord", F.regexp_extract("html", 'href="([^"]*)"', 1).alias("href"), F.size("cells").alias("cells"))


@REGISTRY.add("SELECT o_orderkey, o_orderstatus AS brand, o_totalprice AS price FROM orders WHERE o_orderkey % 4 > 0")
def embedded_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of arrays in page script; short arrays go (SRC-06)."""
    rows = table(spark, sf_dir, "orders")
    full = F.concat(
        F.lit('["'), "o_orderstatus", F.lit('",45.0,25.0,"City","Road",'), F.col("o_totalprice").cast("string"), F.lit(","),
        F.col("o_orderkey").cast("string"), F.lit("]")
    )
    item = F.when(F.col("o_orderkey") % 4 == 0, '["short",1]').otherwise(full)
    docs = _documents(rows, "o_custkey", item, "o_orderkey").select(
        F.concat(F.lit("<script>\nvar rezultate = JSON.parse('["), F.array_join("x", ","), F.lit("]');</script>")).alias("doc")
    )
    found = R.embedded_literal(docs, RO_LITERAL, 6)
    at = (lambda i: F.get("x", F.lit(i)))
    return found.select(at(6).cast("bigint").alias("o_orderkey"), at(0).alias("brand"), S.number(at(5)).alias("price"))


@REGISTRY.add("SELECT page_id, CAST(regexp_extract(html, 'track\\(([0-9]+)\\)', 1) AS BIGINT) AS n FROM pages")
def script_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal in page script (SRC-06)."""
    docs = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("doc"))
    return docs.select("page_id", R.script_value(r"track\(([0-9]+)\)").cast("bigint").alias("n"))


@REGISTRY.add("""SELECT event_id, 'k' AS key, regexp_extract(props, '"k": *([0-9]+)', 1) AS value FROM events""")
def flat_kv_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object with free keys (SRC-07)."""
    return R.flat_map(table(spark, sf_dir, "events").select("event_id", F.col("props").alias("doc"))).select("event_id", "key", "value")


_LETTER = "chr(CAST(65 + c_custkey // {} % 26 AS INTEGER))"


@REGISTRY.add(f"""SELECT {' || '.join(_LETTER.format(n) for n in (676, 26, 1))} AS currency,
  arg_max(c_custkey + 0.5::DOUBLE, lpad(CAST(c_custkey // {PAGE_ROWS} AS VARCHAR), 12, '0') || lpad(CAST(c_custkey AS VARCHAR), 15, '0')) AS rate FROM customer GROUP BY 1""")
def xml_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Currency and rate pairs of a feed; the last of repeated ones counts (SRC-08)."""
    key = F.col("c_custkey")
    name = F.concat(*(F.char(F.floor(key / n) % 26 + 65) for n in (676, 26, 1)))
    pair = F.concat(
        F.lit('<Cube currency="'), name, F.lit('" rate="9"/><Cube currency="'), name, F.lit('" rate="'), key.cast("string"), F.lit('.5"/>')
    )
    docs = _documents(_paged_customers(spark, sf_dir), "page_no", pair, "c_custkey")
    return R.xml_rates(docs.select(F.lpad("path", 12, "0").alias("path"), F.array_join("x", "\n").alias("doc")))


@REGISTRY.add("""SELECT c_custkey AS element_id, CAST(c_nationkey AS DOUBLE) + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 100 END AS lat, c_mktsegment AS brand,
  CASE WHEN c_custkey % 2 = 0 THEN 'node' ELSE 'way' END AS type FROM customer""")
def map_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map elements: nodes carry coordinates, others a centre (SRC-09)."""
    rows = _paged_customers(spark, sf_dir)
    node, lat = F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("double")
    element = F.struct(
        F.col("c_custkey").alias("id"), F.when(node, "node").otherwise("way").alias("type"), F.when(node, lat).alias("lat"),
        F.when(node, F.lit(1.0)).alias("lon"),
        F.when(~node, F.struct((lat + 100).alias("lat"), F.lit(2.0).alias("lon"))).alias("center"),
        F.create_map(F.lit("brand"), "c_mktsegment", F.lit("amenity"), F.lit("fuel")).alias("tags"),
    )
    listed = _documents(rows, ["c_nationkey", "page_no"], F.to_json(element), "c_custkey")
    docs = listed.select("path", F.concat(F.lit('{"elements":['), F.array_join("x", ","), F.lit("]}")).alias("doc"))
    return R.map_elements(docs).select("element_id", "type", "lat", F.col("tags")["brand"].alias("brand"))


@REGISTRY.add("""WITH o AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders)
SELECT CAST(n AS INTEGER) AS fuel_ord, CASE n WHEN 0 THEN 'E10' ELSE 'DIESEL' END AS fuel_type, o_totalprice AS price FROM o WHERE n < 2 AND c >= 2""")
def positional_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by position; short vectors give nothing (SRC-10)."""
    docs = _documents(
        table(spark, sf_dir, "orders"), "o_custkey", F.col("o_totalprice"), "o_orderkey"
    ).select(F.to_json(F.struct(F.col("x").alias("value"))).alias("doc"))
    return R.positional_cube(docs, [("0", "E10", "L"), ("1", "DIESEL", "L")]).select("fuel_ord", "fuel_type", "price")


@REGISTRY.add("""WITH c AS (SELECT c_custkey, c_mktsegment || '-' || (c_custkey // 1000) AS feed, length(c_mktsegment) AS pages,
  dense_rank() OVER (PARTITION BY c_mktsegment, c_custkey // 1000 ORDER BY c_custkey // 100) AS page FROM customer)
SELECT c_custkey AS id, feed, CAST(page AS INTEGER) AS page FROM c WHERE page <= pages""")
def paged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered pages of several feeds, each up to its first empty one (SRC-11): feeds of a thousand keys and a segment, of which the page after as many as the segment has letters is empty."""
    feed = F.concat_ws("-", "c_mktsegment", F.floor(F.col("c_custkey") / 1000).cast("string"))
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", feed.alias("feed"), F.length("c_mktsegment").alias("pages"), F.floor(F.col("c_custkey") / 100).alias("hundred")
    )
    rows = _documents(rows, ["feed", "pages", "hundred"], F.struct(F.col("c_custkey").alias("id")), "c_custkey")
    rows = rows.withColumn("page", F.expr("row_number() OVER (PARTITION BY feed ORDER BY hundred)"))
    full = F.when(F.col("page") != F.col("pages") + 1, F.col("x")).otherwise(F.array().cast("array<struct<id: bigint>>"))
    docs = rows.select("feed", "page", F.to_json(F.struct(F.lit("more").alias("next"), full.alias("results"))).alias("doc"))
    return R.pages(docs, "struct<id: bigint>", feed=["feed"]).select("x.id", "feed", "page")


@REGISTRY.add(
    """SELECT c_custkey AS id, c_nationkey AS region, c_mktsegment AS fuel, CAST(c_nationkey AS INTEGER) AS region_ord, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS fuel_ord FROM customer"""
)
def sharded_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of responses per region and fuel in the order of the shard grid (SRC-12)."""
    rows = _paged_customers(spark, sf_dir)
    one = rows.groupBy("page_no", "c_nationkey", "c_mktsegment").agg(F.collect_list(F.struct(F.col("c_custkey").alias("id"))).alias("x"))
    path = F.concat_ws("/", F.lit("landing"), F.col("page_no").cast("string"), F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment"))
    docs = R.shard_of(one.select(path.alias("path"), F.to_json("x").alias("doc")), "([0-9]+)-([A-Z]+)$", region=1, fuel=2)
    regions = rows.select(
        F.col("c_nationkey").cast("string").alias("region"), F.col("c_nationkey").cast("int").alias("region_ord")
    ).distinct()
    names = rows.select(F.col("c_mktsegment").alias("fuel")).distinct()
    fuels = names.withColumn("fuel_ord", F.expr("cast(row_number() OVER (ORDER BY fuel) - 1 AS int)"))  # a handful of fuels
    found = R.json_list(R.with_shard_order(docs, R.shard_grid(regions, fuels)), "struct<id: bigint>", root=True)
    return found.select("x.id", F.col("region").cast("int").alias("region"), "fuel", "shard_ord.region_ord", "shard_ord.fuel_ord")


@REGISTRY.add("SELECT CAST(c_custkey AS INTEGER) AS code FROM customer WHERE c_custkey % 4 > 0")
def region_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a nested region tree, those that are no numbers dropped (SRC-13)."""
    key = F.col("c_custkey")
    sub = F.struct(F.when(key % 4 == 0, "x").otherwise(key.cast("string")).alias("code"))
    rows = _documents(_paged_customers(spark, sf_dir), ["c_nationkey", "page_no"], sub, "c_custkey")
    docs = rows.select(F.to_json(F.array(F.struct(F.col("x").alias("subRegions")))).alias("doc"))
    return R.region_codes(docs).select("code")


@REGISTRY.add(_ORDERS + " WHERE o_custkey % 2 = 0 AND o_custkey % 6 > 0")
def doc_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not ok, or no JSON, are dropped whole (SRC-14)."""
    key = F.col("o_custkey")
    good = F.to_json(F.struct((key % 2 == 0).alias("ok"), F.col("x").alias("stations")))
    docs = _orders(spark, sf_dir).select("o_custkey", F.when(key % 6 == 0, "<html>").otherwise(good).alias("doc"))
    kept = R.gate(docs, F.from_json("doc", "struct<ok: boolean>")["ok"])
    return R.json_list(kept, _ROW, ["stations"]).select("o_custkey", "row_ord", "x.id", F.col("x.p").alias("price"))


@REGISTRY.add("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS price FROM orders")
def typed_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only JSON numbers are prices, texts and booleans are not (FLT-02)."""
    key = F.col("o_orderkey")
    value = F.when(key % 3 == 0, F.col("o_totalprice").cast("string")).when(
        key % 3 == 1, F.concat(F.lit('"'), F.col("o_totalprice").cast("string"), F.lit('"'))
    ).otherwise("true")
    docs = table(spark, sf_dir, "orders").select(
        F.concat(F.lit('[{"id":'), key.cast("string"), F.lit(',"v":'), value, F.lit("}]")).alias("doc")
    )
    return R.json_list(docs, "struct<id: bigint, v: double>", root=True).select("x.id", F.col("x.v").alias("price"))
