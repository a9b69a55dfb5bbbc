"""Landed raw documents to rows.  A document is a row (path, doc); list positions and shards give explicit ordinals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.functions.scalars import number, strip


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as documents."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))


def read_bytes(spark: SparkSession, path: str, charset: str = "utf-8") -> DataFrame:
    """Whole files as documents, decoded from a charset."""
    return spark.read.format("binaryFile").load(path).select("path", decode(F.col("content"), charset).alias("doc"))


def decode(content: Column, charset: str = "utf-8") -> Column:
    """Bytes as text: utf-8 (with or without a mark; bytes that are no utf-8 are read as latin-1) or windows-1252."""
    latin = F.decode(content, "ISO-8859-1")
    if charset == "windows-1252":
        # The bytes 0x80-0x9F are all that tells it from latin-1.
        codes = [(chr(b), bytes([b]).decode("cp1252", "replace")) for b in range(0x80, 0xA0)]
        return F.translate(latin, "".join(a for a, _ in codes), "".join(b for _, b in codes))
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(latin)
    return F.regexp_replace(text, "^﻿", "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of splittable text files: path, line_ord (in file order), value."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    return rows.select("path", F.struct("block", F.monotonically_increasing_id().alias("n")).alias("line_ord"), "value")


def shard_of(docs: DataFrame, pattern: str, **groups: int) -> DataFrame:
    """Shard columns from the file name: name=group number of the pattern."""
    return docs.withColumns({k: F.regexp_extract("path", pattern, g) for k, g in groups.items()})


def with_shard_order(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """Documents with shard_ord, from a table of shard columns and shard_ord; documents of unknown shards are dropped."""
    keys = [c for c in shards.columns if c != "shard_ord"]
    return docs.join(shards, keys)


def shard_grid(*dims: DataFrame) -> DataFrame:
    """The product of small dimension tables (each name, name_ord), first one slowest, as shard columns and shard_ord."""
    out = None
    for d in dims:
        out = d if out is None else out.join(d, F.lit(True))
    ords = [c for c in out.columns if c.endswith("_ord")]
    return out.withColumn("shard_ord", F.struct(*ords)).drop(*ords)


def gate(docs: DataFrame, condition: Column) -> DataFrame:
    """Documents that the condition on their parsed form accepts; an unparsable one is dropped."""
    return docs.where(F.coalesce(condition, F.lit(False)))


def json_list(docs: DataFrame, element: str, keys: Sequence[str] = (), root: bool = False) -> DataFrame:
    """Elements of a JSON list at the root, or under the first key whose list is not empty: docs' columns, row_ord, x."""
    # One parse a document: into a struct of all keys, or, if it begins as a list (Spark reads a lone object as a list of one), into a list.
    parts = F.from_json("doc", "struct<" + ", ".join(f"`{k}`: array<{element}>" for k in keys) + ">") if keys else None

    def first(x: Column) -> Column:
        return F.coalesce(*(F.when(F.size(x[k]) > 0, x[k]) for k in keys), F.lit(None))

    # As a variable of transform the parsed struct is computed once, however many keys look into it.
    found = F.get(F.transform(F.array(parts), first), F.lit(0)) if keys else None
    if root:
        listed = F.when(F.col("doc").rlike(r"^[\s\uFEFF]*\["), F.from_json("doc", f"array<{element}>"))
        found = listed.otherwise(found) if keys else listed
    rest = [c for c in docs.columns if c != "doc"]
    return docs.select(*rest, F.posexplode(found).alias("row_ord", "x")).where("x IS NOT NULL")


def csv_after_preamble(lines: DataFrame, header: str, columns: Sequence[str], sep: str = "|") -> DataFrame:
    """Rows of delimited lines after the first line that starts with the header token; all lines if none does.

    columns name the fields by position; extra fields are ignored, missing ones null, double quotes quote.
    """
    starts = lines.where(F.col("value").startswith(header)).groupBy("path").agg(F.min("line_ord").alias("__start"))
    body = lines.join(starts, "path", "left").where(F.col("__start").isNull() | (F.col("line_ord") > F.col("__start")))
    schema = ", ".join(f"`{c}` string" for c in columns)
    parsed = F.from_csv("value", F.lit(schema), {"sep": sep, "mode": "PERMISSIVE"})
    return body.where("value <> ''").select("path", "line_ord", parsed.alias("x")).select("path", "line_ord", "x.*")


def table_rows(docs: DataFrame, table: str, row: str, cell: str) -> DataFrame:
    """Rows of the first HTML table that matches: docs' columns, row_ord, html, cells.  table, row and cell are patterns with one group."""
    rest = [c for c in docs.columns if c != "doc"]
    rows = F.regexp_extract_all(F.regexp_extract("doc", table, 1), F.lit(row), F.lit(1))
    return docs.select(*rest, F.posexplode(rows).alias("row_ord", "html")).withColumn(
        "cells", F.regexp_extract_all("html", F.lit(cell), F.lit(1))
    )


def script_value(pattern: str) -> Column:
    """A literal of page script: the first group of the pattern, '' without a match."""
    return F.regexp_extract("doc", pattern, 1)


def embedded_literal(docs: DataFrame, pattern: str, fields: int) -> DataFrame:
    """Positional arrays of a JSON literal in page script: docs' columns, row_ord, x (array<string>); arrays with fewer fields are dropped."""
    rest = [c for c in docs.columns if c != "doc"]
    rows = F.from_json(script_value(pattern), "array<array<string>>")
    return docs.select(*rest, F.posexplode(rows).alias("row_ord", "x")).where(F.size("x") >= fields)


def flat_map(docs: DataFrame, error_key: str = "error") -> DataFrame:
    """Entries of one JSON object with free keys: docs' columns, row_ord, key, value; documents with the error key are dropped."""
    rest = [c for c in docs.columns if c != "doc"]
    parsed = docs.withColumn("__map", F.from_json("doc", "map<string,string>"))
    kept = gate(parsed, ~F.map_contains_key("__map", error_key))
    return kept.select(*rest, F.posexplode("__map").alias("row_ord", "key", "value"))


def xml_rates(docs: DataFrame) -> DataFrame:
    """currency, rate pairs of an exchange-rate feed; of repeated currencies the last counts."""
    pattern = r"currency=[\"']([A-Z]{3})[\"']\s+rate=[\"']([0-9.]+)[\"']"
    names, rates = (F.regexp_extract_all("doc", F.lit(pattern), F.lit(g)) for g in (1, 2))
    pairs = docs.select("path", F.posexplode(F.arrays_zip(names.alias("currency"), rates.alias("rate"))).alias("ord", "x"))
    rate = number(F.col("x.rate"))
    return pairs.select("path", "ord", "x.currency", rate.alias("rate")).groupBy("currency").agg(
        F.max_by("rate", F.struct("path", "ord")).alias("rate")
    )


ELEMENT = "struct<id: bigint, type: string, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string,string>>"


def map_elements(docs: DataFrame) -> DataFrame:
    """Elements of a map feed: element_id, type, lat, lon (a node's own, otherwise its centre), tags, row_ord."""
    rows = json_list(docs, ELEMENT, ["elements"])
    node = F.col("x.type") == "node"
    return rows.select(
        "path", "row_ord", F.col("x.id").alias("element_id"), F.col("x.type").alias("type"),
        F.when(node, F.col("x.lat")).otherwise(F.col("x.center.lat")).alias("lat"),
        F.when(node, F.col("x.lon")).otherwise(F.col("x.center.lon")).alias("lon"),
        F.coalesce("x.tags", F.create_map().cast("map<string,string>")).alias("tags"),
    )


def positional_cube(docs: DataFrame, fuels: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A statistics vector by position: fuel_ord, fuel_type, unit, price; a vector of fewer values than fuels gives nothing."""
    values = F.from_json("doc", "struct<value: array<string>>")["value"]
    names = F.array(*(F.struct(F.lit(f).alias("fuel_type"), F.lit(u).alias("unit")) for _, f, u in fuels))
    rows = docs.select(values.alias("v")).where(F.size("v") >= len(fuels)).select("v", F.posexplode(names).alias("fuel_ord", "x"))
    return rows.select("fuel_ord", "x.fuel_type", "x.unit", number(F.get("v", F.col("fuel_ord"))).alias("price"))


def pages(docs: DataFrame, element: str, page: str = "page", key: str = "results", feed: Sequence[str] = ()) -> DataFrame:
    """Elements of numbered pages, in order, up to the first page that is empty, unparsable, missing or after one without a next page: page, row_ord, x.

    feed names the columns that tell feeds apart, each of which has pages of its own; they are kept.  Without it all pages are one feed.
    """
    by = f"PARTITION BY {', '.join(feed) or 'true'}"
    schema = f"struct<next: string, `{key}`: array<{element}>>"
    parsed = docs.select(*feed, F.col(page).cast("int").alias("page"), F.from_json("doc", schema).alias("d"))
    state = parsed.select(*feed, "page", (F.coalesce(F.size(f"d.{key}"), F.lit(0)) > 0).alias("full"), F.col("d.next").isNull().alias("last"))
    # The run of good pages: as many good pages as their number says, none before them the last.
    marks = state.where("full").selectExpr(*feed, "page", "last", f"row_number() OVER ({by} ORDER BY page) AS n", f"min(page) OVER ({by}) AS first")
    marks = marks.selectExpr(
        *feed, "page", "page - first + 1 = n AS gapless",
        f"coalesce(max(last) OVER ({by} ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended"
    )
    good = marks.where("gapless AND NOT ended").select(*feed, "page")
    return parsed.join(good, [*feed, "page"]).select(*feed, "page", F.posexplode(f"d.{key}").alias("row_ord", "x"))


def region_codes(docs: DataFrame) -> DataFrame:
    """Codes of the regions' sub-regions: code, code_ord; those that are no whole numbers are dropped."""
    regions = json_list(docs, "struct<subRegions: array<struct<code: string>>>", root=True)
    codes = regions.select("row_ord", F.posexplode("x.subRegions").alias("sub_ord", "s"))
    code = strip(F.col("s.code")).try_cast("int")
    return codes.select(code.alias("code"), F.struct("row_ord", "sub_ord").alias("code_ord")).where("code IS NOT NULL")
