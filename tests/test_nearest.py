"""Nearest sites against all pairs; documents parsed once."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pumpwise.operators import geo
from pumpwise.sources import raw as R


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def clustered(rng, n):
    """Towns, the poles, both sides of the date line, lone places, and many rows at one place."""
    out = []
    for i in range(n):
        lat, lon = rng.choice([(48.1, 11.5), (48.1, 11.5), (60.0, 179.95), (60.0, -179.95), (89.9, 10.0), (-45.0, 0.0)])
        spread = rng.choice([0.0, 0.02, 0.5])
        out.append((i, min(90.0, lat + rng.uniform(-spread, spread)), max(-180.0, min(179.9999, lon + rng.uniform(-spread, spread)))))
    return out


@pytest.mark.parametrize("k, sites, first_km", [(3, 300, None), (1, 40, 0.1), (7, 5, None), (4, 0, None)])
def test_nearest_against_all_pairs(spark, k, sites, first_km):
    rng = random.Random(k)
    points, places = clustered(rng, 120), clustered(rng, sites)
    rows = lambda r, name: spark.createDataFrame([*r, (-1, None, 1.0), (-2, 1.0, None)], f"{name} int, lat double, lon double")
    got = geo.nearest(rows(points, "id"), rows(places, "site_id"), k, first_km=first_km).collect()
    of = {}
    for r in got:
        of.setdefault(r["id"], {})[r["place"]] = (round(r["distance_km"], 6), r["site_id"])
    assert set(of) == ({p[0] for p in points} if sites else set())
    for i, a, b in points if sites else ():
        want = sorted((round(km(c, d, a, b), 6), s) for s, c, d in places)[:k]
        mine = [of[i][n + 1] for n in range(len(want))]
        assert len(of[i]) == len(want) and [d for d, _ in mine] == pytest.approx([d for d, _ in want], abs=2e-6)
        if len({d for d, _ in want}) == len(want):
            assert [s for _, s in mine] == [s for _, s in want]


def test_no_cross_join_and_pushed_box(spark, tmp_path):
    sites = spark.range(2000).select(F.col("id").alias("site_id"), (F.col("id") % 97 / 10).alias("lat"), (F.col("id") % 89 / 10).alias("lon"))
    plan = geo.radius_cover(sites, sites.select(F.col("site_id").alias("g_id"), F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon")), 30.0)
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    sites.withColumnsRenamed({"site_id": "id"}).withColumn("price", F.lit(1.0)).write.parquet(str(tmp_path / "s"))
    near = geo.cheapest_near(spark.read.parquet(str(tmp_path / "s")), 5.0, 5.0, 50.0, 5)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = near._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(lat" in plan and "LessThanOrEqual(lon" in plan


@pytest.mark.parametrize("lat, lon", [(48.0, 11.0), (60.0, 179.9), (-60.0, -179.9), (89.0, 0.0), (0.0, 0.0)])
def test_boxes_hold_their_circles(spark, lat, lon):
    rng = random.Random(5)
    rows = [(max(-90.0, min(90.0, lat + rng.uniform(-3, 3))), (lon + rng.uniform(-8, 8) + 180) % 360 - 180) for _ in range(500)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    for radius in (20.0, 200.0):
        inside = {tuple(r) for r in df.where(geo.around(lat, lon, radius)).collect()}
        assert {r for r in rows if km(lat, lon, *r) <= radius} <= inside


def test_a_document_is_parsed_once(spark):
    docs = spark.createDataFrame(
        [("a", '[{"id": 1}]'), ("b", '{"data": [{"id": 2}], "records": []}'), ("c", '{"results": 5, "data": [{"id": 3}]}'), ("d", '{"x": 1}'), ("e", "no"),
         ("f", None), ("g", '{"id": 4}'), ("h", '{"results": [{"id": 5}], "data": [{"id": 6}]}'), ("i", '\n [{"id": 7}, null]')],
        "path string, doc string"
    )
    got = R.json_list(docs, "struct<id: int>", ["results", "records", "data"], root=True)
    assert sorted((r["path"], r["x"]["id"]) for r in got.collect()) == [("a", 1), ("b", 2), ("c", 3), ("h", 5), ("i", 7)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2, plan  # a list or a struct, never both for one document


def test_boxes_without_a_code(spark):
    """Boxes from a point to the globe, overlapping, against all pairs; one country's box is a plain range that a scan can check."""
    rng = random.Random(9)
    points = [(i, rng.choice([rng.uniform(-90, 90), 48 + rng.random()]), rng.choice([rng.uniform(-180, 180), 11 + rng.random()])) for i in range(600)]
    points += [(600, 48.5, 11.5), (601, 90.0, 180.0), (602, -90.0, -180.0)]
    boxes = [(0, -90.0, -180.0, 90.0, 180.0), (1, 48.5, 11.5, 48.5, 11.5), (2, 50.0, 10.0, 40.0, 12.0)]
    for i in range(3, 60):
        a, b, size = rng.uniform(-80, 80), rng.uniform(-170, 170), rng.choice([1e-4, 0.01, 0.5, 3.0, 40.0])
        a, b = rng.choice([(a, b), (48.3, 11.2)])
        boxes.append((i, a, b, a + size, b + size * rng.random()))
    want = sorted((p, n) for p, a, b in points for n, s, w, e, t in boxes if s <= a <= e and w <= b <= t)
    df = spark.createDataFrame([*points, (700, None, 1.0)], "id int, lat double, lon double")
    kept = spark.createDataFrame([*boxes, (99, None, 0.0, 1.0, 1.0)], "box int, min_lat double, min_lon double, max_lat double, max_lon double")
    got = geo.in_boxes(df, kept)
    assert got.columns == ["id", "lat", "lon", "box"] and sorted((r["id"], r["box"]) for r in got.collect()) == want and len(want) > 700
    assert geo.in_boxes(df, kept.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
