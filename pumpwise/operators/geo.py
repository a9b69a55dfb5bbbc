"""Coordinates in boxes and circles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pumpwise.functions.scalars import haversine_km, within
from pumpwise.staging import staged

#: Kilometres in a degree of latitude.
KM_PER_DEGREE = 111.0
EARTH_KM = 6371.0


def require_coordinates(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())


def null_outside(df: DataFrame, box: tuple[float, float, float, float], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Coordinates outside the box become null together; rows stay."""
    inside = within(F.col(lat), F.col(lon), box)
    return df.withColumns({lat: F.when(inside, F.col(lat)), lon: F.when(inside, F.col(lon))})


def drop_outside(df: DataFrame, box: tuple[float, float, float, float], lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.where(within(F.col(lat), F.col(lon), box))


def in_country(df: DataFrame, countries: DataFrame, iso3: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows with their country's columns: the ISO-3 code joins, the country's box filters.  One join for all countries."""
    boxes = countries.withColumnRenamed("iso3", "__iso3")
    at = (F.col(iso3) == F.col("__iso3")) & F.col(lat).between(F.col("min_lat"), F.col("max_lat")) & F.col(lon).between(F.col("min_lon"), F.col("max_lon"))
    return df.join(boxes, at).drop("__iso3", "min_lat", "min_lon", "max_lat", "max_lon")


#: Finest level of the cells of boxes: level n has cells of 180 / 2^n degrees.
FINEST = 20


def in_boxes(df: DataFrame, boxes: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows with the columns of every box that holds them, borders included; boxes may overlap and need no code that names them.

    boxes have min_lat, min_lon, max_lat, max_lon, which are dropped, and any other columns.  A box is cut into the cells of the level at which it
    spans two at most each way; a row is in one cell of each level that boxes use, 21 at most, so the join is an equi-join on cells, and the borders
    are checked after it.  Each row and box meet once.  Rows without coordinates and boxes without a border match nothing, nor does a
    box that ends before it begins: one across the date line is given as two.
    """
    sides = ("min_lat", "min_lon", "max_lat", "max_lon")
    span = F.greatest(F.col("max_lat") - F.col("min_lat"), F.col("max_lon") - F.col("min_lon"), F.lit(180.0 / 2**FINEST))
    level = F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(F.lit(180.0) / span)))).cast("int")
    boxes = boxes.where("min_lat <= max_lat AND min_lon <= max_lon").withColumn("__level", level)

    def cell(at: Column, low: float) -> Column:
        return F.floor((at - low) * F.pow(F.lit(2.0), F.col("__level")) / 180)

    for name, side, low in (("__y", "lat", -90.0), ("__x", "lon", -180.0)):
        boxes = boxes.withColumn(name, F.explode(F.sequence(cell(F.col(f"min_{side}"), low), cell(F.col(f"max_{side}"), low))))
    levels = [r[0] for r in boxes.select("__level").distinct().collect()]  # of 21 at most
    rows = require_coordinates(df, lat, lon).withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    rows = rows.withColumns({"__y": cell(F.col(lat), -90.0), "__x": cell(F.col(lon), -180.0)})
    inside = F.col(lat).between(F.col("min_lat"), F.col("max_lat")) & F.col(lon).between(F.col("min_lon"), F.col("max_lon"))
    return rows.join(boxes, ["__level", "__y", "__x"]).where(inside).drop("__level", "__y", "__x", *sides)


def radius_cover(df: DataFrame, grid: DataFrame, radius_km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows within the radius of any grid point (g_id, g_lat, g_lon), with the point's id and distance_km; a row may match several points.

    Cells of the radius's height and width make the join an equi-join: a point is in the cell of a row or in one next to it.  A band
    of latitude has as many cells around the globe as are wide enough at its edge nearer to the pole, near the poles one.
    """
    height = radius_km / KM_PER_DEGREE * 1.01
    half = math.sin(radius_km / EARTH_KM / 2) * 1.01

    def cells(band: Column) -> Column:
        """How many cells a band has: at its far edge, and that of the next band, the radius spans at most one of them."""
        edge = F.radians(F.greatest(F.abs(band * height), F.abs((band + 1) * height)) + height)
        width = 2 * F.degrees(F.asin(F.least(F.lit(half) / F.cos(edge), F.lit(1.0))))
        return F.when(edge < math.pi / 2 - 0.01, F.greatest(F.floor(360 / width), F.lit(1))).otherwise(F.lit(1)).cast("bigint")

    def cell(band: Column, at: Column, step: int = 0) -> Column:
        n = cells(band)
        return F.pmod(F.floor((at + 180) / 360 * n) + step, n)

    band = F.floor(F.col(lat) / height)
    near = [
        F.struct((at + up).alias("__band"), cell(at + up, F.col("g_lon"), side).alias("__cell"))
        for at in (F.floor(F.col("g_lat") / height),) for up in (-1, 0, 1) for side in (-1, 0, 1)
    ]
    around = grid.withColumn("__at", F.explode(F.array_distinct(F.array(*near)))).select(*grid.columns, "__at.*")
    placed = df.withColumns({"__band": band, "__cell": cell(band, F.col(lon))})
    near = placed.join(around, ["__band", "__cell"]).drop("__band", "__cell")
    away = near.withColumn("distance_km", haversine_km(F.col(lat), F.col(lon), F.col("g_lat"), F.col("g_lon")))
    return away.where(F.col("distance_km") <= radius_km)


def nearest(
    points: DataFrame, sites: DataFrame, k: int, point: str = "id", site: str = "site_id", first_km: float | None = None, lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """The k nearest sites of every point by distance, then id: point, site, distance_km, place (from 1).

    points has point (each value once), lat and lon, sites the same with site; rows without coordinates take no part.  With fewer than k sites
    each point gets all of them; no points or no sites give no rows.

    Rings of cells: every point meets the sites within a radius, by an equi-join on cells.  All sites within the radius are there, so a point that has k
    of them is done; the others go on with twice the radius, until it spans half the globe.  The first radius is the one that holds 2 k sites at the
    mean density of the sites' box, so points in dense parts are done at once and later rounds hold few points.  Of sites at one place only the k with
    the least ids are looked at.
    """
    columns = (lambda df, key, to: require_coordinates(df, lat, lon).select(F.col(key).alias(to), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")))
    at_place = "row_number() OVER (PARTITION BY lat, lon ORDER BY site)"
    sites = columns(sites, site, "site").withColumn("__place", F.expr(at_place)).where(F.col("__place") <= k).drop("__place")
    sites, left = staged(sites), staged(columns(points, point, "g_id").withColumnsRenamed({"lat": "g_lat", "lon": "g_lon"}))
    radius = first_km or _first_radius(sites, k)
    found = []
    while True:
        near = radius_cover(sites, left, radius).select("g_id", "site", "distance_km")
        near = near.withColumn("place", F.expr("row_number() OVER (PARTITION BY g_id ORDER BY distance_km, site)")).where(F.col("place") <= k)
        near = staged(near)
        if radius > math.pi * EARTH_KM * 1.01:  # farther than any two points are
            found.append(near)
            break
        done = near.where(F.col("place") == k).select("g_id")
        found.append(near.join(done, "g_id", "left_semi"))
        left = staged(left.join(done, "g_id", "left_anti"))
        if left.isEmpty():
            break
        radius = min(2 * radius, math.pi * EARTH_KM * 1.02)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.col("g_id").alias(point), F.col("site").alias(site), "distance_km", "place")


def _first_radius(sites: DataFrame, k: int) -> float:
    """The radius of a circle that holds 2 k sites on average, were they spread evenly over their box; kilometres."""
    n, south, north, west, east = sites.agg(F.count(F.lit(1)), *(f(c) for c in ("lat", "lon") for f in (F.min, F.max))).first()
    if not n:
        return math.pi * EARTH_KM * 1.02
    width = KM_PER_DEGREE * (east - west) * math.cos(math.radians((south + north) / 2))
    return max(0.05, math.sqrt(2 * k * max(1.0, KM_PER_DEGREE * (north - south)) * max(1.0, width) / (n * math.pi)))


def around(lat: float, lon: float, radius_km: float) -> Column:
    """A box of latitude and longitude that holds the circle, in plain comparisons that a scan can check against its statistics."""
    dlat = radius_km / KM_PER_DEGREE * 1.01
    box = F.col("lat").between(lat - dlat, lat + dlat)
    edge = abs(lat) + dlat
    if edge >= 89:
        return box
    dlon = math.degrees(2 * math.asin(min(1.0, math.sin(min(math.pi / 2, radius_km / EARTH_KM / 2)) * 1.01 / math.cos(math.radians(edge)))))
    west, east = lon - dlon, lon + dlon
    if dlon >= 180:
        return box
    if west < -180 or east > 180:  # across the date line
        return box & ((F.col("lon") >= (west + 180) % 360 - 180) | (F.col("lon") <= (east + 180) % 360 - 180))
    return box & F.col("lon").between(west, east)


def cheapest_near(df: DataFrame, lat: float, lon: float, radius_km: float, k: int, price: str = "price", key: str = "id") -> DataFrame:
    """The k cheapest rows within the radius of a point, ties by distance, then key: a top-k report."""
    away = haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    near = df.where(around(lat, lon, radius_km)).withColumn("distance_km", away)
    return near.where(F.col("distance_km") <= radius_km).orderBy(price, "distance_km", key).limit(k)
