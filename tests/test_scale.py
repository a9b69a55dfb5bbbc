"""What keeps plans lazy, caches whole and joins small: statuses, deltas, cells, unrolled prices, missing packages."""

import builtins
import math
import random

import pytest
from pyspark.sql import functions as F
from test_adapters import docs, prices, stations
from test_publish import AT, _stations, station

from pumpwise.operators import geo
from pumpwise.operators.prices import entry, first_per_fuel, first_valid_columns, first_where, from_columns, keep_valid
from pumpwise.plans import adapters as A
from pumpwise.plans import publish, run
from pumpwise.schema import STATION
from pumpwise.sources import raw as R
from pumpwise.streaming import ingest as I


def test_failed_countries_are_left_out_and_empty_ones_stay(spark):
    rows = spark.createDataFrame([station("1", "IT"), station("2", "NL")], STATION)
    status = spark.createDataFrame(
        [("IT", True, None), ("FR", False, "x"), ("IS", True, None), ("DK", False, "y"), ("POI", True, None)],
        "country string, available boolean, error string"
    )
    own = run.country_status(status, ["NL", "DK"])
    assert {tuple(r) for r in own.collect()} == {("IT", True), ("FR", False), ("IS", True), ("NL", True), ("DK", True)}
    got = publish.metas(rows, run.source_dim(spark), F.lit(AT), own).collect()
    assert {(r["country"], r["station_count"]) for r in got} == {("IT", 1), ("NL", 1), ("IS", 0), ("DK", 0)}
    none = run.country_status(status.where("country <> 'POI'"), [])
    assert {r["country"] for r in none.where("available").collect()} == {"IT", "IS"}


def test_an_unreadable_cache_is_no_empty_cache(spark, tmp_path):
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        publish.load_cache(spark, [str(tmp_path / "broken")])
    assert publish.load_cache(spark, [str(tmp_path / "none")]).count() == 0


def test_streamed_caches_are_deltas_with_a_whole_one_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "COMPACT_EVERY", 2)
    landing, out, cache = (str(tmp_path / x) for x in ("landing", "out", "cache"))
    (tmp_path / "landing").mkdir()
    cities = [f"c{i}" for i in range(12)]
    gazetteer = spark.createDataFrame(
        [("SE", None, c, None, float(i), 0.0, 0) for i, c in enumerate(cities)],
        "country string, street string, city string, postal string, lat double, lon double, rank int"
    )
    query = F.struct(F.col("city").alias("city"), F.lit("").alias("street"), F.lit("").alias("postal"))
    for n in range(6):
        listed = ", ".join(f'{{"id": "{n}-{i}", "city": "{c}"}}' for i, c in enumerate(cities))
        (tmp_path / f"landing/{n}.json").write_text(f"[{listed}]")
        I.ingest_with_cache(
            I.landed(spark, landing), _stations, gazetteer, F.col("city"), query, out, cache, str(tmp_path / "ck"), ["ord"], limit=2
        ).awaitTermination()
        got = {r["city"]: r["lat"] for r in spark.read.parquet(f"{out}/batch={n}").collect()}
        assert got == {c: float(i) if i < 2 * (n + 1) else None for i, c in enumerate(cities)}
    left = sorted(p.name for p in (tmp_path / "cache").iterdir())
    assert left == ["delta=4", "delta=5", "full=3", "full=5"]
    assert I.cache_before(spark, cache, 6).count() == 12 and I.cache_before(spark, cache, 5).count() == 10


@pytest.mark.parametrize("radius", [25.0, 300.0])
def test_radius_cover_around_the_globe(spark, radius):
    rng = random.Random(4)

    def anywhere(n):
        near = [(rng.choice([0.0, 60.0, 89.5, -89.8, -45.0]) + rng.uniform(-0.4, 0.4), rng.choice([-179.9, 179.9, 0.0]) + rng.uniform(-0.4, 0.4)) for _ in range(n)]
        return [(i, max(-90.0, min(90.0, a)), (b + 180) % 360 - 180) for i, (a, b) in enumerate(near)]

    places, grid = anywhere(400), anywhere(40)

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))

    want = sorted((i, g) for i, a, b in places for g, c, d in grid if km(a, b, c, d) <= radius)
    got = geo.radius_cover(
        spark.createDataFrame(places, "id int, lat double, lon double"), spark.createDataFrame(grid, "g_id int, g_lat double, g_lon double"), radius
    )
    assert sorted((r["id"], r["g_id"]) for r in got.collect()) == want and len(want) > 100


def test_unrolled_prices_are_the_first_valid_ones(spark):
    rng = random.Random(6)
    fuels = [("a", "E5", "L"), ("b", "LPG", "L"), ("c", "E5", "L"), ("d", "E5", "kg"), ("e", "LPG", "L")]
    rows = [tuple(rng.choice([None, 0.0, -1.0, float("nan"), 1.5, 2.5]) for _ in fuels) for _ in range(300)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = frame.select(first_valid_columns(fuels, F.col).alias("x"), first_per_fuel(keep_valid(from_columns(fuels, F.col))).alias("y")).collect()
    assert all(r["x"] == r["y"] for r in got) and any(len(r["x"]) == 2 for r in got)


def test_the_first_match_is_final_even_if_it_does_not_parse(spark):
    listed = F.array(*(entry(F.lit(f), F.lit(p), F.lit("L")) for f, p in (("LPG", 9.0), ("E5", None), ("E5", 1.5))))
    assert spark.range(1).select(first_where(listed, lambda p: p["fuel_type"] == "E5").alias("x")).first()["x"]["price"] is None


def test_states_stand_in_for_districts(spark):
    s = {"id": 1, "name": "OMV", "address": {}, "location": {"latitude": 48.2, "longitude": 16.4}, "prices": [{"fuelType": "DIE", "amount": "1.6"}]}
    now = F.lit(AT)
    districts, states = docs(spark, [s], fuel=["DIE"], shard_ord=[0]), docs(spark, [{**s, "id": 2}], fuel=["DIE"], shard_ord=[0])
    assert set(stations(A.austria({"districts": districts, "states": states}, now))) == {"at_1"}
    got = stations(A.austria({"districts": districts.limit(0), "states": states}, now))
    assert set(got) == {"at_2"} and prices(got["at_2"]) == [("DIESEL", 1.6, "EUR", "L")]
    empty = docs(spark, "[]", fuel=["DIE"], shard_ord=[0])  # districts that answer with nothing have answered
    assert stations(A.austria({"districts": empty, "states": states}, now)) == {}


def test_pages_of_several_feeds(spark):
    rows = [("a", 1, [1, 2]), ("a", 2, []), ("a", 3, [9]), ("b", 1, [5]), ("b", 2, [6]), ("c", 2, [7]), ("c", 4, [8])]
    import json

    docs_ = spark.createDataFrame(
        [(f, p, json.dumps({"next": "x", "results": [{"id": i} for i in ids]})) for f, p, ids in rows], "feed string, page int, doc string"
    )
    got = R.pages(docs_, "struct<id: bigint>", feed=["feed"]).collect()
    assert sorted((r["feed"], r["x"]["id"]) for r in got) == [("a", 1), ("a", 2), ("b", 5), ("b", 6), ("c", 7)]


def test_building_an_adapter_starts_no_job(spark):
    """Plans are lazy: what a source holds is read when it is written, not when it is planned."""
    lines = spark.createDataFrame([("f", 0, "idImpianto|x")], "path string, line_ord int, value string")
    bad = lines.withColumn("value", F.raise_error(F.lit("read too early")).cast("string"))
    for country, raw in (("IT", {"registry": bad, "prices": bad}), ("HR", {"all": bad.select("path", F.col("value").alias("doc"))})):
        assert A.ADAPTERS[country](raw, F.lit(AT)).columns


def test_missing_packages_leave_the_core_queries(monkeypatch):
    import sys

    import __spark_entry__ as own

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name.startswith("pumpwise.llm"):
            raise ModuleNotFoundError("No module named 'tiktoken'", name="tiktoken")
        return real(name, *args, **kwargs)

    for name in [m for m in sys.modules if m.startswith("pumpwise.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    with_warning = pytest.warns(UserWarning) if (own.Path(own.__file__).parent / "pumpwise/llm/queries.py").exists() else pytest.MonkeyPatch.context()
    with with_warning:
        assert "first_wins" in own.queries() and not any(n.startswith("op1") for n in own.queries())
