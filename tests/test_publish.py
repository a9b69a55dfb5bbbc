"""Publishing, failure isolation, history and streaming."""

import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from pumpwise.plans import history, publish
from pumpwise.schema import CACHE, STATION
from pumpwise.streaming.ingest import ingest, ingest_with_cache, landed

AT = datetime(2026, 1, 2, 3, 4, 5)


def station(i, country, lat=1.0):
    return (i, country, "n", "b", "a", "c", lat, lat, "s", 0.5, [("E5", 1.5, "EUR", "L", AT)])


def test_files_index_and_counts(spark, tmp_path):
    rows = spark.createDataFrame([station("1", "IT"), station("2", "IT"), station("3", "SE")], STATION)
    publish.write_countries(rows, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["country_code=it", "country_code=se"]
    back = publish.read_combined(spark, str(tmp_path / "out"))
    assert sorted(map(str, back.select(*STATION.fieldNames()).collect())) == sorted(map(str, rows.collect()))
    sources = spark.createDataFrame(
        [(0, "SE", "SEK", "x", 0.8), (1, "IT", "EUR", "y", 0.9), (2, "FR", "EUR", "z", 0.9)],
        "source_ord int, country string, currency string, source string, confidence double"
    )
    metas = publish.metas(rows, sources, F.lit(AT))
    one = publish.index(metas, F.lit(AT)).first()
    assert one["total_stations"] == 3 and [
        (m["country"], m["station_count"]) for m in one["countries"]
    ] == [("SE", 1), ("IT", 2), ("FR", 0)]
    assert one["fetched_at"] == "2026-01-02T03:04:05.000000+00:00"
    publish.write_index(publish.index(metas, F.lit(AT)), str(tmp_path / "index"))
    documents = {r["country"]: json.loads(r["document"]) for r in publish.country_document(rows, metas).collect()}
    assert documents["IT"]["meta"]["station_count"] == 2 and [s["id"] for s in documents["IT"]["stations"]] == ["1", "2"]


def test_cache_files(spark, tmp_path):
    assert publish.load_cache(spark, [str(tmp_path / "none")]).count() == 0
    spark.range(3).write.parquet(str(tmp_path / "odd"))
    attempts = spark.createDataFrame(
        [("SE", "k", 1.0, 2.0), ("SE", "f", None, None)], "country string, geo_key string, lat double, lon double"
    )
    path = publish.save_cache(spark.createDataFrame([("SE", "k", None, None)], CACHE), attempts, str(tmp_path / "cache"))
    got = publish.load_cache(spark, [str(tmp_path / "odd"), path])
    assert {tuple(r) for r in got.collect()} == {("SE", "k", 1.0, 2.0), ("SE", "f", None, None)}


def test_the_newest_whole_version_of_a_cache(spark, tmp_path):
    """Two saves then a load give the second only; half-written versions are passed over; old ones go."""
    root = str(tmp_path / "cache")
    tried = lambda *rows: spark.createDataFrame(list(rows), "country string, geo_key string, lat double, lon double")
    folders = lambda: sorted(p.name for p in (tmp_path / "cache").iterdir() if p.name.startswith("version="))
    read = lambda: {tuple(r) for r in publish.load_cache(spark, [root]).collect()}
    empty = spark.createDataFrame([], CACHE)
    publish.save_cache(empty, tried(("SE", "a", 1.0, 1.0)), root)
    second = publish.save_cache(publish.load_cache(spark, [root]), tried(("SE", "b", 2.0, 2.0)), root)
    assert read() == {("SE", "a", 1.0, 1.0), ("SE", "b", 2.0, 2.0)}
    # A writing that ended before its commit, and one whose files went after it.
    (tmp_path / "cache/version=halfway").mkdir()
    (tmp_path / "cache/version=halfway/part-0.parquet").write_text("no parquet")
    third = Path(publish.save_cache(publish.load_cache(spark, [root]), tried(("SE", "c", 3.0, 3.0)), root))
    assert len(read()) == 3
    (third / "_SUCCESS").unlink()
    assert read() == {("SE", "a", 1.0, 1.0), ("SE", "b", 2.0, 2.0)}
    for k in range(4):
        publish.save_cache(empty, tried(("SE", f"d{k}", 4.0, 4.0)), root)
    assert read() == {("SE", "d3", 4.0, 4.0)}
    # Three versions are left, and what was halfway has gone with the versions that saw it.
    assert len(folders()) == 3 and "version=halfway" not in folders() and Path(second).name not in folders()
    (tmp_path / "none/version=x").mkdir(parents=True)
    assert publish.load_cache(spark, [str(tmp_path / "none"), root]).count() == 1


def test_writers_at_once_both_commit(spark, tmp_path, monkeypatch):
    """A writer whose number was taken while it wrote takes the next."""
    root = str(tmp_path / "cache")
    tried = lambda k: spark.createDataFrame([("SE", k, 1.0, 1.0)], "country string, geo_key string, lat double, lon double")
    empty, inner, taken = spark.createDataFrame([], CACHE), publish.Files.put, []

    def slow(files, name, text):
        if not taken:
            taken.append(name)
            monkeypatch.setattr(publish.Files, "put", inner)
            publish.save_cache(empty, tried("other"), root)
        return inner(files, name, text)

    monkeypatch.setattr(publish.Files, "put", slow)
    publish.save_cache(empty, tried("own"), root)
    assert [r["key"] for r in publish.load_cache(spark, [root]).collect()] == ["own"]
    assert sorted(p.name for p in (tmp_path / "cache/_commits").iterdir() if p.name.isdigit()) == ["000000000000", "000000000001"]


def test_a_failing_source_leaves_the_others(spark, tmp_path):
    good = spark.createDataFrame([station("1", "IT")], STATION)
    bad = good.withColumn("id", F.raise_error(F.lit("broken")).cast("string"))
    union, status = publish.run_all(spark, {"IT": lambda: good, "SE": lambda: bad, "FR": lambda: good.limit(0)}, str(tmp_path / "staging"))
    assert union.count() == 1 and {r["country"]: r["available"] for r in status.collect()} == {"IT": True, "SE": False, "FR": True}


def test_history(spark, tmp_path):
    pulls = spark.createDataFrame(
        [("a", 1, 1.0, AT), ("a", 2, 1.5, AT), ("b", 1, 2.0, AT)], "k string, pull int, price double, at timestamp"
    )
    got = {(r["k"], r["pull"]): r["delta"] for r in history.price_changes(pulls, ["k"], ["pull"]).collect()}
    assert got == {("a", 1): None, ("a", 2): 0.5, ("b", 1): None}
    assert {tuple(r)[2:] for r in history.daily_summary(pulls, ["k"], "at").collect()} == {(2, 1.0, 1.5), (1, 2.0, 2.0)}
    rows = spark.createDataFrame([station("1", "IT")], STATION)
    for day in ("2026-01-01", "2026-01-02", "2026-01-02"):
        history.append_snapshot(rows, day, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2


def _stations(batch):
    x = F.from_json("doc", "array<struct<id: string, city: string>>")
    rows = batch.select(F.posexplode(x).alias("ord", "x"))
    return rows.select(
        F.lit("SE").alias("country"), "ord", "x.id", "x.city", F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lon")
    )


def test_streamed_pulls_carry_the_cache(spark, tmp_path):
    landing, out, cache, check = (tmp_path / x for x in ("landing", "out", "cache", "check"))
    landing.mkdir()
    gazetteer = spark.createDataFrame(
        [("SE", None, c, None, float(i), 0.0, 0) for i, c in enumerate(("lund", "malmo", "umea"))],
        "country string, street string, city string, postal string, lat double, lon double, rank int"
    )
    query = F.struct(F.col("city").alias("city"), F.lit("").alias("street"), F.lit("").alias("postal"))

    def pull(n, *cities):
        (landing / f"{n}.json").write_text(json.dumps([{"id": f"{n}-{i}", "city": c} for i, c in enumerate(cities)]))
        q = ingest_with_cache(
            landed(spark, str(landing)), _stations, gazetteer, F.col("city"), query, str(out), str(cache), str(check), ["ord"], limit=1
        )
        q.awaitTermination()
        return {r["id"]: r["lat"] for r in spark.read.parquet(str(out / f"batch={n}")).collect()}

    assert pull(0, "lund", "malmo", "lund") == {"0-0": 0.0, "0-1": None, "0-2": None}  # one new key a batch, first station of the key
    assert pull(1, "lund", "malmo", "lund") == {"1-0": 0.0, "1-1": 1.0, "1-2": 0.0}
    assert pull(2, "malmo", "nowhere", "umea") == {"2-0": 1.0, "2-1": None, "2-2": None}
    assert pull(3, "nowhere", "umea") == {"3-0": None, "3-1": 2.0}  # a remembered failure is not tried again


def test_plain_ingest(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    for n in range(2):
        (landing / f"{n}.json").write_text('[{"id": "%d"}]' % n)
        ingest(landed(spark, str(landing)), _stations, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(p.name for p in Path(tmp_path / "out").iterdir() if p.is_dir()) == ["batch=0", "batch=1"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
