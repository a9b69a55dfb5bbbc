"""Raw payloads of every source's shape to canonical stations, with the edge rows of real feeds."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pumpwise.functions import dims
from pumpwise.plans import adapters as A
from pumpwise.schema import STATION_COLUMNS
from pumpwise.sources import raw as R

NOW = None


@pytest.fixture(autouse=True, scope="module")
def run_time(spark):
    """Columns need a session."""
    global NOW
    NOW = F.lit(datetime(2026, 1, 2, 3, 4, 5))


def docs(spark, *contents, **shards):
    names = list(shards)
    rows = [
        (f"f{i}", c if isinstance(c, str) else json.dumps(c, ensure_ascii=False), *(shards[n][i] for n in names)) for i,
        c in enumerate(contents)
    ]
    kinds = ", ".join(f"{n} {'int' if n in ('shard_ord', 'page') else 'string'}" for n in names)
    return spark.createDataFrame(rows, "path string, doc string" + (", " + kinds if kinds else ""))


def lines(spark, text):
    return spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "path string, line_ord int, value string")


def stations(df):
    got = df.collect()
    assert set(STATION_COLUMNS) <= set(df.columns)
    return {r["id"]: r for r in got}


def prices(row):
    return [(p["fuel_type"], p["price"], p["currency"], p["unit"]) for p in row["prices"]]


def poi(i, country, fuels, lat=52.0, lon=5.0):
    return {"id": i, "title": "T", "address": {"iso3CountryCode": country, "streetAddress": "S", "city": "C"}, "coordinates": {"latitude": lat, "longitude": lon}, "prices": fuels}


def test_points_of_interest(spark):
    euro = {"fuelType": "EURO95", "fuelName": "Euro 95 (E10)", "value": 2.0}
    values = [
        poi("a|b c", "NLD", [euro, {**euro, "fuelName": "x"}, {"fuelType": "CNG", "value": 1}, {"fuelType": "ODD", "value": 1}]),
        poi("far", "NLD", [euro], lat=10.0), poi("none", "NLD", []),
        poi("text", "NLD", [{**euro, "value": "2.0"}]), poi("true", "NLD", [{**euro, "value": True}]),
        poi("zero", "NLD", [{**euro, "value": 0}]), poi("null", "NLD", [euro], lat=None), poi("pl", "POL", [euro], lon=20.0),
        poi("hu", "HUN", [euro], lat=47.0, lon=19.0), poi("other", "USA", [euro]),
    ]
    rates = spark.createDataFrame([("PLN", 4.25)], "currency string, rate double")
    got = stations(A.points_of_interest(docs(spark, {"value": values}), A.poi_countries(spark), rates, NOW))
    assert set(got) == {"nl_a_b_c", "pl_pl", "hu_hu"}
    assert prices(got["nl_a_b_c"]) == [("E10", 2.0, "EUR", "L"), ("E5", 2.0, "EUR", "L"), ("CNG", 1.0, "EUR", "kg")]
    assert prices(got["pl_pl"]) == [("E10", 8.5, "PLN", "L")] and prices(got["hu_hu"]) == [("E10", 2.0, "EUR", "L")]
    assert got["pl_pl"]["confidence"] == 0.85 and got["pl_pl"]["prices"][0]["updated_at"] == datetime(2026, 1, 2, 3, 4, 5)


def osm(i, kind="node", lat=55.0, lon=13.0, **tags):
    at = {"lat": lat, "lon": lon} if kind == "node" else {"center": {"lat": lat, "lon": lon}}
    tags = {"amenity": "fuel", **tags}
    return {"id": i, "type": kind, "tags": {k.replace("addr_", "addr:"): v for k, v in tags.items() if v is not None}, **at}


def test_sweden(spark):
    elements = [
        osm(1, name="Shell Malmö", brand="Shell", addr_city="Malmö", addr_street="Gatan", addr_housenumber="3"),
        osm(2, "way", brand="ST1", addr_municipality="malmo"), osm(3, lat=None), osm(3, lat=55.5), osm(4)
    ]
    one = {"skane_st1_MalmStorgatan__95": "18,50", "skane_st1_MalmStorgatan__diesel": 19.5, "skane_st1_Malmo__98": 1, "skane_okq8_LundCentrum__95": "17", "bad": 1, "x__95": "abc", "skane_st1_MalmStorgatan__odd": 3}
    two = {"skane_st1_MalmStorgatan__95": "18.75"}
    raw = {"osm": docs(spark, {"elements": elements}), "counties": docs(spark, one, two, {"error": "x", "y__95": "1"}, county=["skane", "blekinge", "z"], shard_ord=[0, 1, 2])}
    got = stations(A.sweden(raw, NOW))
    assert set(got) == {"se_osm_1", "se_osm_2", "se_osm_4"} and all(not got[x]["prices"] for x in got)
    cache = spark.createDataFrame([("SE", "MalmStorgatan", 55.6, 13.0)], "country string, key string, lat double, lon double")
    gazetteer = spark.createDataFrame(
        [("SE", "Centrum", "Lund", None, 55.7, 13.2, 0)],
        "country string, street string, city string, postal string, lat double, lon double, rank int"
    )
    got = stations(A.sweden(raw, NOW, cache, gazetteer))
    assert prices(got["se_skane_st1_MalmStorgatan"]) == [("E10", 18.75, "SEK", "L"), ("DIESEL", 19.5, "SEK", "L")]
    assert got["se_skane_st1_MalmStorgatan"]["county"] == "blekinge" and got["se_skane_okq8_LundCentrum"]["lat"] == 55.7
    assert got["se_skane_st1_MalmStorgatan"]["name"] == "st1 · Storgatan, Malm"
    assert got["se_osm_4"]["name"] == "Bränslestation" and got["se_osm_1"]["address"] == "Gatan 3"


def test_sweden_matches_slots(spark):
    elements = [osm(1, brand="Shell", addr_city="Lund"), osm(2, brand="St1", addr_city="Lund"), osm(3, brand="OKQ8", addr_city="Lund")]
    one = {"c_st1_LundAlfa__95": 1.0, "c_st1_LundBeta__95": 2.0, "c_st1_LundGamma__95": 3.0}
    got = stations(A.sweden({"osm": docs(spark, {"elements": elements}), "counties": docs(spark, one, county=["c"], shard_ord=[0])}, NOW))
    assert {k: prices(v)[0][1] if v["prices"] else None for k, v in got.items()} == {"se_osm_1": 1.0, "se_osm_2": 2.0, "se_osm_3": None}
    assert got["se_osm_1"]["source"] == "bensinpriser.nu" and got["se_osm_1"]["confidence"] == 0.85 and got["se_osm_3"]["confidence"] == 0.75


def test_norway(spark):
    average = docs(spark, {"value": [21.5, 20.25]})
    got = stations(A.norway({"osm": docs(spark, {"elements": [osm(7)]}), "average": average}, NOW))
    assert set(got) == {"no_osm_7"} and got["no_osm_7"]["prices"] == []
    got = stations(A.norway({"osm": docs(spark, {"elements": []}), "average": average}, NOW))
    assert len(got) == 5 and prices(got["no_ssb_oslo"]) == [("E10", 21.5, "NOK", "L"), ("DIESEL", 20.25, "NOK", "L")]
    assert stations(A.norway({"osm": docs(spark, {"elements": []}), "average": docs(spark, {"value": [1.0]})}, NOW)) == {}


def test_denmark(spark):
    one = [
        {"stationId": "1", "city": "Odense", "street": "Vej", "houseNumber": None, "postalCode": "5000", "coordinates": {"latitude": "55.4", "longitude": 0},
         "prices": [
             {"fuelType": "Autobenzin", "octane": "95", "price": "13.5"}, {"fuelType": "Autodiesel", "octane": "", "price": 12},
             {"fuelType": "Autodiesel", "octane": "x", "price": 11}, {"fuelType": "Gas", "price": 1}
         ]},
        {"stationId": "2", "prices": [{"fuelType": "Autobenzin", "octane": "95", "price": "n/a"}]},
    ]
    two = {"data": {"stationsPrices": [{"stationId": "9", "stationName": "Q", "address": "Dronningemaen 34 Svendborg 5700 Danmark", "products": [{"productName": "GoEasy 95 E10", "price": "13"}, {"productName": "Diesel Extra", "price": 14}, {"productName": "AdBlue", "price": 2}]}]}}
    gazetteer = spark.createDataFrame(
        [("DK", None, "Svendborg", None, 55.06, 10.6, 0)],
        "country string, street string, city string, postal string, lat double, lon double, rank int"
    )
    cache = spark.createDataFrame([], "country string, key string, lat double, lon double")
    got = stations(A.denmark({"octanes": docs(spark, one), "products": docs(spark, two)}, NOW, cache, gazetteer))
    assert set(got) == {"dk_shell_1", "dk_q8_9"}
    assert prices(got["dk_shell_1"]) == [("E10", 13.5, "DKK", "L"), ("DIESEL", 12.0, "DKK", "L"), ("DIESEL", 11.0, "DKK", "L")]
    assert (got["dk_shell_1"]["lat"], got["dk_shell_1"]["lon"], got["dk_shell_1"]["postal_code"]) == (55.4, None, "5000")
    assert prices(got["dk_q8_9"]) == [
        ("E10", 13.0, "DKK", "L"), ("DIESEL", 14.0, "DKK", "L")
    ] and got["dk_q8_9"]["lat"] == 55.06 and got["dk_q8_9"]["city"] == "Svendborg"


def finnish(*rows):
    cells = "".join(
        f'<tr class=" bg{1 + i % 2} E10"><td><a href="x?cmd=map&amp;id={n}">m</a>{label}</td>' + "".join(
            f'<td class="Hinnat x">{c}</td>' for c in cs
        ) + "</tr>\n" for i,
        (n, label, cs) in enumerate(rows)
    )
    return f'<html><table class="e10">\n{cells}</table><table class="e10"><tr class=" bg1 E10"></tr></table>'


def test_finland(spark):
    one = finnish(
        (11, " Neste, Katu 1 (Re85 1.649) ", ["1,8", "-", "1.7"]), (12, "Seo", ["-", " ", "-"]), (13, "Few", ["1", "2"]),
        (14, "ABC", ["9", "0", "1,1", "x"])
    )
    two = finnish((11, "Other", ["5", "5", "5"]), (15, "St1 Töölö", ["1", "2", "3"]))
    pages = docs(spark, one, two, "<html>", slug=["Oulu", "Neste", "Kemi"], shard_ord=[0, 1, 2])
    got = stations(A.finland({"pages": pages}, NOW))
    assert set(got) == {"fi_11", "fi_14", "fi_15"}
    assert prices(got["fi_11"]) == [("E10", 1.8, "EUR", "L"), ("DIESEL", 1.7, "EUR", "L"), ("E85", 1.649, "EUR", "L")]
    assert (
        got["fi_11"]["name"], got["fi_11"]["brand"], got["fi_11"]["address"], got["fi_11"]["city"]
    ) == ("Neste, Katu 1", "Neste", "Katu 1", "Oulu")
    assert prices(got["fi_14"]) == [("E5", 1.1, "EUR", "L")] and got["fi_15"]["city"] == "Neste"


def test_iceland(spark):
    row = {"key": "k", "name": " N ", "company": "C", "geo": {"lat": 64.1, "lon": -21.9}, "bensin95": 300.5, "diesel": "310"}
    for payload in (
        [row, {"key": "n", "bensin95": None}], {"stations": [row, {**row, "key": "z", "geo": None, "lat": "65", "lon": "x", "name": ""}]}
    ):
        got = stations(A.iceland({"stations": docs(spark, payload)}, NOW))
        assert prices(got["is_k"]) == [("E5", 300.5, "ISK", "L")] and got["is_k"]["lat"] == 64.1 and got["is_k"]["name"] == "N"
    assert got["is_z"]["lat"] is None and got["is_z"]["name"] == "C"


def test_germany(spark):
    s = {"id": "u", "brand": "ARAL", "name": "Station", "street": "Weg", "houseNumber": "1", "place": "Ulm", "lat": 48.4, "lng": 9.9, "e5": 1.8, "e10": False, "diesel": 1.7}
    areas = docs(
        spark, {"ok": True, "stations": [s]}, {"ok": False, "stations": [{**s, "id": "v"}]},
        {"ok": True, "stations": [{**s, "e5": 9.0}, {**s, "id": "w", "brand": "", "e5": None, "diesel": False}, {**s, "id": "x", "brand": ""}]},
        "junk", shard_ord=[0, 1, 2, 3]
    )
    got = stations(A.germany({"areas": areas}, NOW))
    assert set(got) == {"de_u", "de_x"} and prices(got["de_u"]) == [("E5", 1.8, "EUR", "L"), ("DIESEL", 1.7, "EUR", "L")]
    assert got["de_u"]["name"] == "ARAL Station" and got["de_x"]["name"] == "Station" and got["de_u"]["address"] == "Weg 1"


def test_france(spark):
    s = {"id": 1, "nom_marque": "", "nom": " Total ", "adresse": "Rue", "ville": "Paris", "latitude": "4885000", "longitude": 235000, "gazole_prix": "1.7", "sp95_prix": 0, "sp98_prix": 1.9, "e10_prix": None, "gplc_prix": "x"}
    for payload in ([s], {"results": [], "records": [s]}, {"data": [s]}):
        got = stations(A.france({"stations": docs(spark, payload)}, NOW))
        assert prices(got["fr_1"]) == [("DIESEL", 1.7, "EUR", "L"), ("E5", 1.9, "EUR", "L")]
        assert (got["fr_1"]["lat"], got["fr_1"]["lon"], got["fr_1"]["name"]) == (48.85, 2.35, "Total")
    assert stations(A.france({"stations": docs(spark, {"error": 1}, "<html>")}, NOW)) == {}


def test_spain(spark):
    s = {"IDEESS": "5", "Rótulo": "R", "Dirección": "D", "Municipio": "M", "Latitud": "40,4", "Longitud (WGS84)": "-3,7", "Precio Gasoleo A": "1,499", "Precio Gasolina 95 E5": "", "Precio Gasolina 98 E5": "1,8"}
    got = stations(
        A.spain(
            {"stations": docs(spark, {"ListaEESSPrecio": [s, {**s, "IDEESS": "6", "Latitud": "0", "Longitud (WGS84)": "0"}, {"IDEESS": "7", "Precio Gasoleo A": None}]})},
            NOW
        )
    )
    assert set(got) == {"es_5", "es_6"} and prices(got["es_5"]) == [("DIESEL", 1.499, "EUR", "L"), ("E5", 1.8, "EUR", "L")]
    assert (got["es_5"]["lat"], got["es_5"]["lon"], got["es_6"]["lat"]) == (40.4, -3.7, None)


def test_portugal(spark):
    s = {"Id": 3, "Nome": "N", "Marca": None, "Morada": "R", "Municipio": "L", "Latitude": "38.7", "Longitude": "-9.1", "Preco": "1,499 €"}
    fuels = docs(
        spark, {"status": True, "resultado": [s, {**s, "Id": 4, "Preco": "0 €"}]},
        {"status": True, "resultado": [{**s, "Preco": "1,7", "Nome": "late"}]},
        {"status": True, "resultado": [{**s, "Preco": "1,9"}, {**s, "Id": 5, "Latitude": "1"}]}, {"status": False, "resultado": [s]},
        fuel=["2101", "3201", "3400", "1120"], shard_ord=[0, 1, 2, 3]
    )
    got = stations(A.portugal({"fuels": fuels}, NOW))
    assert set(got) == {"pt_3", "pt_5"} and prices(got["pt_3"]) == [("DIESEL", 1.499, "EUR", "L"), ("E5", 1.7, "EUR", "L")]
    assert got["pt_3"]["name"] == "N" and got["pt_5"]["lat"] is None


def test_austria(spark):
    regions = docs(spark, [{"code": 1, "subRegions": [{"code": 101}, {"code": "x"}, {"code": "102"}]}, {"subRegions": None}])
    assert [r["code"] for r in R.region_codes(regions).orderBy("code_ord").collect()] == [101, 102]
    s = {"id": 1, "name": "OMV, Wien", "address": {"street": "Ring", "streetnumber": "2", "city": "Wien"}, "location": {"latitude": 48.2, "longitude": 16.4}, "prices": [{"fuelType": "DIE", "amount": 0}, {"fuelType": "DIE", "amount": "1.6"}]}
    districts = docs(
        spark, [s, {**s, "id": 2, "prices": []}, {**s, "id": 3, "open": False}], [{**s, "prices": [{"fuelType": "SUP", "amount": 1.7}]}],
        fuel=["DIE", "SUP"], shard_ord=[0, 1]
    )
    got = stations(A.austria({"districts": districts}, NOW))
    assert set(got) == {"at_1"} and prices(got["at_1"]) == [("DIESEL", 1.6, "EUR", "L"), ("E5", 1.7, "EUR", "L")]
    assert (got["at_1"]["brand"], got["at_1"]["address"]) == ("OMV", "Ring 2")


def test_italy(spark):
    registry = lines(
        spark,
        'Estrazione del 2026-01-01\nidImpianto|Gestore|Bandiera|Tipo|Nome Impianto|Indirizzo|Comune|Provincia|Latitudine|Longitudine\n1|G|old|x|N|I|C|P|45,1|9\n1|G|"B|q"|x||I|C|P|45.1|9,2|extra\n2|G||x|N|I|C|P|99|9\n3|G|B|x|N|I|C|P|45|9\n|G'
    )
    facts = lines(
        spark,
        "idImpianto|descCarburante|prezzo|isSelf|dtComu\n1|Gasolio|0|1|d\n1|Gasolio|1.6|1|d\n1|Gasolio BTZ|1.5|1|d\n1|Benzina|abc|1|d\n2|Metano|1,2|0|d\n9|Benzina|1|0|d\n3|Odd|1|0|d"
    )
    got = stations(A.italy({"registry": registry, "prices": facts}, NOW))
    assert set(got) == {"it_1", "it_2"} and prices(got["it_1"]) == [("DIESEL", 1.6, "EUR", "L")] and prices(got["it_2"]) == [("CNG", 1.2, "EUR", "kg")]
    assert (
        got["it_1"]["brand"], got["it_1"]["name"], got["it_1"]["lat"], got["it_2"]["lat"], got["it_2"]["brand"]
    ) == ("B|q", "G", 45.1, None, "G")


def test_slovenia(spark):
    s = {"pk": 5, "name": "P", "address": "A", "zip_code": "1000", "lat": 46.0, "lng": 14.5, "prices": {"98": None, "95": 0, "100": 1.6, "dizel": 1.5, "dizel-premium": 1.9, "cng": "x"}}
    pages = docs(
        spark, {"next": "2", "results": [s]}, {"next": "3", "results": [{**s, "pk": 6, "lat": 10}]}, {"next": None, "results": []},
        {"next": None, "results": [{**s, "pk": 7}]}, page=[1, 2, 3, 4]
    )
    got = stations(A.slovenia({"pages": pages}, NOW))
    assert set(got) == {"si_5", "si_6"} and prices(got["si_5"]) == [("E5", 1.6, "EUR", "L"), ("DIESEL", 1.5, "EUR", "L")]
    assert got["si_5"]["city"] == "1000" and got["si_6"]["lat"] is None
    ended = docs(spark, {"next": None, "results": [s]}, {"next": None, "results": [{**s, "pk": 8}]}, page=[1, 2])
    assert set(stations(A.slovenia({"pages": ended}, NOW))) == {"si_5"}


def test_croatia(spark):
    doc = {
        "gorivos": [
            {"id": 1, "vrsta_goriva_id": 99}, {"id": 1, "vrsta_goriva_id": 7}, {"id": 2, "vrsta_goriva_id": 8},
            {"id": 3, "vrsta_goriva_id": 0}, {"id": 4, "vrsta_goriva_id": 26}
        ],
        "postajas": [
            {"id": 10, "naziv": "INA", "adresa": "A", "mjesto": "M", "lat": "15,9", "lng": None, "long": "45,8", "cjenici": [{"gorivo_id": 1, "cijena": "0"}, {"gorivo_id": 2, "cijena": "1,4"}, {"gorivo_id": 1, "cijena": 1.3}, {"gorivo_id": 3, "cijena": 1}, {"gorivo_id": 4, "cijena": 1.1}]},
            {"id": 11, "naziv": "X", "cjenici": [{"gorivo_id": 77, "cijena": 1}]},
        ],
    }
    got = stations(A.croatia({"all": docs(spark, doc)}, NOW))
    assert set(got) == {"hr_10"} and prices(got["hr_10"]) == [("DIESEL", 1.4, "EUR", "L"), ("CNG", 1.1, "EUR", "kg")]
    assert (got["hr_10"]["lat"], got["hr_10"]["lon"]) == (45.8, 15.9)


def test_croatia_in_two_documents(spark):
    """Stations at the same place of two documents are two; a product's last row, in the order of paths, counts for both."""
    one = {"gorivos": [{"id": 1, "vrsta_goriva_id": 1}], "postajas": [{"id": 1, "naziv": "A", "cjenici": [{"gorivo_id": 1, "cijena": 1.5}]}]}
    two = {"gorivos": [{"id": 1, "vrsta_goriva_id": 7}], "postajas": [{"id": 2, "naziv": "B", "cjenici": [{"gorivo_id": 1, "cijena": 1.6}]}]}
    got = stations(A.croatia({"all": docs(spark, one, two)}, NOW))
    assert {k: prices(v) for k, v in got.items()} == {"hr_1": [("DIESEL", 1.5, "EUR", "L")], "hr_2": [("DIESEL", 1.6, "EUR", "L")]}


def romanian(*rows):
    return f"<script>var rezultate = JSON.parse('{json.dumps(rows)}');</script>"


def test_romania(spark):
    pages = docs(
        spark,
        romanian(
            ["OMV", 45.00001, 25.0, "C", "A", 7.5], ["OMV", 45.00002, 25.0, "late", "A", 8.0], ["MOL", 10, 25, "C", "A", 7],
            ["MOL", 45, 25, "C"], ["Unlisted", 45.1, 25.1, "C", "A", 7.5], [None, 45.2, 25.2, "C", "A", 7.5], ["Rom Petrol", 45.3, 25.3, "D", "A", 7.6]
        ),
        romanian(["OMV", "45.00001", "25", "C2", "A2", "8.1"], ["MOL", 45.5, 25.5, "C", "A", 0]), "none",
        fuel=["Benzina_Regular", "Motorina_Regular", "GPL"], shard_ord=[0, 1, 2])
    got = sorted(stations(A.romania({"pages": pages}, NOW)).values(), key=lambda x: x["city"])
    # Only listed networks stay, however they are spelled.
    assert [x["brand"] for x in got] == ["OMV", "Rom Petrol"]
    assert prices(got[0]) == [("E5", 7.5, "RON", "L"), ("DIESEL", 8.1, "RON", "L")] and got[0]["city"] == "C"


def test_charsets(spark):
    df = spark.createDataFrame([(bytearray("﻿é€".encode()),), (bytearray(b"\xe9"),)], "c binary")
    assert [r[0] for r in df.select(R.decode(F.col("c"))).collect()] == ["é€", "é"]
    df = spark.createDataFrame([(bytearray("é€“”Ž".encode("cp1252")),)], "c binary")
    assert df.select(R.decode(F.col("c"), "windows-1252")).first()[0] == "é€“”Ž"


def test_rates(spark):
    got = R.xml_rates(
        docs(spark, "<Cube currency='USD' rate='1.1'/><Cube currency=\"SEK\" rate=\"11\"/>", "<Cube currency='SEK' rate='12.5'/>")
    )
    assert {r["currency"]: r["rate"] for r in got.collect()} == {"USD": 1.1, "SEK": 12.5}


@pytest.mark.parametrize("country", sorted(A.ADAPTERS))
def test_every_adapter_has_a_source(country):
    assert country in {s[0] for s in dims.SOURCES}


def test_a_whole_run(spark, tmp_path):
    """Own sources, the feed that adds or stands in, a broken source; then the index."""
    from pumpwise.plans import publish, run

    euro = {"fuelType": "DIESEL", "value": 1.5}
    feed = {"value": [poi("n", "NLD", [euro]), poi("d", "DNK", [euro], 55.5, 10.0), poi("e", "ESP", [euro], 40.0, -3.0), poi("g", "DEU", [euro], 50.0, 10.0)]}
    area = {"ok": True, "stations": [{"id": "u", "lat": 48.4, "lng": 9.9, "e5": 1.8}]}
    broken = docs(spark, "[]").withColumn("doc", F.raise_error(F.lit("gone")).cast("string"))
    raw = {
        "POI": {"stations": docs(spark, feed)}, "DE": {"areas": docs(spark, area, shard_ord=[0])}, "FR": {"stations": broken},
        "IS": {"stations": docs(spark, [{"key": "k", "diesel": 300}])},
    }
    rates = spark.createDataFrame([("DKK", 7.5)], "currency string, rate double")
    rows, status = run.run_sources(spark, raw, rates, NOW, str(tmp_path / "staging"))
    got = stations(rows)
    assert set(got) == {"nl_n", "dk_d", "es_e", "de_u", "is_k"} and prices(got["dk_d"]) == [("DIESEL", 11.25, "DKK", "L")]
    assert {r["country"]: r["available"] for r in status.collect()} == {"POI": True, "DE": True, "FR": False, "IS": True}
    one = publish.index(publish.metas(rows, run.source_dim(spark), NOW), NOW).first()
    assert one["total_stations"] == 5 and [m["country"] for m in one["countries"]] == dims.COUNTRY_ORDER
    assert run.poi_scope({"DE": True, "ES": True}) == [c[0] for c in dims.POI_COUNTRIES if c[0] not in ("DE", "ES")]


@pytest.mark.parametrize("answer, stands_in", [("<html>busy</html>", True), ('{"ListaEESSPrecio": [', True), ('{"ListaEESSPrecio": []}', False), (None, True)])
def test_a_feed_that_cannot_be_read_gets_a_stand_in(spark, tmp_path, answer, stands_in):
    """Decided by what the write of the source has read, not by what has landed; an empty answer is an answer."""
    from pumpwise.plans import run

    euro = {"fuelType": "DIESEL", "value": 1.5}
    feed = {"value": [poi("n", "NLD", [euro]), poi("e", "ESP", [euro], 40.0, -3.0), poi("g", "DEU", [euro], 50.0, 10.0)]}
    areas = docs(spark, {"ok": True, "stations": [{"id": "u", "lat": 48.4, "lng": 9.9, "e5": 1.8}]}, "no answer", shard_ord=[0, 1])
    raw = {"POI": {"stations": docs(spark, feed)}, "DE": {"areas": areas}, "ES": {"stations": docs(spark, "{}").withColumn("doc", F.lit(answer).cast("string"))}}
    rates = spark.createDataFrame([("DKK", 7.5)], "currency string, rate double")
    rows, status = run.run_sources(spark, raw, rates, NOW, str(tmp_path / "staging"))
    assert set(stations(rows)) == {"nl_n", "de_u"} | ({"es_e"} if stands_in else set())
    got = {r["country"]: r for r in status.collect()}
    assert got["ES"]["available"] is not stands_in and (got["ES"]["documents"], got["ES"]["readable"]) == (1, 0 if stands_in else 1)
    # The counts of a source come from its own write.
    de = got["DE"]
    assert (de["documents"], de["readable"], de["station_count"], de["with_coordinates"], de["with_prices"]) == (2, 1, 1, 1, 1)
    assert got["POI"]["station_count"] == 1 + stands_in and ("ES" in got["POI"]["scope"]) is stands_in and "DE" not in got["POI"]["scope"]


def test_an_element_without_the_tag_is_no_station(spark):
    elements = [osm(1, name="A"), osm(2, amenity=None, name="B"), osm(3, amenity="cafe", name="C"), {"id": 4, "type": "node", "lat": 55.0, "lon": 13.0}]
    assert [r["name"] for r in A._osm(docs(spark, {"elements": elements}), "SE", "x").collect()] == ["A"]
