"""Scalar expressions against plain Python, with the awkward values of real feeds."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pumpwise.functions import scalars as S


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string").select("i", expr(F.col("c")).alias("v"))
    return [r["v"] for r in sorted(df.collect(), key=lambda r: r["i"])]


NUMBERS = [
    "1.5", " 2 ", "", None, "-3", "+4.", ".5", "1e3", "1_000", "1.5d", "nan", "inf", "0x1", "1,5", "1.2.3", "--1", " 7 ", "abc", "True",
    "1 2"
]


def test_number(spark):
    want = [1.5, 2.0, None, None, -3.0, 4.0, 0.5, 1000.0, None, None, None, None, None, None, None, None, 7.0, None, None, None]
    assert values(spark, NUMBERS, S.number) == want
    assert values(spark, ["1,499", "1.499", "1.234,5", "1,499 €", None], S.decimal_comma) == [1.499, 1.499, None, None, None]
    assert values(spark, ["1,499 €", "€2", " - €", None], S.strip_symbol) == [1.499, 2.0, None, None]


def test_valid_price(spark):
    df = spark.createDataFrame(
        [(x,) for x in (1.5, 0.0, -1.0, float("nan"), None)], "p double"
    ).select(S.valid_price(F.col("p")).alias("v"))
    assert [r["v"] for r in df.collect()] == [True, False, False, False, False]


def brute_key(t):
    return re.sub("[^a-z0-9]", "", "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)))


def test_norm_key(spark):
    rng = random.Random(1)
    texts = ["Tromsø", "Łódź", "Straße", "Malmö Öst 7", "ÀÉÎõü", "İstanbul", "Kelvin", "", "ﬁ", "①"] + [
        "".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x1E00, 0x1F00)])) for _ in range(12)) for _ in range(400)
    ]
    got = values(spark, texts, S.norm_key)
    assert got[:4] == ["troms", "odz", "strae", "malmoost7"]
    assert got == [brute_key(t) for t in texts]


def test_brand_key(spark):
    assert values(
        spark, ["Shell Express", " Statoil", "", None, "  ", "Öl-Depot X"], S.brand_key
    ) == ["st1", "circlek", "", "", "", "oldepot"]


def brute_composite(text):
    parts = text.split("_")
    if len(parts) < 2:
        return (text, text, "", "", "")
    rest = parts[1:]
    at = next((i for i, s in enumerate(rest) if re.match("[A-Z][a-z]{2,}[A-Z]", s)), len(rest))
    brand, geo = ("_".join(rest[:at]) if rest[:at] else parts[1]), (rest[at] if at < len(rest) else "")
    words = re.findall("[A-Z][a-z]*", geo)
    city, street = (words[0], " ".join(words[1:])) if words else (geo, "")
    shown = brand.replace("_", " ")
    return (f"{shown} · {street}, {city}" if street and city else f"{shown} · {city}" if city else shown, brand, geo, city, street)


def test_composite_ids(spark):
    rng = random.Random(3)
    bits = ["lan", "circle", "k", "St1", "MalmStorgatan", "SolnaCentrum", "Åbo", "X", "", "ABc", "HelloWorldAgain"]
    texts = ["_".join(rng.choices(bits, k=rng.randint(1, 5))) for _ in range(500)]
    assert [tuple(v) for v in values(spark, texts, S.parse_composite_id)] == [brute_composite(t) for t in texts]


def brute_address(text):
    m = re.search("[0-9]{4}", text or "")
    if not m:
        return ("", "", "")
    words = text[: m.start()].split()
    return (words[-1] if words else "", m[0], " ".join(words[:-1]))


def test_addresses(spark):
    rng = random.Random(4)
    texts = [None, "", "Dronningemaen 34 Svendborg 5700 Danmark"] + [
        " ".join(rng.choices(["Vej", "12", "By", "5700", "123", "99999", "X1234"], k=rng.randint(0, 6))) for _ in range(300)
    ]
    assert [tuple(v) for v in values(spark, texts, S.parse_address)] == [brute_address(t) for t in texts]


def test_small_parsers(spark):
    assert [
        tuple(v) for v in values(spark, ["a__b__c", "x", "__y", "p__", "é__ü\n__z"], S.rsplit_key)
    ] == [("a__b", "c"), ("", ""), ("", "y"), ("p", ""), ("é__ü\n", "z")]
    assert [
        tuple(v) for v in values(spark, ["Neste, Main 1, X", "Neste", ", y"], S.split_comma)
    ] == [("Neste", "Main 1, X"), ("Neste", ""), ("", "y")]
    assert [
        tuple(v) for v in values(spark, ["Abc (Re85 1.649)", "Abc (Re85 1.2.3) d", "Abc"], S.embedded_price)
    ] == [("Abc", 1.649), ("Abc  d", None), ("Abc", None)]
    assert values(spark, [" - ", "-", "", "  ", None, " 1,5"], S.sentinel_to_null) == [None, None, None, None, None, "1,5"]
    assert [
        tuple(v) for v in values(spark, ["MalmöStorgatan", "abc", "StockholmVasaGatan", ""], S.split_camel)
    ] == [("Malm", "Storgatan"), ("abc", ""), ("Stockholm", "Vasa Gatan"), ("", "")]


def test_points(spark):
    def pt(df_row, expr, schema):
        r = spark.createDataFrame([df_row], schema).select(expr.alias("p")).first()["p"]
        return None if r is None else tuple(r)

    two = "a string, b string"
    assert pt(("0", "12.5"), S.zero_to_null(F.col("a"), F.col("b")), two) == (None, 12.5)
    assert pt(("x", "12.5"), S.zero_to_null(F.col("a"), F.col("b")), two) is None
    box = (42.3, 13.4, 46.9, 19.5)
    four = "a string, b string, c string, d string"
    fields = [F.col(x) for x in "abcd"]
    assert pt(("15,5", "45,1", None, None), S.repair_axes(fields, box), four) == (45.1, 15.5)
    assert pt(("45,1", None, None, "x"), S.repair_axes(fields, box), four) is None
    assert pt(("45,1", "46", None, None), S.repair_axes(fields, box), four) is None
    flat = "a double, b double, c double, d double"
    assert pt((None, None, 4885000.0, 235000.0), S.descale(*fields), flat) == (48.85, 2.35)
    assert pt((0.0, 9.0, 48.0, 2.0), S.descale(*fields), flat) == (48.0, 2.0)
    assert pt((47.0, 9.0, 48.0, 2.0), S.descale(*fields), flat) == (47.0, 9.0)


def test_geocode_query(spark):
    rows = [
        ("Oulu", "Road 1", "90"), ("Shell", "Road 1", "90"), ("4-tie", "", ""), ("Keha_ I", "R", ""), (None, None, "1"), ("", "R", None)
    ]
    df = spark.createDataFrame(rows, "c string, s string, p string").select(
        S.geocode_query(F.col("c"), F.col("s"), F.col("p"), ["Shell"]).alias("q")
    )
    got = [r["q"] and tuple(r["q"]) for r in df.collect()]
    assert got == [("Oulu", "Road 1", ""), ("", "Road 1", "90"), None, ("", "R", ""), None, ("", "R", "")]


@pytest.mark.parametrize("a,b,km", [((52.52, 13.405), (48.1351, 11.582), 504), ((0, 0), (0, 180), 20015)])
def test_haversine(spark, a, b, km):
    got = spark.range(1).select(S.haversine_km(*(F.lit(float(x)) for x in (*a, *b))).alias("d")).first()["d"]
    assert abs(got - km) < 2
