"""Order-sensitive operators against plain loops over random rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from pumpwise.operators import dedup, geo, geocode, lookup, match, money
from pumpwise.operators.prices import entry, first_per_fuel, keep_valid
from pumpwise.queries import QUERIES

RNG = random.Random(11)
ROWS = [
    (
        RNG.choice("abcde"), i // 7, i % 7, RNG.choice([None, "x", "y", "z"]), RNG.choice([-1.0, 0.0, 1.5, 2.5, float("nan")])
    ) for i in range(300)
]
SCHEMA = "k string, shard int, row int, v string, p double"


def rows(spark):
    shuffled = ROWS[:]
    random.Random(5).shuffle(shuffled)
    return spark.createDataFrame(shuffled, SCHEMA).repartition(7)


def key(r):
    return str(tuple(r))


def test_first_and_last_wins(spark):
    first, last, place = {}, {}, {}
    for r in ROWS:
        first.setdefault(r[0], r)
        place.setdefault(r[0], r[1:3])
        last[r[0]] = r
    got = dedup.first_wins(rows(spark), ["k"], ["shard", "row"]).collect()
    assert sorted(map(key, got)) == sorted(map(key, first.values()))
    got = dedup.last_wins(rows(spark), ["k"], ["shard", "row"]).collect()
    assert sorted(map(key, got)) == sorted(key((k, *place[k], *r[3:])) for k, r in last.items())


def test_first_valid_and_first_then_filter(spark):
    valid, first = {}, {}
    for r in ROWS:
        first.setdefault(r[0], r)
        if r[4] > 0:
            valid.setdefault((r[0], r[3]), r)
    from pumpwise.functions.scalars import valid_price

    got = dedup.first_valid(rows(spark), ["k", "v"], ["shard", "row"], valid_price(F.col("p"))).collect()
    assert sorted(map(key, got)) == sorted(map(key, valid.values()))
    got = dedup.first_then_filter(rows(spark), ["k"], ["shard", "row"], valid_price(F.col("p"))).collect()
    assert sorted(map(key, got)) == sorted(key(r) for r in first.values() if r[4] > 0)


def test_merge_partials(spark):
    answers = [
        (
            RNG.choice("abcd"), i, f"name{i}",
            [(RNG.choice(["E5", "E10", "LPG"]), float(i * 10 + j), "L") for j in range(RNG.randint(0, 3))]
        ) for i in range(60)
    ]
    want = {}
    for k, i, name, prices in answers:
        if k not in want:
            want[k] = (i, name, [])
        for p in prices:
            if p[0] not in {q[0] for q in want[k][2]}:
                want[k][2].append(p)
    df = spark.createDataFrame(
        answers, "k string, i int, name string, prices array<struct<fuel_type: string, price: double, unit: string>>"
    ).repartition(5)
    got = {r["k"]: (r["i"], r["name"], [tuple(p) for p in r["prices"]]) for r in dedup.merge_partials(df, "k", ["i"]).collect()}
    assert got == want


def test_price_arrays(spark):
    prices = F.array(
        *(
            entry(F.lit(f), F.lit(p), F.lit("L")) for f,
            p in (("E5", 0.0), ("E5", 1.5), ("LPG", float("nan")), ("E5", 2.0), ("CNG", 3.0), ("LPG", None))
        )
    )
    got = spark.range(1).select(first_per_fuel(keep_valid(prices)).alias("p"), keep_valid(prices).alias("all")).first()
    assert [tuple(p) for p in got["p"]] == [("E5", 1.5, "L"), ("CNG", 3.0, "L")] and len(got["all"]) == 3


def test_greedy_matching(spark):
    rng = random.Random(9)
    locations = [(i, rng.choice(["st1", "okq8", "", None]), rng.choice(["malmo", "lund", ""])) for i in range(200)]
    records = [(i, rng.choice(["st1", "okq8", ""]), rng.choice(["malmo", "lund", "umea"]), float(i)) for i in range(260)]
    free = defaultdict(list)
    for i, b, c in locations:
        if b and c:
            free[b, c].append(i)
    paired, left = {}, []
    for i, b, c, _ in records:
        if b and c and free[b, c]:
            paired[free[b, c].pop(0)] = float(i)
        else:
            left.append(i)
    l = spark.createDataFrame(locations, "id int, bk string, ck string").repartition(3)
    r = spark.createDataFrame(records, "rid int, bk string, ck string, price double").repartition(4)
    got = {x["id"]: x["price"] for x in match.match_slots(l, r, ["bk", "ck"], ["id"], ["rid"], ["price"]).collect()}
    assert got == {i: paired.get(i) for i, *_ in locations}
    assert sorted(x["rid"] for x in match.unmatched_records(l, r, ["bk", "ck"], ["id"], ["rid"]).collect()) == left
    both, rest = match.match_and_rest(l, r, ["bk", "ck"], ["id"], ["rid"], ["price"])
    assert {x["id"]: x["price"] for x in both.collect()} == got and sorted(x["rid"] for x in rest.collect()) == left


def test_money(spark):
    df = spark.createDataFrame([(1, 2.0, "SEK"), (2, 2.0, "EUR"), (3, 2.0, "XXX"), (4, 2.0, "ZRO")], "i int, price double, cur string")
    rates = spark.createDataFrame([("SEK", 11.2345), ("ZRO", 0.0)], "currency string, rate double")
    got = {r["i"]: (r["price"], r["price_currency"]) for r in money.convert(df, rates, "price", "cur").collect()}
    assert got == {1: (22.469, "SEK"), 2: (2.0, "EUR"), 3: (2.0, "EUR"), 4: (2.0, "EUR")}
    base = {r["i"]: r["base_price"] for r in money.to_base(df, rates, "price", "cur").collect()}
    assert base[2] == 2.0 and base[3] is None and abs(base[1] - 2 / 11.2345) < 1e-12


CACHE = "country string, key string, lat double, lon double"


def test_geocode_cache(spark):
    stations = spark.createDataFrame(
        [
            ("SE", "k1", 1, None, None), ("SE", "k2", 2, None, None), ("SE", "", 3, None, None), ("SE", "k3", 4, None, None),
            ("SE", "k3", 5, None, None), ("NO", "k1", 6, None, None), ("SE", "k1", 7, 9.0, 9.0)
        ],
        "country string, geo_key string, id int, lat double, lon double")
    cache = spark.createDataFrame([("SE", "k1", 1.0, 2.0), ("SE", "k2", None, None)], CACHE)
    hit = geocode.apply_cache(stations, cache)
    got = {r["id"]: (r["lat"], r["lon"]) for r in hit.collect()}
    assert got[1] == got[7] == (1.0, 2.0) and all(got[i] == (None, None) for i in (2, 3, 4, 5, 6))
    waiting = geocode.backlog(hit, cache, ["id"])
    assert sorted(r["id"] for r in waiting.collect()) == [4, 6]
    assert geocode.take_turn(waiting, ["id"], limit=0).count() == 0 and {r["left_over"] for r in geocode.left_over(waiting, 0).collect()} == {1}
    attempts = spark.createDataFrame(
        [("SE", "k3", 5.0, 6.0), ("NO", "k1", None, None)], "country string, geo_key string, lat double, lon double"
    )
    assert geocode.grown_cache(cache, attempts).count() == 4


def test_gazetteer(spark):
    gazetteer = spark.createDataFrame(
        [
            ("SE", "Storgatan", "Malmö", None, 1.0, 1.0, 2), ("SE", "Storgatan", "Malmö", None, 2.0, 2.0, 1),
            ("SE", None, "Malmö", None, 3.0, 3.0, 0), ("SE", None, None, "123", 4.0, 4.0, 0)
        ],
        "country string, street string, city string, postal string, lat double, lon double, rank int")
    asked = spark.createDataFrame(
        [
            (1, "SE", ("malmo", "STORGATAN", "")), (2, "SE", ("Malmö", "Other", "")), (3, "SE", ("Lund", "", "")),
            (4, "SE", ("", "x", "123")), (5, "SE", None), (6, "NO", ("Malmö", "", ""))
        ],
        "i int, country string, query struct<city: string, street: string, postal: string>")
    assert {r["i"]: r["lat"] for r in geocode.look_up(asked, gazetteer).collect()} == {1: 2.0, 2: 3.0, 3: None, 4: 4.0, 5: None, 6: None}


def test_lookups(spark):
    df = spark.createDataFrame(
        [("Autobenzin", "95"), ("Autobenzin", ""), ("Autodiesel", "x"), ("Autodiesel", None), (None, None)], "t string, o string"
    )
    from pumpwise.functions import dims

    got = [r[0] for r in df.select(lookup.with_wildcard(dims.DK_OCTANES, F.col("t"), F.col("o"))).collect()]
    assert got == ["E10", None, "DIESEL", "DIESEL", None]
    names = spark.createDataFrame([("GoEasy 95 Extra",), ("95 e10",), ("diesel extra",), ("Water",), (None,)], "n string")
    assert [r[0] for r in names.select(lookup.by_keyword(dims.DK_KEYWORDS, F.col("n"))).collect()] == ["E5", "E10", "DIESEL", None, None]


def test_fallback(spark):
    primary = spark.createDataFrame([("DE", 1), ("ES", 2)], "country string, id int")
    secondary = spark.createDataFrame([("DE", 10, "x"), ("IT", 11, "y"), ("ES", 12, "z")], "country string, id int, extra string")
    status = spark.createDataFrame([("DE", True), ("ES", False), ("IT", True)], "country string, available boolean")
    assert sorted(r["id"] for r in lookup.fallback(primary, secondary, status, "country").collect()) == [1, 12]


def test_radius_cover(spark):
    rng = random.Random(2)
    places = [(i, 47 + rng.random() * 3, 8 + rng.random() * 4) for i in range(300)]
    grid = [(i, 47 + rng.random() * 3, 8 + rng.random() * 4) for i in range(12)]
    from math import asin, cos, radians, sin, sqrt

    def km(a, b, c, d):
        h = sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2
        return 2 * 6371.0088 * asin(sqrt(h))

    want = {(i, g) for i, a, b in places for g, c, d in grid if km(a, b, c, d) <= 25}
    got = geo.radius_cover(
        spark.createDataFrame(places, "id int, lat double, lon double"),
        spark.createDataFrame(grid, "g_id int, g_lat double, g_lon double"), 25.0
    )
    assert {(r["id"], r["g_id"]) for r in got.collect()} == want and want


def test_tag_filter_keeps_every_tagged_element(spark, tmp_path):
    """All even events have the tag, multiples of three among them; odd ones, with another tag or none, go."""
    events = [(i, t, f'{{"k": {i}}}') for i in range(12) for t in ("click", "error")]
    spark.createDataFrame(events, "event_id bigint, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r[0] for r in QUERIES["tag_filter"](spark, str(tmp_path)).collect()) == [0, 2, 4, 6, 8, 10]
