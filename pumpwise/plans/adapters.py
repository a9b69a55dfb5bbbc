"""One adapter per country: raw documents to the canonical stations.

raw maps feed names to DataFrames of landed documents (path, doc) or lines; run_at is
the time of the run.  Adapters are lazy and independent of each other.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwise.functions import dims
from pumpwise.functions import scalars as S
from pumpwise.operators import dedup, geo, geocode, lookup, match, money
from pumpwise.operators.prices import canonical, entry, first_valid_columns, first_where, from_columns, keep_valid, unnest, with_prices
from pumpwise.sources import raw as R

Raw = Mapping[str, DataFrame]
_SOURCE = {c: (currency, source, confidence) for c, currency, source, confidence in dims.SOURCES}


def _meta(df: DataFrame, country: str, source: str | None = None, confidence: float | None = None) -> DataFrame:
    _, name, sure = _SOURCE[country]
    return df.withColumns(
        {"country": F.lit(country), "source": F.lit(source or name), "confidence": F.lit(sure if confidence is None else confidence)}
    )


def _text(c: str) -> Column:
    return S.strip(F.coalesce(F.col(c), F.lit("")))


def _place(df: DataFrame, point: Column) -> DataFrame:
    return df.withColumn("__p", point).withColumns({"lat": F.col("__p.lat"), "lon": F.col("__p.lon")}).drop("__p")


def poi_countries(spark: SparkSession, countries: list[str] | None = None) -> DataFrame:
    rows = [c for c in dims.POI_COUNTRIES if countries is None or c[0] in countries]
    return lookup.dim(
        spark, rows,
        "country string, iso3 string, min_lat double, min_lon double, max_lat double, max_lon double, target string, confidence double"
    )


def points_of_interest(docs: DataFrame, countries: DataFrame, rates: DataFrame, run_at: Column) -> DataFrame:
    """Stations of all countries of the point-of-interest feed, in one scan and one join."""
    element = (
        "struct<id: string, title: string, address: struct<iso3CountryCode: string, streetAddress: string, city: string>, "
        "coordinates: struct<latitude: double, longitude: double>, prices: array<struct<fuelType: string, fuelName: string, value: double>>>"
    )
    rows = R.json_list(docs, element, ["value"]).select(
        "x.*", F.col("x.address.iso3CountryCode").alias("code"), F.col("x.coordinates.latitude").alias("lat"),
        F.col("x.coordinates.longitude").alias("lon")
    )
    rows = geo.in_country(geo.require_coordinates(rows), countries, "code")
    fuels, units = [(c, f) for c, f, _ in dims.POI_FUELS], [(c, u) for c, _, u in dims.POI_FUELS]

    def mapped(p: Column) -> Column:
        code = p["fuelType"]
        fuel = lookup.overridden(code, "EURO95", F.coalesce(p["fuelName"], F.lit("")), "E10", "E10", "E5", lookup.code_map(fuels, code))
        return entry(fuel, p["value"], F.coalesce(lookup.code_map(units, code), F.lit("L")))

    prices = F.filter(keep_valid(F.transform("prices", mapped)), lambda p: p["fuel_type"].isNotNull())
    title = F.coalesce("title", F.lit(""))
    rows = rows.select(
        S.sanitize_id(F.col("country"), F.col("id")).alias("id"), "country", title.alias("name"), title.alias("brand"),
        F.coalesce("address.streetAddress", F.lit("")).alias("address"), F.coalesce("address.city", F.lit("")).alias("city"),
        "lat", "lon", F.lit(dims.POI_SOURCE).alias("source"), "confidence", prices.alias("raw_prices"), "target",
    )
    return canonical(money.convert_nested(with_prices(rows, F.col("raw_prices"), "EUR", run_at), rates, "target"))


def _osm(docs: DataFrame, country: str, default: str) -> DataFrame:
    """Fuel stations of a map feed; the first element of an id decides, even if it has no coordinates."""
    rows = lookup.tagged(R.map_elements(docs), "amenity", "fuel", ("node", "way"))
    rows = geo.require_coordinates(dedup.first_wins(rows, ["element_id"], ["path", "row_ord"]))
    tag = (lambda k: F.col("tags")[k])
    return rows.select(
        F.concat(F.lit(f"{country.lower()}_osm_"), F.col("element_id").cast("string")).alias("id"), F.lit(country).alias("country"),
        S.first_nonblank(tag("name"), tag("brand"), tag("operator"), default=default).alias("name"),
        S.first_nonblank(tag("brand"), tag("operator"), tag("name")).alias("brand"),
        S.join_address(tag("addr:street"), tag("addr:housenumber")).alias("address"),
        S.first_nonblank(tag("addr:city"), tag("addr:town"), tag("addr:village")).alias("city"), "lat", "lon",
        F.lit("openstreetmap.org").alias("source"), F.lit(0.75).alias("confidence"),
        F.array().cast("array<struct<fuel_type: string, price: double, unit: string>>").alias("raw_prices"),
        S.brand_key(S.first_nonblank(tag("brand"), tag("operator"), tag("name"))).alias("bk"),
        S.norm_key(S.first_nonblank(tag("addr:city"), tag("addr:town"), tag("addr:village"), tag("addr:municipality"))).alias("ck"),
        F.struct("path", "row_ord").alias("at"),
    )


def sweden_priced(docs: DataFrame) -> DataFrame:
    """Priced stations of the county feed (county, shard_ord): the last price of a fuel counts, the last county too."""
    key = S.rsplit_key(F.col("key"))
    facts = lookup.of_shape(R.flat_map(docs), "key", "__").withColumn("k", key)
    facts = facts.select(
        "county", F.struct("shard_ord", "row_ord").alias("at"), F.col("k.head").alias("station"), F.col("k.tail").alias("code"),
        S.decimal_comma(F.col("value")).alias("price")
    )
    facts = facts.where(S.valid_price(F.col("price")) & F.col("code").isin(*(c for c, _, _ in dims.SE_FUELS)))
    by_code = facts.groupBy("station", "code").agg(F.max_by("price", "at").alias("price"))
    first = facts.groupBy("station").agg(F.min("at").alias("at"), F.max_by("county", "at").alias("county"))
    wide = by_code.groupBy("station").agg(F.map_from_entries(F.collect_list(F.struct("code", "price"))).alias("m"))
    rows = first.join(wide, "station").withColumn("p", S.parse_composite_id(F.col("station")))
    prices = keep_valid(from_columns(dims.SE_FUELS, lambda c: F.col("m")[c]))
    return rows.select(
        F.concat(F.lit("se_"), F.col("station")).alias("id"), F.lit("SE").alias("country"), "p.name", "p.brand",
        F.col("p.street").alias("address"), "p.city", "p.geo_key", "county",
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit("bensinpriser.nu").alias("source"),
        F.lit(0.85).alias("confidence"),
        prices.alias("raw_prices"), S.brand_key(F.col("p.brand")).alias("bk"), S.norm_key(F.col("p.city")).alias("ck"), "at",
    )


def sweden(raw: Raw, run_at: Column, cache: DataFrame | None = None, gazetteer: DataFrame | None = None) -> DataFrame:
    """Known locations with the prices of their matches, and priced records left over that could be located."""
    places, priced = _osm(raw["osm"], "SE", "Bränslestation"), sweden_priced(raw["counties"])
    priced = priced.where(F.size("raw_prices") > 0)
    keys = ["bk", "ck"]
    matched, rest = match.match_and_rest(places, priced, keys, ["at"], ["at"], ["raw_prices", "source", "confidence"])
    located = geo.require_coordinates(
        enriched(rest, cache, gazetteer, F.col("geo_key"), S.geocode_query(F.col("city"), F.col("address"), F.lit("")), ["at"])
    )
    both = lookup.union_sources(matched.drop("matched"), located.drop("geo_key"))
    return canonical(with_prices(both, F.col("raw_prices"), "SEK", run_at, keep_empty=True), ["county"])


def enriched(
    stations: DataFrame, cache: DataFrame | None, gazetteer: DataFrame | None, key: Column, query: Column, order: list[str],
    limit: int = geocode.LIMIT
) -> DataFrame:
    """Coordinates from the cache, then from the gazetteer for this run's share of keys never tried.

    A new answer goes to the first station of its key; others get it from the cache in the next run.
    """
    rows = stations.withColumn("__gk", F.coalesce(key, F.lit("")))
    if cache is not None:
        rows = geocode.apply_cache(rows, cache, key="__gk")
        if gazetteer is not None:
            turn = geocode.take_turn(geocode.backlog(rows, cache, order, key="__gk"), order, limit).withColumn("query", query)
            new = geocode.look_up(turn.select("country", "id", "query"), gazetteer).select(
                "country", "id", F.col("lat").alias("__lat"), F.col("lon").alias("__lon")
            )
            rows = rows.join(new.where("__lat IS NOT NULL"), ["country", "id"], "left")
            rows = rows.withColumns({"lat": F.coalesce("lat", "__lat"), "lon": F.coalesce("lon", "__lon")}).drop("__lat", "__lon")
    return rows.drop("__gk")


def norway(raw: Raw, run_at: Column) -> DataFrame:
    """Known locations without prices; if there are none, five cities carry the national average."""
    places = with_prices(_osm(raw["osm"], "NO", "Bensinstasjon"), F.col("raw_prices"), "NOK", run_at, keep_empty=True)
    spark = places.sparkSession
    average = R.positional_cube(raw["average"], dims.NO_FUELS).where(S.valid_price(F.col("price")))
    average = average.agg(
        F.array_sort(F.collect_list(F.struct("fuel_ord", "fuel_type", "price", "unit"))).alias("v")
    ).where(F.size("v") > 0)
    markers = lookup.dim(spark, dims.NO_MARKERS, "city string, lat double, lon double").join(F.broadcast(average), F.lit(True))  # one row
    markers = markers.select(
        F.concat(F.lit("no_ssb_"), F.lower("city")).alias("id"), F.lit("NO").alias("country"),
        F.concat(F.lit("Norway Avg · "), "city").alias("name"),
        F.lit("National Average").alias("brand"), F.lit("SSB Statistics Norway · monthly avg").alias("address"), "city", "lat", "lon",
        F.lit("ssb.no (national monthly avg)").alias("source"), F.lit(0.85).alias("confidence"),
        F.transform("v", lambda p: entry(p["fuel_type"], p["price"], p["unit"])).alias("raw_prices"),
    )
    markers = with_prices(markers, F.col("raw_prices"), "NOK", run_at)
    status = places.limit(1).agg((F.count(F.lit(1)) > 0).alias("available")).withColumn("country", F.lit("NO"))
    return canonical(lookup.fallback(canonical(places), canonical(markers), status, "country"))


def denmark(raw: Raw, run_at: Column, cache: DataFrame | None = None, gazetteer: DataFrame | None = None) -> DataFrame:
    """Two networks' own feeds; several prices of one fuel stay."""
    price = "array<struct<fuelType: string, octane: string, price: string>>"
    element = f"struct<stationId: string, city: string, street: string, houseNumber: string, postalCode: string, coordinates: struct<latitude: string, longitude: string>, prices: {price}>"
    one = R.json_list(raw["octanes"], element, root=True).select("x.*")
    octanes = F.transform(
        "prices", lambda p: entry(lookup.with_wildcard(dims.DK_OCTANES, p["fuelType"], p["octane"]), S.number(p["price"]), F.lit("L"))
    )
    one = _meta(
        _place(one, S.zero_to_null(F.coalesce("coordinates.latitude", F.lit("0")), F.coalesce("coordinates.longitude", F.lit("0")))), "DK",
        "shellpumpepriser.geoapp.me"
    )
    one = one.withColumns({
        "id": F.concat(F.lit("dk_shell_"), F.coalesce("stationId", F.lit(""))),
        "name": F.trim(F.concat(F.lit("Shell "), F.coalesce("city", F.lit("")))), "brand": F.lit("Shell"),
        "address": S.join_address(F.col("street"), F.col("houseNumber")), "city": F.coalesce("city", F.lit("")),
        "postal_code": F.coalesce("postalCode", F.lit("")),
        "raw_prices": F.filter(keep_valid(octanes), lambda p: p["fuel_type"].isNotNull()),
    })
    two = raw["products"].withColumn("doc", F.get_json_object("doc", "$.data"))
    element = "struct<stationId: string, stationName: string, address: string, products: array<struct<productName: string, price: string>>>"
    two = R.json_list(two, element, ["stationsPrices"]).select("row_ord", "x.*").withColumn("p", S.parse_address(F.col("address")))
    named = F.transform(
        "products", lambda p: entry(lookup.by_keyword(dims.DK_KEYWORDS, p["productName"]), S.number(p["price"]), F.lit("L"))
    )
    two = _meta(two, "DK", "beta.q8.dk").withColumns({
        "id": F.concat(F.lit("dk_q8_"), F.coalesce("stationId", F.lit(""))), "name": F.coalesce("stationName", F.lit("")),
        "brand": F.coalesce("stationName", F.lit("")),
        "address": F.coalesce("address", F.lit("")), "city": F.col("p.city"), "postal_code": F.col("p.postal"),
        "geo_street": F.col("p.street"),
        "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double"),
        "raw_prices": F.filter(keep_valid(named), lambda p: p["fuel_type"].isNotNull()),
    }).where(F.size("raw_prices") > 0)
    two = enriched(
        two, cache, gazetteer, F.col("id"), S.geocode_query(F.col("city"), F.col("geo_street"), F.col("postal_code")), ["row_ord"]
    )
    parts = [canonical(with_prices(x, F.col("raw_prices"), "DKK", run_at), ["postal_code"]) for x in (one, two)]
    return lookup.union_sources(*parts)


# The tables of the pages.
FI_TABLE, FI_ROW = r'(?s)<table class="e10">(.*?)</table>', r'(?s)<tr class=" bg[12] E10">(.*?)</tr>'
FI_CELL = r'<td[^>]*class="Hinnat[^"]*"[^>]*>([^<]+)</td>'


def finland(raw: Raw, run_at: Column, cache: DataFrame | None = None, gazetteer: DataFrame | None = None) -> DataFrame:
    """Price tables of pages (slug, shard_ord); the first page that lists a station decides."""
    rows = R.table_rows(raw["pages"], FI_TABLE, FI_ROW, FI_CELL)
    rows = rows.withColumns(
        {"number": F.regexp_extract("html", r"cmd=map&(?:amp;)?id=([0-9]+)", 1), "label": F.regexp_extract("html", r"</a>([^<]+)", 1)}
    )
    rows = rows.where(
        (F.col("number") != "") & (F.col("label") != "") & (F.size("cells") >= 3)
    ).withColumn("e", S.embedded_price(S.strip(F.col("label"))))
    last = (lambda i: S.decimal_comma(S.sentinel_to_null(F.element_at("cells", i - 3))))
    prices = [
        entry(F.lit(f), last(i), F.lit(u)) for i, (f, u) in enumerate(dims.FI_FUELS)
    ] + [entry(F.lit("E85"), F.col("e.price"), F.lit("L"))]
    rows = rows.withColumn("raw_prices", keep_valid(F.array(*prices))).where(F.size("raw_prices") > 0)
    rows = _meta(rows, "FI").withColumn("b", S.split_comma(F.col("e.rest"))).select(
        F.concat(F.lit("fi_"), "number").alias("id"), "country", F.col("e.rest").alias("name"), "b.brand", "b.address",
        F.col("slug").alias("city"),
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), "source", "confidence", "raw_prices",
        F.struct("shard_ord", "row_ord").alias("at"),
    )
    rows = dedup.first_wins(rows, ["id"], ["at"])
    query = S.geocode_query(F.col("city"), F.col("address"), F.lit(""), dims.FI_BRAND_SLUGS)
    return canonical(with_prices(enriched(rows, cache, gazetteer, F.col("id"), query, ["at"]), F.col("raw_prices"), "EUR", run_at))


def iceland(raw: Raw, run_at: Column) -> DataFrame:
    element = "struct<key: string, name: string, company: string, geo: struct<lat: string, lon: string>, lat: string, lon: string, bensin95: double, diesel: double>"
    rows = R.json_list(raw["stations"], element, ["stations"], root=True).select("x.*")
    rows = _place(rows, S.nested_or_flat(F.col("geo.lat"), F.col("geo.lon"), F.col("lat"), F.col("lon")))
    name, company = _text("name"), _text("company")
    rows = _meta(rows, "IS").withColumns({
        "id": F.concat(F.lit("is_"), F.coalesce("key", name)), "brand": company, "name": F.coalesce(S.nonblank(name), company),
        "address": F.lit(""), "city": F.lit(""),
        "raw_prices": keep_valid(from_columns(dims.IS_FUELS, F.col)),
    })
    return canonical(with_prices(rows, F.col("raw_prices"), "ISK", run_at))


def germany(raw: Raw, run_at: Column) -> DataFrame:
    """Answers per grid point (shard_ord); the first point that lists a station decides.  The fallback is the point-of-interest feed."""
    element = "struct<id: string, brand: string, name: string, street: string, houseNumber: string, place: string, lat: double, lng: double, e5: double, e10: double, diesel: double>"
    docs = R.gate(raw["areas"], F.from_json("doc", "struct<ok: boolean>")["ok"])
    rows = R.json_list(docs, element, ["stations"]).select(F.struct("shard_ord", "row_ord").alias("at"), "x.*")
    rows = _meta(rows, "DE").select(
        F.concat(F.lit("de_"), F.coalesce("id", F.lit(""))).alias("id"), "country",
        S.brand_and_name(F.col("brand"), F.col("name")).alias("name"), F.coalesce("brand", F.lit("")).alias("brand"),
        S.join_address(F.col("street"), F.col("houseNumber")).alias("address"), F.coalesce("place", F.lit("")).alias("city"), "lat",
        F.col("lng").alias("lon"), "source", "confidence",
        keep_valid(from_columns(dims.DE_FUELS, F.col)).alias("raw_prices"), "at",
    ).where(F.size("raw_prices") > 0)
    return canonical(with_prices(dedup.first_wins(rows, ["id"], ["at"]), F.col("raw_prices"), "EUR", run_at))


def france(raw: Raw, run_at: Column) -> DataFrame:
    fuels = ", ".join(f"{c}: string" for c, _, _ in dims.FR_FUELS)
    element = f"struct<id: string, nom_marque: string, nom: string, adresse: string, ville: string, geom: struct<lat: string, lon: string>, latitude: string, longitude: string, {fuels}>"
    rows = R.json_list(raw["stations"], element, ["results", "records", "data"], root=True).select("x.*")
    rows = _place(
        rows, S.descale(S.number(F.col("geom.lat")), S.number(F.col("geom.lon")), S.number(F.col("latitude")), S.number(F.col("longitude")))
    )
    brand = S.strip(S.first_nonblank(F.col("nom_marque"), F.col("nom")))
    rows = _meta(rows, "FR").withColumns({
        "id": F.concat(F.lit("fr_"), F.coalesce("id", F.lit(""))), "name": brand, "brand": brand, "address": _text("adresse"),
        "city": _text("ville"),
        "raw_prices": first_valid_columns(dims.FR_FUELS, lambda c: S.number(F.col(c))),
    })
    return canonical(with_prices(rows, F.col("raw_prices"), "EUR", run_at))


def spain(raw: Raw, run_at: Column) -> DataFrame:
    """The national feed; the fallback is the point-of-interest feed."""
    names = ["IDEESS", "Rótulo", "Dirección", "Municipio", "Latitud", "Longitud (WGS84)", *(c for c, _, _ in dims.ES_FUELS)]
    rows = R.json_list(raw["stations"], "struct<" + ", ".join(f"`{n}`: string" for n in names) + ">", ["ListaEESSPrecio"]).select("x.*")
    lat, lon = S.decimal_comma(F.coalesce("Latitud", F.lit("0"))), S.decimal_comma(F.coalesce(F.col("`Longitud (WGS84)`"), F.lit("0")))
    rows = _place(rows, F.when((lat != 0) | (lon != 0), S.bounded(lat, lon, (-90.0, -180.0, 90.0, 180.0))).otherwise(F.expr(S.NO_POINT)))
    brand = F.coalesce("Rótulo", F.lit(""))
    rows = _meta(rows, "ES").withColumns({
        "id": F.concat(F.lit("es_"), F.coalesce("IDEESS", F.lit(""))), "name": brand, "brand": brand,
        "address": F.coalesce("Dirección", F.lit("")), "city": F.coalesce("Municipio", F.lit("")),
        "raw_prices": first_valid_columns(dims.ES_FUELS, lambda c: S.decimal_comma(F.col(f"`{c}`"))),
    })
    return canonical(with_prices(rows, F.col("raw_prices"), "EUR", run_at))


def _merged(rows: DataFrame, country: str, run_at: Column) -> DataFrame:
    currency = _SOURCE[country][0]
    return canonical(with_prices(dedup.merge_partials(rows, "id", ["at"], "raw_prices"), F.col("raw_prices"), currency, run_at))


def portugal(raw: Raw, run_at: Column) -> DataFrame:
    """Answers per fuel (fuel, shard_ord), merged by station."""
    docs = R.gate(raw["fuels"], F.from_json("doc", "struct<status: boolean>")["status"])
    element = "struct<Id: string, Nome: string, Marca: string, Morada: string, Municipio: string, Latitude: string, Longitude: string, Preco: string>"
    rows = R.json_list(docs, element, ["resultado"]).select("fuel", F.struct("shard_ord", "row_ord").alias("at"), "x.*")
    rows = _meta(_place(rows, S.bounded(S.number(F.col("Latitude")), S.number(F.col("Longitude")), dims.BOUNDS["PT"])), "PT")
    price = entry(lookup.code_map([(c, f) for c, f, _ in dims.PT_FUELS], F.col("fuel")), S.strip_symbol(F.col("Preco")), F.lit("L"))
    rows = rows.select(
        F.concat(F.lit("pt_"), F.coalesce("Id", F.lit(""))).alias("id"), "country", _text("Nome").alias("name"),
        _text("Marca").alias("brand"), _text("Morada").alias("address"),
        _text("Municipio").alias("city"), "lat", "lon", "source", "confidence", keep_valid(F.array(price)).alias("raw_prices"), "at",
    )
    return _merged(rows.where(F.size("raw_prices") > 0), "PT", run_at)


def austria(raw: Raw, run_at: Column) -> DataFrame:
    """Answers per district and fuel (fuel, shard_ord), open stations only, merged by station.

    Where no district has answered, those of the nine states stand in, if they have landed (states, as districts).
    """
    element = (
        "struct<id: string, name: string, open: boolean, address: struct<street: string, streetnumber: string, city: string>, "
        "location: struct<latitude: double, longitude: double>, prices: array<struct<fuelType: string, amount: string>>>"
    )
    docs = raw["districts"]
    if "states" in raw:
        status = docs.limit(1).agg((F.count(F.lit(1)) > 0).alias("available")).withColumn("level", F.lit("AT"))
        docs, states = (x.withColumn("level", F.lit("AT")) for x in (docs, raw["states"]))
        docs = lookup.fallback(docs, states, status, "level").drop("level")
    rows = R.json_list(docs, element, root=True).select("fuel", F.struct("shard_ord", "row_ord").alias("at"), "x.*")
    rows = lookup.open_stations(rows)
    fuel = F.col("fuel")
    own = first_where(F.col("prices"), lambda p: (p["fuelType"] == fuel) & (F.coalesce(S.nonblank(p["amount"]), F.lit("0")) != "0"))
    codes, units = [(c, f) for c, f, _ in dims.AT_FUELS], [(c, u) for c, _, u in dims.AT_FUELS]
    price = entry(lookup.code_map(codes, fuel), S.number(own["amount"]), lookup.code_map(units, fuel))
    rows = _meta(rows, "AT").select(
        F.concat(F.lit("at_"), F.coalesce("id", F.lit(""))).alias("id"), "country", F.coalesce("name", F.lit("")).alias("name"),
        S.split_comma(F.coalesce("name", F.lit("")))["brand"].alias("brand"),
        S.join_address(F.col("address.street"), F.col("address.streetnumber")).alias("address"),
        F.coalesce("address.city", F.lit("")).alias("city"), F.col("location.latitude").alias("lat"),
        F.col("location.longitude").alias("lon"), "source", "confidence",
        keep_valid(F.array(price)).alias("raw_prices"), "at",
    )
    return _merged(rows.where(F.size("raw_prices") > 0), "AT", run_at)


IT_REGISTRY = [
    "idImpianto", "Gestore", "Bandiera", "Tipo Impianto", "Nome Impianto", "Indirizzo", "Comune", "Provincia", "Latitudine", "Longitudine"
]
IT_PRICES = ["idImpianto", "descCarburante", "prezzo", "isSelf", "dtComu"]


def italy(raw: Raw, run_at: Column) -> DataFrame:
    """A registry (the last line of an id counts) joined to price facts (the first valid price of a fuel counts)."""
    registry = R.csv_after_preamble(raw["registry"], "idImpianto", IT_REGISTRY)
    registry = dedup.last_wins(registry.withColumn("sid", _text("idImpianto")).where("sid <> ''"), ["sid"], ["line_ord"])
    registry = _place(
        registry,
        S.bounded(
            S.decimal_comma(F.coalesce("Latitudine", F.lit("0"))), S.decimal_comma(F.coalesce("Longitudine", F.lit("0"))), dims.BOUNDS["IT"]
        )
    )
    facts = R.csv_after_preamble(raw["prices"], "idImpianto", IT_PRICES).withColumns(
        {"sid": _text("idImpianto"), "code": _text("descCarburante"), "price": S.decimal_comma(F.col("prezzo"))}
    )
    facts = lookup.map_codes(
        facts, "code", lookup.fuel_dim(facts.sparkSession, dims.IT_FUELS), "fuel_code"
    ).select("sid", "fuel_type", "unit", "price", "line_ord")
    facts = dedup.first_valid(facts, ["sid", "fuel_type"], ["line_ord"], S.valid_price(F.col("price")))
    listed = dedup.ordered_list(facts, ["sid"], ["line_ord"], entry(F.col("fuel_type"), F.col("price"), F.col("unit")), "raw_prices")
    rows = _meta(lookup.registry_join(registry, listed, "sid"), "IT").select(
        F.concat(F.lit("it_"), "sid").alias("id"), "country",
        S.strip(S.first_nonblank(F.col("`Nome Impianto`"), F.col("Gestore"))).alias("name"),
        S.strip(S.first_nonblank(F.col("Bandiera"), F.col("Gestore"))).alias("brand"), _text("Indirizzo").alias("address"),
        _text("Comune").alias("city"), "lat", "lon", "source", "confidence", "raw_prices",
    )
    return canonical(with_prices(rows, F.col("raw_prices"), "EUR", run_at))


def slovenia(raw: Raw, run_at: Column) -> DataFrame:
    """Numbered pages (page); the zip code serves as city.  A station without a number gets the hash of its name and address."""
    element = "struct<pk: string, name: string, address: string, zip_code: string, lat: string, lng: string, prices: map<string,string>>"
    rows = R.pages(raw["pages"], element).select("x.*")
    rows = _place(rows, S.bounded(S.number(F.col("lat")), S.number(F.col("lng")), dims.BOUNDS["SI"]))
    sid = F.coalesce(F.nullif("pk", F.lit("0")), dedup.stable_id(F.col("name"), F.col("address")))
    rows = _meta(rows, "SI").withColumns({
        "id": F.concat(F.lit("si_"), sid), "name": _text("name"), "brand": _text("name"), "address": _text("address"),
        "city": _text("zip_code"),
        "raw_prices": first_valid_columns(dims.SI_FUELS, lambda c: S.number(F.col("prices")[c])),
    })
    return canonical(with_prices(rows.drop("prices"), F.col("raw_prices"), "EUR", run_at))


def croatia(raw: Raw, run_at: Column) -> DataFrame:
    """Prices name products, products name categories, categories fuels; coordinates may be swapped.  One document or several, in the order of their paths."""
    products = R.json_list(raw["all"], "struct<id: string, vrsta_goriva_id: string>", ["gorivos"]).select(
        "path", "row_ord", F.col("x.id").alias("product"), F.col("x.vrsta_goriva_id").alias("category")
    )
    known = products.where((F.coalesce("product", F.lit("0")) != "0") & (F.coalesce("category", F.lit("0")) != "0"))
    products = dedup.last_wins(known, ["product"], ["path", "row_ord"]).drop("path", "row_ord")
    element = (
        "struct<id: string, naziv: string, brand: string, adresa: string, mjesto: string, lat: string, lng: string, long: string, lon: string, "
        "cjenici: array<struct<gorivo_id: string, cijena: string>>>"
    )
    stations = R.json_list(raw["all"], element, ["postajas"]).select("path", "row_ord", "x.*")
    station = ["path", "row_ord"]
    facts = unnest(stations, station, "cjenici", "price_ord", "c").select(
        *station, "price_ord", F.col("c.gorivo_id").alias("gid"), S.decimal_comma(F.col("c.cijena")).alias("price")
    )
    facts = lookup.two_hops(
        facts, "gid", products, "product", "category", lookup.fuel_dim(stations.sparkSession, dims.HR_FUELS), "fuel_code"
    )
    facts = dedup.first_valid(
        facts.select(*station, "price_ord", "fuel_type", "unit", "price"), [*station, "fuel_type"], ["price_ord"],
        S.valid_price(F.col("price"))
    )
    listed = dedup.ordered_list(facts, station, ["price_ord"], entry(F.col("fuel_type"), F.col("price"), F.col("unit")), "raw_prices")
    rows = stations.join(listed, station)
    rows = _place(rows, S.repair_axes([F.col(c) for c in ("lat", "lng", "long", "lon")], dims.BOUNDS["HR"]))
    brand = S.strip(S.first_nonblank(F.col("naziv"), F.col("brand")))
    sid = F.coalesce("id", dedup.stable_id(F.col("naziv"), F.col("adresa"), F.col("mjesto")))
    rows = _meta(rows, "HR").withColumns(
        {"id": F.concat(F.lit("hr_"), sid), "name": brand, "brand": brand, "address": _text("adresa"), "city": _text("mjesto")}
    )
    return canonical(with_prices(rows, F.col("raw_prices"), "EUR", run_at))


# Fixed value: where the page keeps its answer.
RO_LITERAL = r"(?s)var rezultate\s*=\s*JSON\.parse\('(\[.*?\])'\)"


def romania(raw: Raw, run_at: Column) -> DataFrame:
    """Page literals per fuel and county (fuel, shard_ord, fuel-major); rows of the listed networks; those of one brand and rounded place are one station, its id the hash of that key."""
    rows = R.embedded_literal(raw["pages"], RO_LITERAL, 6)
    at = (lambda i: F.get("x", F.lit(i)))
    rows = rows.select(
        "fuel", F.struct("shard_ord", "row_ord").alias("at"), S.strip(at(0)).alias("brand"), S.number(at(1)).alias("lat"),
        S.number(at(2)).alias("lon"), S.strip(at(3)).alias("city"), S.strip(at(4)).alias("address"), S.number(at(5)).alias("price")
    )
    rows = geo.drop_outside(lookup.of_networks(rows, "brand", dims.RO_NETWORKS), dims.BOUNDS["RO"]).where(S.valid_price(F.col("price")))
    codes = lookup.code_map([(c, f) for c, f, _ in dims.RO_FUELS], F.col("fuel"))
    rows = dedup.group_by_place(rows, "brand", "lat", "lon", ["at"]).drop("place_at")
    rows = rows.withColumn("raw_prices", F.array(entry(codes, F.col("price"), F.lit("L")))).drop("fuel", "price")
    rows = _meta(dedup.merge_partials(rows, "place_key", ["at"], "raw_prices"), "RO")
    rows = rows.withColumns({"id": F.concat(F.lit("ro_"), dedup.stable_id(F.col("place_key"))), "name": F.col("brand")})
    return canonical(with_prices(rows, F.col("raw_prices"), "RON", run_at))


#: Country -> adapter.  To add a source, write a function of the same form and register it here (and its row in dims.SOURCES).
ADAPTERS = {
    "SE": sweden, "NO": norway, "DK": denmark, "FI": finland, "IS": iceland, "DE": germany, "FR": france, "ES": spain, "PT": portugal,
    "AT": austria,
    "IT": italy, "SI": slovenia, "HR": croatia, "RO": romania,
}
