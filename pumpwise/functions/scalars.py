"""Scalar expressions over Columns: numbers, keys, names, addresses, coordinates.  No Python runs per row."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from pumpwise.functions.dims import BRAND_ALIASES

#: White space that may surround a value, the no-break space included.
BLANK = r"[\s ]"
_NUMBER = rf"^{BLANK}*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?{BLANK}*$"
_CITY_STREET = "^[A-Z][a-z]{2,}[A-Z]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def number(c: Column) -> Column:
    """A text as a double; null if it is not a plain finite decimal number."""
    return F.when(c.rlike(_NUMBER), strip(c).try_cast("double"))


def decimal_comma(c: Column) -> Column:
    """'1,499' as 1.499; with both separators ('1.234,5') null."""
    return number(F.replace(c, F.lit(","), F.lit(".")))


def strip_symbol(c: Column, symbol: str = "€") -> Column:
    """'1,499 €' as 1.499."""
    return decimal_comma(F.replace(c, F.lit(symbol), F.lit("")))


def valid_price(p: Column) -> Column:
    """Whether a double is a price: above 0 and a number."""
    return p.isNotNull() & ~F.isnan(p) & (p > 0)


def nonblank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_nonblank(*cols: Column, default: str = "") -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(nonblank(c) for c in cols), F.lit(default))


def sentinel_to_null(c: Column, sentinel: str = "-") -> Column:
    """Null for the sentinel and for blank text; otherwise the text without outer blanks."""
    return F.nullif(nonblank(strip(c)), F.lit(sentinel))


@functools.cache
def _fold_table() -> tuple[str, str]:
    """Characters whose decomposed lower-case form keeps exactly one letter or digit of ASCII, and that one."""
    pairs = {}
    for code in range(0x80, 0x2200):
        parts = unicodedata.normalize("NFD", chr(code).lower())
        kept = re.findall("[a-z0-9]", "".join(p for p in parts if not unicodedata.combining(p)))
        if len(kept) == 1:
            pairs[chr(code)] = kept[0]
    return "".join(pairs), "".join(pairs.values())


def norm_key(c: Column) -> Column:
    """Lower case, accents dropped, ASCII letters and digits only; letters without a decomposition (ø, ł, ß) vanish."""
    accented, plain = _fold_table()
    lowered = F.lower(c)
    # Most texts are plain ASCII; only others are looked up character by character.
    folded = F.when(F.length(lowered) == F.octet_length(lowered), lowered).otherwise(F.translate(lowered, accented, plain))
    return F.regexp_replace(folded, "[^a-z0-9]+", "")


def brand_key(c: Column, aliases: Mapping[str, str] = BRAND_ALIASES) -> Column:
    """The key of the first word, old brands replaced by current ones; '' for a blank or null brand."""
    key = norm_key(F.regexp_extract(F.coalesce(c, F.lit("")), rf"^{BLANK}*([^\s ]+)", 1))
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.coalesce(F.try_element_at(table, key), key)


def split_camel(c: Column) -> Column:
    """'CityStreetName' as struct(city, street): words that start with a capital (ASCII); no such word: all is the city."""
    words = F.regexp_extract_all(c, F.lit("[A-Z][a-z]*"), F.lit(0))
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.struct(F.coalesce(F.get(words, F.lit(0)), c).alias("city"), rest.alias("street"))


def parse_composite_id(c: Column) -> Column:
    """'county_brand..._CityStreet...' as struct(name, brand, geo_key, city, street).

    The first segment after the county that looks like 'CityStreet' is the geo key, those before it are
    the brand.  With a single segment the whole id is name and brand.
    """
    parts = F.split(c, "_")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    at = F.array_position(F.transform(rest, lambda s: s.rlike(_CITY_STREET)), F.lit(True)).cast("int")
    before = F.when(at > 0, F.slice(rest, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(rest)
    brand = F.when(F.size(before) > 0, F.array_join(before, "_")).otherwise(F.get(parts, F.lit(1)))
    geo_key = F.when(at > 0, F.get(rest, at - 1)).otherwise(F.lit(""))
    place = split_camel(geo_key)
    city, street = place["city"], place["street"]
    display = F.replace(brand, F.lit("_"), F.lit(" "))
    where = F.when(city == "", "").when(street == "", F.concat(F.lit(" · "), city)).otherwise(
        F.concat(F.lit(" · "), street, F.lit(", "), city)
    )
    single = F.size(parts) < 2
    return F.struct(
        F.when(single, c).otherwise(F.concat(display, where)).alias("name"), F.when(single, c).otherwise(brand).alias("brand"),
        F.when(single, "").otherwise(geo_key).alias("geo_key"), F.when(single, "").otherwise(city).alias("city"),
        F.when(single, "").otherwise(street).alias("street"),
    )


def rsplit_key(c: Column) -> Column:
    """'a__b__c' as struct(head 'a__b', tail 'c'); both empty without '__'."""
    pattern = "(?s)^(.*)__(.*)$"
    return F.struct(F.regexp_extract(c, pattern, 1).alias("head"), F.regexp_extract(c, pattern, 2).alias("tail"))


def parse_address(c: Column) -> Column:
    """'Street 34 City 5700 Country' as struct(city, postal, street): the first four digits are the postal code; without any all are ''."""
    pattern = "(?s)^(.*?)([0-9]{4})"
    text = F.coalesce(c, F.lit(""))
    words = F.array_remove(F.split(F.regexp_extract(text, pattern, 1), rf"{BLANK}+"), "")
    street = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.struct(
        F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")).alias("city"), F.regexp_extract(text, pattern, 2).alias("postal"),
        street.alias("street"),
    )


def split_comma(c: Column) -> Column:
    """'Brand, address' as struct(brand, address) at the first comma."""
    return F.struct(
        strip(F.substring_index(c, ",", 1)).alias("brand"), strip(F.regexp_extract(c, "(?s)^[^,]*,(.*)$", 1)).alias("address"),
    )


def embedded_price(c: Column, label: str = "Re85") -> Column:
    """'Name (Re85 1.649)' as struct(rest, price): the note goes even if it is no number."""
    note = rf"\({label}\s+([0-9.]+)\)"
    return F.struct(strip(F.regexp_replace(c, note, "")).alias("rest"), number(F.regexp_extract(c, note, 1)).alias("price"))


def sanitize_id(country: Column, c: Column) -> Column:
    """Country prefix in lower case and the source's id with '|' and blanks replaced."""
    return F.concat(lower_code(country), F.lit("_"), F.translate(F.coalesce(c, F.lit("")), "| ", "__"))


def lower_code(c: Column) -> Column:
    return F.lower(c)


def join_address(street: Column, house: Column) -> Column:
    """Street and house number, missing parts left out."""
    return F.trim(F.concat(F.coalesce(street, F.lit("")), F.lit(" "), F.coalesce(house, F.lit(""))))


def brand_and_name(brand: Column, name: Column) -> Column:
    shown = F.coalesce(name, F.lit(""))
    return F.when(nonblank(brand).isNotNull(), F.trim(F.concat(brand, F.lit(" "), shown))).otherwise(shown)


def point(lat: Column, lon: Column) -> Column:
    return F.struct(lat.alias("lat"), lon.alias("lon"))


NO_POINT = "cast(null as struct<lat: double, lon: double>)"


def both_or_none(lat: Column, lon: Column) -> Column:
    """A point; null coordinates unless both are numbers."""
    return F.when(lat.isNotNull() & lon.isNotNull(), point(lat, lon)).otherwise(F.expr(NO_POINT))


def zero_to_null(lat: Column, lon: Column) -> Column:
    """Texts as a point: 0 counts as missing on its own axis; if either is no number, both are null."""
    y, x = number(lat), number(lon)
    return F.when(y.isNotNull() & x.isNotNull(), point(F.nullif(y, F.lit(0.0)), F.nullif(x, F.lit(0.0)))).otherwise(F.expr(NO_POINT))


def within(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a point is in a box (min lat, min lon, max lat, max lon), edges included."""
    return lat.between(box[0], box[2]) & lon.between(box[1], box[3])


def bounded(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """A point; null coordinates outside the box."""
    return F.when(within(lat, lon, box), point(lat, lon)).otherwise(F.expr(NO_POINT))


def descale(geo_lat: Column, geo_lon: Column, lat: Column, lon: Column) -> Column:
    """A point from a geo pair if its latitude is not 0, else from raw numbers, divided by 100 000 if the raw latitude is beyond 90."""
    scaled = F.abs(lat) > 90
    raw = both_or_none(F.when(scaled, lat / 100_000).otherwise(lat), F.when(scaled, lon / 100_000).otherwise(lon))
    return F.when(F.nullif(geo_lat, F.lit(0.0)).isNotNull(), both_or_none(geo_lat, geo_lon)).otherwise(raw)


def repair_axes(candidates: list[Column], box: tuple[float, float, float, float]) -> Column:
    """A point from unreliable fields: the first number in the latitude range and the first in the longitude range; null without two numbers or either axis."""
    found = F.array_compact(F.array(*(decimal_comma(c) for c in candidates)))
    lat = F.get(F.filter(found, lambda v: v.between(box[0], box[2])), F.lit(0))
    lon = F.get(F.filter(found, lambda v: v.between(box[1], box[3])), F.lit(0))
    return F.when(F.size(found) >= 2, both_or_none(lat, lon)).otherwise(F.expr(NO_POINT))


def nested_or_flat(geo_lat: Column, geo_lon: Column, lat: Column, lon: Column) -> Column:
    """A point from nested texts unless they are missing or 0, else from flat ones, axis by axis; null if either is no number."""
    pick = (lambda inner, outer: F.coalesce(F.nullif(number(inner), F.lit(0.0)), number(outer)))
    return both_or_none(pick(geo_lat, lat), pick(geo_lon, lon))


def round_places(c: Column, places: int) -> Column:
    return F.round(c, places)


def iso_timestamp(c: Column) -> Column:
    """A UTC timestamp as ISO-8601 text, for sinks."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def geocode_query(city: Column, street: Column, postal: Column, not_cities: list[str] = ()) -> Column:
    """struct(city, street, postal) to look up; null if neither city nor street is known.

    Names in not_cities, roads ('...-tie', 'Keha...') and names that start with a digit are no
    cities; the postal code counts only without a city.
    """
    known = F.coalesce(city, F.lit(""))
    no_city = known.contains("-tie") | known.startswith("Keha") | known.rlike("^[0-9]")
    if not_cities:
        no_city = no_city | known.isin(*not_cities)
        known = F.when(no_city, "").otherwise(known)
    road = F.coalesce(street, F.lit(""))
    query = F.struct(
        known.alias("city"), road.alias("street"), F.when(known == "", F.coalesce(postal, F.lit(""))).otherwise("").alias("postal")
    )
    return F.when((known != "") | (road != ""), query)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.least(F.lit(1.0), F.sqrt(half)))
